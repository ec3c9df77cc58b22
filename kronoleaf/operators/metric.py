"""Exact pairs of near vectors, by a partition of the unit sphere.

Vectors are brought to length 1 and go to the cell of their nearest pivot. Two vectors within a
distance r of one another lie in one cell, or each lies within r of the plane between their two
pivots; so a vector also visits those cells of higher number whose plane is that near. In a
cell a block of its own rows meets a block of own or visiting rows: first on a quarter of the
places, where the rest can add no more than the product of the lengths left over, and
then in full for the pairs that this bound leaves.

Nothing is dropped, so the edges are those of all pairs. What is saved depends on the data: with clusters
most cells are never visited; without them the first bound still spares most full products. Where nearly every cell
would be visited, a cell a pivot costs a copy of each row a cell: visits are counted for several numbers of pivots
first, and that of the fewest products is taken which sends no more than a few copies of a row, or than one
cell in which all blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..checkpoints import written

#: Above the rounding of distances and products of unit vectors.
SPARE = 1e-7
#: Values in all pivots together, which every task holds.
PIVOT_VALUES = 1 << 20
#: Copies of a row that cells may cost; rows in a batch that leaves a task; the largest block.
COPIES, BATCH, BLOCK = 32, 4096, 16384


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of length 1, padded with zeros, and their numbers of places."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return out / np.linalg.norm(out, axis=1)[:, None], sizes


def usable(vectors: DataFrame, vec_id: str, column: str) -> DataFrame:
    """(i, v): a row an id; ids or vectors that are null, with a null or non-finite place, or of length 0 take no part.

    Of several vectors of one id the least counts.
    """
    rows = vectors.select(F.col(vec_id).alias("i"), F.transform(column, lambda x: x.cast("double")).alias("v")).where("i is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("i").agg(F.min("v").alias("v"))


def _near_pairs(a: np.ndarray, b: np.ndarray, least: float, head: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows and columns of products of `least` or more, and how many products were made in full, by slices of rows."""
    rest = lambda x: np.sqrt(np.maximum(1 - (x[:, :head] ** 2).sum(1), 0))
    size = max(1, min(512, (1 << 20) // len(b)))
    b_rest = rest(b)
    for s in range(0, len(a), size):
        part = a[s : s + size]
        i, j = np.nonzero(part[:, :head] @ b[:, :head].T + np.outer(rest(part), b_rest) >= least - SPARE)
        full = len(i)
        if len(i) > part.shape[0] * len(b) // 8:
            i, j = np.nonzero(part @ b.T >= least - SPARE)
        ok = np.zeros(len(i), bool)
        for t in range(0, len(i), 1 << 14):
            x, y = i[t : t + (1 << 14)], j[t : t + (1 << 14)]
            ok[t : t + (1 << 14)] = np.einsum("ij,ij->i", part[x], b[y]) >= least
        yield s + i[ok], j[ok], full


def _visits(near: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cell, and which cells of higher number it visits, from its products with the pivots."""
    home = near.argmax(1)
    gap = (near[np.arange(len(near)), home][:, None] - near) / apart[home]
    return home, (gap <= reach) & (np.arange(near.shape[1]) > home[:, None])


def _pieces(rows: str, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / block)).cast("int")


def _cheapest(rows: DataFrame, centre: np.ndarray, apart: np.ndarray, reach: float, block: int) -> int:
    """The number of pivots, of `centre`'s and its quarters down to 1, with the fewest products of those that send `COPIES` of a row or no more than 1 does."""
    width, tried = centre.shape[1], [len(centre)]
    while tried[-1] > 1:
        tried.append(max(1, tried[-1] // 4))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, guests = ({k: np.zeros(k, np.int64) for k in tried} for _ in range(2))
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                near = unit_rows(batch.column("v").slice(s, 1024), width)[0] @ centre.T
                for k in tried:
                    home, visits = _visits(near[:, :k], apart[:k, :k], reach)
                    own[k] += np.bincount(home, minlength=k)
                    guests[k] += visits.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(tried, tried)), pa.array(np.concatenate([np.arange(k) for k in tried])), *[pa.array(np.concatenate([x[k] for k in tried])) for x in (own, guests)]], ["k", "cell", "own", "guests"])

    counts = rows.select("v").mapInArrow(count, "k long, cell long, own long, guests long").groupBy("k", "cell").agg(F.sum("own").alias("own"), F.sum("guests").alias("guests"))
    a, b = F.col("own").cast("double"), F.col("guests").cast("double")
    sent = b + F.when(a > 0, a * (_pieces("own", block) + _pieces("guests", block)) + b * _pieces("own", block)).otherwise(0.0)
    cost = counts.groupBy("k").agg(F.sum(a * (a / 2 + b)).alias("products"), F.sum(sent).alias("sent"), F.sum(a).alias("n")).collect()
    plain = next((r.sent for r in cost if r.k == 1), 0)
    return min((r for r in cost if r.sent <= max(COPIES * r.n, plain)), key=lambda r: (r.products, r.sent)).k if cost else 1


def near_pairs(vectors: DataFrame, vec_id: str, column: str, least: float, pivots: int = 1024, block: int = 4096) -> DataFrame:
    """(a, b, cosine products made): pairs a < b of cosine `least` (above 0) or more, and a row without a pair a block.

    Vectors of different lengths make no pair. Rows are counted a cell first, and a cell is cut into blocks of
    about `block` rows, so a task holds two blocks however many rows share a cell.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine lies above 0 and at most at 1")
    rows = written(usable(vectors, vec_id, column))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    most = max(1, min(pivots, PIVOT_VALUES // width, int(4 * sqrt(n))))
    hashed = rows.select(F.xxhash64("v").alias("h"), "v")
    chosen = [r.v for r in hashed.groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(most).collect()]
    centre = unit_rows(pa.array(chosen, pa.list_(pa.float64())), width)[0] if chosen else np.zeros((1, width))
    apart = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 1e-300))
    reach = sqrt(2 - 2 * least) + SPARE
    kind = dict(rows.dtypes)["i"]
    block = max(block, min(BLOCK, n // 32))
    few = _cheapest(rows, centre, apart, reach, block)
    centre, apart = centre[:few], apart[:few, :few]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                v, sizes = unit_rows(part.column("v"), width)
                home, visits = _visits(v @ centre.T, apart, reach)
                r, c = np.nonzero(visits)
                who, cell = np.concatenate([np.arange(len(v)), r]), np.concatenate([home, c])
                packed = pa.array([x.tobytes() for x in v], pa.binary())
                for low in range(0, len(who), BATCH):
                    own = who[low : low + BATCH]
                    at = pa.array(own)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[low : low + BATCH]), pa.array(np.arange(low, low + len(own)) < len(v)), part.column("i").take(at), pa.array(sizes[own].astype(np.int32)), packed.take(at)], ["cell", "home", "i", "size", "v"])

    placed = written(rows.mapInArrow(place, f"cell long, home boolean, i {kind}, size int, v binary"))
    counts = placed.groupBy("cell").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("guests"))
    counts = counts.select("cell", _pieces("own", block).alias("own"), _pieces("guests", block).alias("guests"))
    at = F.pmod(F.xxhash64("i"), F.when(F.col("home"), F.col("own")).otherwise(F.col("guests"))).cast("int")
    step = lambda lo, hi: F.sequence(lo, hi)
    own = F.concat(F.transform(step(F.lit(0), F.col("p")), lambda x: F.struct(x.alias("x"), F.col("p").alias("y"))), F.transform(F.when(F.col("p") + 1 < F.col("own"), step(F.col("p") + 1, F.col("own") - 1)).otherwise(F.array().cast("array<int>")), lambda y: F.struct(F.col("p").alias("x"), y.alias("y"))), F.transform(step(F.col("own"), F.col("own") + F.col("guests") - 1), lambda y: F.struct(F.col("p").alias("x"), y.alias("y"))))
    guest = F.transform(step(F.lit(0), F.col("own") - 1), lambda x: F.struct(x.alias("x"), (F.col("own") + F.col("p")).alias("y")))
    sent = placed.join(F.broadcast(counts), "cell").withColumn("p", at).select("cell", "home", "i", "size", "v", "p", F.explode(F.when(F.col("home"), own).otherwise(guest)).alias("c")).select("cell", "home", "i", "size", "v", "p", "c.x", "c.y")
    head = max(1, width // 4)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Vectors are unpacked batch by batch; pairs leave slice by slice.
        kept, values = [], []
        for batch in batches:
            kept.append(batch.select(["home", "p", "x", "y", "i", "size"]))
            values.append(np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(-1, width))
        table, v = pa.Table.from_batches(kept), np.concatenate(values)
        values.clear()
        home, p = table.column("home").to_numpy(), table.column("p").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        ids, sizes = table.column("i").combine_chunks(), table.column("size").to_numpy()
        first = np.flatnonzero(home & (p == x))
        second = np.flatnonzero(home & (p == y)) if not (~home).any() and (home & (p == y)).any() else np.flatnonzero(~home)
        if not len(first) or not len(second):
            yield pa.RecordBatch.from_arrays([ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.int64())], ["a", "b", "full"])
            return
        made = 0
        for i, j, full in _near_pairs(v[first], v[second], least, head):
            made += full
            for low in range(0, len(i), 1 << 16):
                at, to = first[i[low : low + (1 << 16)]], second[j[low : low + (1 << 16)]]
                left, right = ids.take(pa.array(at)), ids.take(pa.array(to))
                lower = np.asarray(pa.compute.less(left, right), bool)
                keep = pa.array((sizes[at] == sizes[to]) & (lower if x == y else np.asarray(pa.compute.not_equal(left, right), bool)))
                a, b = (pa.compute.if_else(pa.array(m), left, right).filter(keep) for m in (lower, ~lower))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(np.zeros(len(a), np.int64))], ["a", "b", "full"])
        none = pa.nulls(1, ids.type)
        yield pa.RecordBatch.from_arrays([none, none, pa.array([made], pa.int64())], ["a", "b", "full"])

    import pyarrow.compute  # noqa: F401  pa.compute is not loaded by itself

    return sent.groupBy("cell", "x", "y").applyInArrow(meet, f"a {kind}, b {kind}, full long")


def near_edges(vectors: DataFrame, vec_id: str, column: str, least: float, pivots: int = 1024, block: int = 4096) -> DataFrame:
    """(a, b): pairs a < b of cosine `least` or more."""
    return near_pairs(vectors, vec_id, column, least, pivots, block).where("a is not null").select("a", "b")


def products_made(pairs: DataFrame) -> DataFrame:
    """(products, pairs): products made in full and pairs found, from `near_pairs`."""
    return pairs.agg(F.sum("full").alias("products"), F.count("a").alias("pairs"))
