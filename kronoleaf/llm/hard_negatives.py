"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

A largest inner product is a least distance once each vector has one more component that
brings all to one norm (0 in an anchor). So augmented, every row goes to the cell of
its nearest pivot, and cells are cut into rings by distance to it. Anchors are gathered into groups of
bounded bytes. By the triangle inequality a ring can hold a wanted score of an anchor only if its
distances allow it: at least the anchor's k-th best score among the pivots themselves
(which are rows, so the bound is sure) and, for negatives, within the anchor's band of scores.
Rows are copied only to groups with such an anchor. There an exact join follows: a task reads one
group, then streams rows past it, keeping each anchor's best so far. Rows of a group are dealt over
slices by hash, so a hot cell, label or vector is spread evenly.

What the bounds cannot exclude is compared: at worst each row meets each group, that is anchors * rows products,
and rows are copied once a group. On vectors without clusters in 64 dimensions hardly a ring is
excluded (README).

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; rows equal
in id, label and vector are one row, other rows with an equal id are rows of their own; vectors
of different lengths meet in their common components (missing ones are 0); scores tie by id;
an empty table, or one without anchors, gives no rows; scores that may exceed 2**56 raise an error;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import buckets, ready

#: Pivots at most and values in all of them; bytes of a group's vectors; rows of a slice; products held at once.
PIVOTS, PIVOT_VALUES, GROUP_VALUES, SLICE_ROWS, AT_ONCE = 4096, 1 << 20, 1 << 22, 1 << 20, 1 << 21
RINGS = 16
NEVER = -(2**63)


def clean(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (whole components), key and squared norm of the rows that take part."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id is not null and label is not null and embedding is not null").where(fit)
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = rows.select("vec_id", "label", v.alias("v"))
    return rows.select("vec_id", "label", "v", F.xxhash64("vec_id", "label", "v").alias("key"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("norm"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of a matrix, padded with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def narrow(most: int) -> np.dtype:
    """The least type for components of vectors with squared norms up to `most`."""
    return np.dtype("<i2" if most < 2**30 else "<i4" if most < 2**62 else "<i8")


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Packed rows of `width` components as a matrix."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), f"<i{len(cells[0]) // width}").reshape(-1, width).astype(np.float64) if cells else np.zeros((0, width))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most >= 2**56:
        raise ValueError("scores of such long vectors do not fit into a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Pivots:
    """Rows that stand for the cells, and the geometry of augmented vectors."""

    def __init__(self, rows: list, width: int, most: int):
        self.v = np.array([[*r.v, *[0] * (width - len(r.v))] for r in rows], np.float64).reshape(len(rows), width)
        self.id, self.label, self.key = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "label", "key"))
        self.most = float(most)
        self.extra = np.sqrt(np.maximum(self.most - (self.v**2).sum(1), 0))
        #: Slack for rounding in squared distances.
        self.slack = 1e-5 * (self.most + 1)

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of rows and the distance to it."""
        extra = np.sqrt(np.maximum(self.most - (v**2).sum(1), 0))
        near = v @ self.v.T + extra[:, None] * self.extra
        cell = near.argmax(1)
        return cell, np.sqrt(np.maximum(2 * (self.most - near[np.arange(len(v)), cell]), 0))

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Distances of anchors to all pivots."""
        return np.sqrt(np.maximum((v**2).sum(1)[:, None] + self.most - 2 * (v @ self.v.T), 0))

    def distance(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which an anchor has a score; the farther, the lower."""
        return np.sqrt(np.maximum(norm + self.most - 2 * score, 0))


def best(state: np.ndarray, ids: np.ndarray, row: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
    """Bring new (row, score, id) into the best of each row, in place; higher scores first, then smaller ids."""
    k = state.shape[1]
    hit = np.unique(row)
    row = np.concatenate([row, np.repeat(hit, k)])
    score, vec_id = np.concatenate([score, state[hit].ravel()]), np.concatenate([vec_id, ids[hit].ravel()])
    order = np.lexsort((vec_id, -np.maximum(score, NEVER + 1), row))
    row, score, vec_id = row[order], score[order], vec_id[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    take = rank < k
    state[row[take], rank[take]], ids[row[take], rank[take]] = score[take], vec_id[take]


def bands(high: np.ndarray, low: int, up: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score of a positive's negatives: low% to up% of its score, rounded inwards."""
    return -((-low * high) // 100), (up * high) // 100


class Group:
    """One group of anchors and what each has found; `rank` is the place of the positive or -1."""

    def __init__(self, table: pa.Table, width: int, k: int, low: int, up: int):
        self.v = unpacked(table.column("v"), width)
        self.id, self.label, self.key = (table.column(c).to_numpy() for c in ("vec_id", "label", "key"))
        lists = table.column("positives").to_pylist()
        self.bands = max((len(x) for x in lists if x is not None), default=0)
        self.negatives = bool(lists) and lists[0] is not None
        n = max(1, self.bands)
        self.positive = [(i, j, p) for i, x in enumerate(lists) for j, p in enumerate(x or ())]
        #: A row a band (or a row an anchor): least score, largest score.
        self.least, self.most = np.full((len(lists), n), 2**63 - 1 if self.negatives else NEVER, np.int64), np.full((len(lists), n), 0 if self.negatives else 2**63 - 1, np.int64)
        if self.positive:
            i, j = (np.array(x) for x in zip(*((i, j) for i, j, _ in self.positive), strict=True))
            self.least[i, j], self.most[i, j] = bands(np.array([p["score"] for *_, p in self.positive], np.int64), low, up)
        self.score, self.found = np.full((len(lists) * n, k), NEVER, np.int64), np.full((len(lists) * n, k), 2**63 - 1, np.int64)

    def meet(self, v: np.ndarray, vec_id: np.ndarray, label: np.ndarray, key: np.ndarray) -> None:
        step = max(1, AT_ONCE // max(1, len(v)))
        n = self.least.shape[1]
        for s in range(0, len(self.v), step):
            e = min(s + step, len(self.v))
            scores = products(self.v[s:e], v)
            alike = self.label[s:e, None] == label
            worst = np.maximum(self.score.reshape(-1, n, self.score.shape[1])[s:e, :, -1], self.least[s:e])
            if self.negatives:
                fit = ~alike & (scores >= worst.min(1, initial=2**63 - 1)[:, None]) & (scores <= self.most[s:e].max(1, initial=NEVER)[:, None])
            else:
                fit = alike & (scores >= worst) & ~((self.id[s:e, None] == vec_id) & (self.key[s:e, None] == key))
            i, j = np.nonzero(fit)
            found = scores[i, j]
            for band in range(n):
                ok = (found >= worst[i, band]) & (found <= self.most[s + i, band])
                if ok.any():
                    best(self.score, self.found, (s + i[ok]) * n + band, found[ok], vec_id[j[ok]])

    def results(self) -> Iterator[tuple]:
        """(anchor_id, key, band, positive_id, positive_score, id, score), as columns."""
        n = self.least.shape[1]
        row, rank = np.nonzero(self.score > NEVER)
        anchor, band = row // n, row % n
        ids, scores = np.zeros((len(self.v), n), np.int64), np.zeros((len(self.v), n), np.int64)
        for i, j, p in self.positive:
            ids[i, j], scores[i, j] = p["id"], p["score"]
        return self.id[anchor], self.key[anchor], band, ids[anchor, band], scores[anchor, band], self.found[row, rank], self.score[row, rank]


FOUND = "anchor_id long, anchor_key long, band long, positive_id long, positive_score long, id long, score long"


def exact_join(width: int, k: int, low: int, up: int):
    """Streams sorted (group, slice, anchors first) rows; each anchor's best of its slice come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, group = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if group is not None:
                columns = group.results()
                for s in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 50_000].astype(np.int64)) for c in columns], [x.split()[0] for x in FOUND.split(", ")])

        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("grp", "slice", "kind")], 1)
            edges = np.flatnonzero((np.diff(where, axis=0, prepend=where[:1] - 1) != 0).any(1))
            for s, e in zip(edges, [*edges[1:], len(where)], strict=True):
                part = batch.slice(s, e - s)
                if now != tuple(where[s, :2]):
                    yield from out()
                    now, anchors, group = tuple(where[s, :2]), [], None
                if where[s, 2] == 0:
                    anchors.append(part)
                    continue
                if group is None:
                    if not anchors:
                        continue
                    group = Group(pa.Table.from_batches(anchors), width, k, low, up)
                group.meet(unpacked(part.column("v"), width), *(part.column(c).to_numpy() for c in ("vec_id", "label", "key")))
        yield from out()

    return run


def _join(anchors: DataFrame, rows: DataFrame, served: DataFrame, slices: int, width: int, k: int, low: int, up: int) -> DataFrame:
    """Best rows of each anchor, from groups of anchors and the (ring, grp) pairs to which rows are copied."""
    names = ["grp", "slice", "kind", "vec_id", "label", "key", "v", "positives"]
    salts = 8
    hashed = F.pmod(F.xxhash64("key"), F.lit(slices))
    copies = rows.withColumn("salt", F.pmod(F.col("key"), F.lit(salts))).join(served.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["ring", "salt"])
    positives = anchors.schema["positives"].dataType
    sent = copies.withColumns({"slice": hashed, "kind": F.lit(1), "positives": F.lit(None).cast(positives)}).select(*names)
    groups = anchors.withColumns({"slice": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))), "kind": F.lit(0)}).select(*names)
    dealt = groups.union(sent).repartition(slices, "grp", "slice").sortWithinPartitions("grp", "slice", "kind")
    return dealt.mapInArrow(exact_join(width, k, low, up), FOUND)


def serving(pivots: Pivots, rings: list, width: int, k: int, low: int, up: int):
    """(ring, grp) pairs: rings that may hold what an anchor of the group still wants."""
    cell, near, far = (np.array([r[c] for r in rings], t) for c, t in (("cell", np.int64), ("near", np.float64), ("far", np.float64)))
    number = np.array([r.ring for r in rings], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[int, np.ndarray] = {}
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                v, label, key, grp = unpacked(part.column("v"), width), *(part.column(c).to_numpy() for c in ("label", "key", "grp"))
                norm, scores = (v**2).sum(1), products(v, pivots.v)
                alike, gaps = label[:, None] == pivots.label, pivots.distances(v)[:, cell]
                closest, farthest = np.maximum(np.maximum(gaps - far, near - gaps), 0) ** 2, (gaps + far) ** 2
                lists = part.column("positives").to_pylist()
                for i, positives in enumerate(lists):
                    if positives is None:
                        own = np.sort(scores[i][alike[i] & (pivots.key != key[i])])
                        ranges = [(own[-k] if len(own) >= k else NEVER, None)]
                    else:
                        ranges = []
                        for p in positives:
                            least, most = (int(x) for x in bands(np.int64(p["score"]), low, up))
                            seen = np.sort(scores[i][~alike[i] & (scores[i] <= most)])
                            ranges.append((max(least, seen[-k]) if len(seen) >= k else least, most))
                    mask = wanted.setdefault(int(grp[i]), np.zeros(len(number), bool))
                    for least, most in ranges:
                        ok = closest[i] <= norm[i] + pivots.most - 2 * float(least) + pivots.slack
                        if most is not None:
                            ok &= farthest[i] >= norm[i] + pivots.most - 2 * float(most) - pivots.slack
                        mask |= ok
        for g, mask in wanted.items():
            yield pa.RecordBatch.from_arrays([pa.array(number[mask]), pa.array(np.full(mask.sum(), g, np.int64))], ["ring", "grp"])

    return run


def mine(rows: DataFrame, is_anchor: Column | None = None, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, up: int = 90, pivots: int = PIVOTS, group_values: int = GROUP_VALUES, sent: list | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, embedding, label).

    `is_anchor` and `label` are expressions on vec_id and label; by default each 100th id is an anchor and labels stay.
    `sent`, if given, gets (rows copied, groups) of both joins.
    """
    spark = rows.sparkSession
    ready(spark)
    is_anchor = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    rows = clean(rows.select("vec_id", "embedding", (F.col("label") if label is None else label).alias("label")))
    n, n_anchors, most, width = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.coalesce(F.max("norm"), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    # Pivots: the rows of the least hashes of their vectors, one a vector, a number of them that never exceeds the bounds.
    count = max(1, min(pivots, PIVOT_VALUES // width, int(4 * n**0.5)))
    hashed = rows.withColumn("h", F.xxhash64("v"))
    some = hashed.where(F.pmod("h", F.lit(max(1, n // (8 * count)))) == 0)
    chosen = []
    for source in (some, hashed):
        chosen = chosen or source.groupBy("h").agg(F.min(F.struct("vec_id", "label", "key", "v")).alias("r")).orderBy("h").limit(count).select("r.*").collect()
    p = Pivots(chosen, width, most)
    kind = narrow(most)
    sets = max(1, min(len(chosen), -(-n_anchors * width // group_values)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width)
            cell, gap = p.cells(v) if len(v) else (np.zeros(0, np.int64), np.zeros(0))
            ring = cell * (2 * RINGS + 2) + np.floor(RINGS * gap / max(1.0, p.most**0.5)).astype(np.int64)
            near = (v @ p.v[:sets].T).argmax(1) if len(v) else cell
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "key")), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary()), pa.array(cell), pa.array(ring), pa.array(gap), pa.array(near)], ["vec_id", "label", "key", "v", "cell", "ring", "gap", "near"])

    placed = rows.select("vec_id", "label", "key", "v").mapInArrow(assign, "vec_id long, label long, key long, v binary, cell long, ring long, gap double, near long")
    placed = placed.dropDuplicates(["vec_id", "label", "key"]).checkpoint()
    # One row a ring, at most 34 a pivot; one a set of anchors, at most as many as pivots.
    rings = placed.groupBy("ring", "cell").agg(F.min("gap").alias("near"), F.max("gap").alias("far")).collect()
    sizes = {r.near: r.n for r in placed.where(is_anchor).groupBy("near").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = F.create_map(*(F.lit(x) for k, c in sizes.items() for x in (k, -(-c * width // group_values)))) if sizes else F.create_map(F.lit(0).cast("long"), F.lit(1))
    grp = F.col("near") * F.lit(1 << 32) + F.pmod(F.xxhash64("key"), pieces[F.col("near")].cast("long"))
    slices = max(buckets(spark), -(-n // SLICE_ROWS))
    best_of = "array<struct<id:long,score:long>>"
    anchors = placed.where(is_anchor).select(grp.alias("grp"), "vec_id", "label", "key", "v", F.lit(None).cast(best_of).alias("positives"))

    def joined(a: DataFrame, k: int) -> DataFrame:
        served = a.select("grp", "label", "key", "v", "positives").mapInArrow(serving(p, rings, width, k, low, up), "ring long, grp long").distinct()
        if sent is not None:
            sent.append(tuple(placed.groupBy("ring").count().join(served, "ring").agg(F.sum("count"), F.count_distinct("grp")).first()))
        return _join(a, placed, served, slices, width, k, low, up)

    order = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "id")
    near = joined(anchors, positives).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    near = near.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("x"))
    near = near.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"), F.transform("x", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))
    second = anchors.drop("positives").join(near, ["vec_id", "key"]).select(*anchors.columns).checkpoint()
    order = Window.partitionBy("anchor_id", "anchor_key", "band").orderBy(F.desc("score"), "id")
    out = joined(second, negatives).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
