"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation.

Documents with one set of shingles form a class, found by two digests of the set, so
copies are never paired. Class signatures are cut into bands. In each bucket of a
band, classes are first paired with one pivot of the bucket's own (linear in the
bucket, however large), in `star_rounds` rounds with other pivots; whatever shares a
bucket and is not yet in one component is then compared across components, so no
link between components is lost. Buckets with one pivot are taken together. Their
largest component lies in blocks, each of which meets all members of the others: a
row of the largest component is sent once for each block of the rest, so a group
of near copies that a pivot has joined is not multiplied.

Every candidate, in stars and across components, is compared in batches of signature
values and dropped once the posterior probability (uniform prior) of a similarity at
or above the threshold falls below `miss`; survivors are confirmed on whole shingle
sets with integer arithmetic (100 * intersection >= percent * union).

Defined cases: A-Z is lower-cased; with fewer words than a shingle the whole
sequence is one; without words or text the set is empty and links with nothing;
rows that repeat a doc_id are separate members with their own text; a null doc_id
is the smallest and yields a null component_id where it is the least; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LEAST, ready, row_key, row_order, whole_ids
from .graph import components
from .textkit import LOWER, chunks, flat, mix, shingles, word_hashes

BANDS, ROWS, BATCH = 32, 5, 32
_MULTIPLIERS = (np.random.default_rng(5).integers(0, 2**31, BANDS * ROWS) * 2 + 1).astype(np.uint32)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and each row's offsets into them."""
    hashes, _, _, rows = word_hashes(LOWER[raw], offsets)
    value, row = shingles(hashes, rows, k)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def signatures(value: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """MinHash signatures (uint32) of the rows with shingles."""
    low = (value >> np.uint64(32)).astype(np.uint32)
    starts = rows[:-1][np.diff(rows) > 0]
    out = np.empty((len(_MULTIPLIERS), len(starts)), np.uint32)
    for i, m in enumerate(_MULTIPLIERS):
        x = low * m
        x ^= x >> np.uint32(15)
        out[i] = np.minimum.reduceat(x, starts) if len(starts) else 0
    return out.T


def digests(value: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each row's set; 0 for empty ones."""
    full = np.diff(rows) > 0
    out = np.zeros((2, len(rows) - 1), np.uint64)
    for i, salt in enumerate((0xA5A5A5A55A5A5A5A, 0x3C6EF372FE94F82B)):
        if full.any():
            out[i, full] = mix(np.add.reduceat(mix(value ^ np.uint64(salt)), rows[:-1][full]) + np.diff(rows)[full].astype(np.uint64))
    return out[0].view(np.int64), out[1].view(np.int64)


def least_matches(percent: int, miss: float) -> list[int]:
    """For each batch end, the fewest equal values that keep the posterior at `miss` or more."""
    t, out = percent / 100, []
    for m in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, x = 0.0, -1
        while total < miss:
            x += 1
            total += comb(m + 1, x) * t**x * (1 - t) ** (m + 1 - x)
        out.append(x)
    return out


def survivors(a: np.ndarray, b: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Indices of the pairs of signature rows that no batch rules out."""
    left, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, bound in enumerate(bounds):
        span = slice(i * BATCH, (i + 1) * BATCH)
        equal = equal + (a[left, span] == b[left, span]).sum(1)
        ok = equal >= bound
        left, equal = left[ok], equal[ok]
    return left


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets.

    Shingles that both sides hold become columns of 0/1 matrices, a slice at a time;
    the product of the two matrices counts all intersections at once.
    """
    size = np.array([len(x) for x in (*left, *right)])
    row = np.repeat(np.arange(len(size)), size)
    _, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    ours = row < len(left)
    shared = np.zeros((2, len(at) and int(at.max()) + 1), bool)
    shared[0, at[ours]] = shared[1, at[~ours]] = True
    renamed, keep = np.cumsum(shared.all(0)) - 1, shared.all(0)[at]
    at, row, ours = renamed[at[keep]], row[keep], ours[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    at, row, ours = at[order], row[order], ours[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        part = slice(*np.searchsorted(at, [low, low + columns]))
        a, b = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        mine = ours[part]
        a[row[part][mine], at[part][mine] - low] = 1
        b[row[part][~mine] - len(left), at[part][~mine] - low] = 1
        out += a @ b.T
    return out.astype(np.int64)


def links_across(node: np.ndarray, root: np.ndarray, few: np.ndarray, side: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], bounds: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links between rows of side 0 and rows of side 1 with other roots, one for each row of side 0 and root.

    Signatures are compared batch by batch and pruned as all candidates are; the
    sets of those left are confirmed exactly. Rows that are `few` stand on both
    sides, so their pairs are taken in one direction only.
    """
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    size, left, right = np.array([len(x) for x in sets]), [], []
    step = max(1, (1 << 25) // max(1, len(b) * BATCH))
    for low in range(0, len(a), step):
        i = a[low : low + step, None]
        ok = (root[i] != root[b]) & (~few[b] | (node[i] < node[b])) & (100 * np.minimum(size[i], size[b]) >= percent * np.maximum(size[i], size[b]))
        ok &= (sig[i, :BATCH] == sig[b, :BATCH]).sum(2) >= bounds[0]
        x, y = np.nonzero(ok)
        for at in range(0, len(x), 1 << 16):
            p, q = i[x[at : at + (1 << 16)], 0], b[y[at : at + (1 << 16)]]
            keep = survivors(sig[p], sig[q], bounds)
            left.append(p[keep])
            right.append(q[keep])
    p, q = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
    if not len(p):
        return node[p], node[q]
    (u, at_u), (v, at_v) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
    both = intersections([sets[k] for k in u], [sets[k] for k in v])[at_u, at_v]
    ok = 100 * both >= percent * (size[p] + size[q] - both)
    p, q = p[ok], q[ok]
    _, first = np.unique(np.stack([p, root[q]], 1), axis=0, return_index=True)
    return node[p[first]], node[q[first]]


def _matrix(column: pa.Array) -> np.ndarray:
    return flat(column)[0].view("<u2").reshape(len(column), -1)


def link_classes(documents: DataFrame, k: int, percent: int = 80, miss: float = 1e-9, star_rounds: int = 1, block: tuple[int, int] = (1024, 4096), broadcast_ids: int = 1_000_000) -> DataFrame:
    """(key, o, n, group, root): each row's `row_key()`, id (null as the least long), set size, component (null without shingles) and the component's least id, which components can share where ids repeat."""
    whole_ids(documents)
    spark = documents.sparkSession
    ready(spark)
    docs = documents.select(row_order().alias("o"), F.coalesce("text", F.lit("")).alias("text"), row_key().alias("key"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                value, rows = shingle_sets(*flat(part.column("text")), k)
                full = np.diff(rows) > 0
                sig = np.zeros((len(full), len(_MULTIPLIERS)), "<u2")
                sig[full] = signatures(value, rows).astype("<u2")
                node, alt = digests(value, rows)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("o"), pa.array(np.diff(rows).astype(np.int64)), pa.array(node), pa.array(alt), pa.array([x.tobytes() for x in sig], pa.binary())], ["key", "o", "n", "node", "alt", "sig"])

    described = docs.mapInArrow(describe, "key long, o long, n long, node long, alt long, sig binary").checkpoint()
    classes = described.where("n > 0").groupBy("node").agg(F.min("o").alias("first"), F.first("n").alias("n"), F.first("alt").alias("alt"), F.first("sig").alias("sig"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sig = _matrix(batch.column("sig")).astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = np.zeros(sig.shape[:2], np.uint64) + salt
            for i in range(ROWS):
                key = mix(key + sig[:, :, i])
            node = np.repeat(np.asarray(batch.column("node")), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], ["band", "node"])

    bands = classes.select("node", "sig").mapInArrow(cut, "band long, node long")
    shared = bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    members = bands.join(shared, "band").checkpoint()
    some = members.select("node").distinct()
    facts = classes.join(some, "node").select("node", "n", "first", "alt", "sig").checkpoint()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                value, rows = shingle_sets(*flat(part.column("text")), k)
                yield pa.RecordBatch.from_arrays([*map(pa.array, digests(value, rows)), pa.array([value[s:e].astype("<u8").tobytes() for s, e in zip(rows[:-1], rows[1:], strict=True)], pa.binary())], ["node", "alt", "words"])

    firsts = facts.select(F.col("first").alias("o")).distinct()
    firsts = F.broadcast(firsts) if facts.count() <= broadcast_ids else firsts
    words = docs.join(firsts, "o", "left_semi").select("text").mapInArrow(sets, "node long, alt long, words binary").join(facts.select("node", "alt", "sig"), ["node", "alt"]).dropDuplicates(["node"]).checkpoint()
    bounds = least_matches(percent, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), bounds) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in ("wa", "wb"))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def verified(pairs: DataFrame) -> DataFrame:
        size_ok = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        of = lambda c: facts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
        left = pairs.join(of("a"), "a").join(of("b"), "b").where(size_ok).select("a", "b", "sa", "sb").mapInArrow(prune, "a long, b long")
        w = lambda c: words.select(F.col("node").alias(c), F.col("words").alias(f"w{c}"))
        return left.join(w("a"), "a").join(w("b"), "b").select("a", "b", "wa", "wb").mapInArrow(confirm, "a long, b long")

    sizes = members.groupBy("band").agg(F.count("*").alias("c"))
    score = members.join(sizes, "band").groupBy("node").agg(F.sum("c").alias("score"))
    scored = members.join(score, "node").checkpoint()
    known, placed = None, scored.withColumn("root", F.col("node"))
    for step in range(star_rounds):
        # The first pivot is the bucket's member met most often in all buckets: the text that a group's copies were made from.
        best = F.struct("score", "node") if step == 0 else F.struct(F.xxhash64("node", "band", F.lit(step)), "node")
        mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by(F.struct("node", "root"), best).alias("pivot")).where("lo < hi").select("band", "pivot")
        met = placed.join(mixed, "band").where("root != pivot.root").select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"))
        new = verified(met.distinct()).checkpoint()
        roots = components(new if known is None else known.union(new))
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        placed = scored.join(roots, "node", "left").select("band", "node", "score", F.coalesce("root", "node").alias("root"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack([np.frombuffer(x, "<u2") for x in pdf.sig])
        a, b = links_across(pdf.node.to_numpy(), pdf.root.to_numpy(), pdf.few.to_numpy(), pdf.side.to_numpy(), sig, [np.frombuffer(x, "<u8") for x in pdf.words], bounds, percent)
        return pd.DataFrame({"a": a, "b": b})

    groups = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("node", F.struct("score", "node")).alias("pivot")).where("lo < hi").select("band", "pivot")
    open_ = placed.join(groups, "band").select("pivot", "node", "root").distinct().join(facts.select("node", "n"), "node").checkpoint()
    by_root = open_.groupBy("pivot", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    largest = F.max(F.struct("c", "n", "root"))
    parts = by_root.groupBy("pivot").agg(largest.alias("big"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    # Blocks are bounded in rows, and in shingles by a thousand a row on average. They are
    # written before the join, which so can split a hot pivot's rows.
    in_blocks = lambda c, n, most: F.greatest(F.lit(1), F.ceil(F.greatest(c / most, n / (1000 * most)))).cast("int")
    parts = parts.select("pivot", F.col("big.root").alias("big"), in_blocks(F.col("c") - F.col("big.c"), F.col("n") - F.col("big.n"), block[0]).alias("nx"), in_blocks(F.col("c"), F.col("n"), block[1]).alias("ny")).checkpoint()
    dealt = open_.join(parts, "pivot").select("pivot", "node", "root", (F.col("root") != F.col("big")).alias("few"), "nx", "ny")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = dealt.where("few").select("pivot", "node", "root", "few", F.lit(0).alias("side"), F.expr("cast(pmod(xxhash64(node), nx) as int)").alias("x"), every("ny").alias("y"))
    two = dealt.select("pivot", "node", "root", "few", F.lit(1).alias("side"), every("nx").alias("x"), F.expr("cast(pmod(xxhash64(node, 1), ny) as int)").alias("y"))
    cells = one.union(two).join(words.select("node", "sig", "words"), "node")
    links = known.union(cells.groupBy("pivot", "x", "y").applyInPandas(across, "a long, b long")).checkpoint()
    roots = components(links)
    linked = facts.select("node", "alt").join(roots, "node", "left").select("node", "alt", F.coalesce("root", "node").alias("root"))
    named = described.where("n > 0").join(linked, ["node", "alt"], "left").select("node", "alt", "o", F.coalesce("root", F.col("node").bitwiseXOR(F.col("alt"))).alias("root"))
    least = named.groupBy("root").agg(F.min("o").alias("least"))
    of_node = named.select("node", "alt", "root").distinct().join(least, "root").select("node", "alt", F.col("root").alias("group"), "least")
    return described.drop("sig").join(of_node, ["node", "alt"], "left").select("key", "o", "n", "node", "group", F.coalesce("least", "o").alias("root"))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    out = link_classes(documents, k, percent)
    null = lambda c: F.nullif(F.col(c), F.lit(LEAST))
    return out.select(null("o").alias("doc_id"), F.col("n").alias("n_shingles"), null("root").alias("component_id"), (F.col("o") == F.col("root")).alias("kept"))
