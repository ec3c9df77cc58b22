"""Document fingerprints by one-permutation MinHash.

Each distinct-or-not shingle of five words is hashed once; its top bits choose a
bin and each bin keeps its least hash. Empty bins copy a filled bin found along a
fixed pseudo-random probe order of their own (optimal densification), and the low
`low` bits of each bin are packed. Likeness is the share of equal bins, corrected
for chance: (m - 2^-b) / (1 - 2^-b), cut to 0..1.

Defined cases: null is the empty text; a text of fewer than five words is one
shingle; a text without words is one shingle of its own kind, so that empty texts
are alike. Ids and rows may repeat; ties of doc_id are ordered by a hash of the
text. Null ids sort first. In a table of one row the row follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import buckets, ready, row_order, whole_ids
from .textkit import CHUNK_BYTES, flat, mix, shingles, word_hashes

BINS, LOW = 256, 8
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _probes(bins: int) -> np.ndarray:
    rng = np.random.default_rng(17)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def sketch(raw: np.ndarray, offsets: np.ndarray, bins: int = BINS, low: int = LOW, k: int = 5) -> np.ndarray:
    """Packed low bits of each row's bins, one row of bytes a text."""
    hashes, _, _, rows = word_hashes(raw, offsets)
    value, row = shingles(hashes, rows, k)
    n = len(offsets) - 1
    blank = np.flatnonzero(np.diff(rows) == 0)
    value, row = np.concatenate([value, np.full(len(blank), 0x123456789ABCDEF1, np.uint64)]), np.concatenate([row, blank])
    least = np.full(n * bins, _FULL)
    at = row * bins + (value >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    np.minimum.at(least, at, mix(value))
    least = least.reshape(n, bins)
    filled = least != _FULL
    probe = _probes(bins)
    r, b = np.nonzero(~filled)
    for step in range(bins):
        if not len(r):
            break
        source = probe[b, step]
        ok = filled[r, source]
        least[r[ok], b[ok]] = mix(least[r[ok], source[ok]] + b[ok].astype(np.uint64))
        r, b = r[~ok], b[~ok]
    bits = least & np.uint64((1 << low) - 1)
    if low == 8:
        return bits.astype(np.uint8)
    spread = (bits[:, :, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).reshape(n, -1), axis=1)


def likeness(a: np.ndarray, b: np.ndarray, bins: int = BINS, low: int = LOW) -> np.ndarray:
    """Bias-corrected share of equal bins of packed fingerprints, row by row."""
    if low == 8:
        same = a == b
    else:
        same = (np.unpackbits(a ^ b, axis=1)[:, : bins * low].reshape(len(a), bins, low) == 0).all(2)
    chance = 2.0**-low
    return np.clip((same.mean(1) - chance) / (1 - chance), 0, 1) if len(a) else np.zeros(0)


def with_next(documents: DataFrame) -> DataFrame:
    """Rows (part, tail, doc_id, text) ready for a task-wise pass in id order.

    Ids alone are sampled into ranges; the first row of each range is also sent,
    as a tail, to the range before it (that of the first range to the last one),
    so every row and its successor meet in one task after a single shuffle.
    """
    whole_ids(documents)
    spark = documents.sparkSession
    n = buckets(spark)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_order().alias("__o"))
    cuts = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("__o", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []

    def ranged(lo: int, hi: int) -> Column:
        """The number of cuts at or below the row's id, by halving."""
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.col("__o") < cuts[mid], ranged(lo, mid)).otherwise(ranged(mid + 1, hi))

    docs = docs.withColumn("part", ranged(0, len(cuts))).withColumn("__h", F.xxhash64("text"))
    firsts = docs.groupBy("part").agg(F.min(F.struct("__o", "__h")).alias("o")).collect()  # a row a range
    used = sorted((r.part, r.o["__o"], r.o["__h"]) for r in firsts)
    edges = spark.createDataFrame([(used[i - 1][0], o, h) for i, (_, o, h) in enumerate(used)], "back int, __o long, __h long")
    tails = docs.join(F.broadcast(edges), ["__o", "__h"]).select(F.col("back").alias("part"), F.lit(1).alias("tail"), "__o", "__h", "doc_id", "text")
    sent = docs.select("part", F.lit(0).alias("tail"), "__o", "__h", "doc_id", "text").union(tails)
    return sent.repartition(max(n, 1), "part").sortWithinPartitions("part", "tail", "__o", "__h")


def fingerprint(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next."""
    ready(documents.sparkSession)
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finish(ids, texts, heads, kind):
        """Rows for texts[:-1]; the last text is the last row's successor."""
        edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts, heads, strict=True)]
        column = pa.array([*texts, *heads[-1:], *edited], pa.large_string())
        prints = sketch(*flat(column))
        n = len(texts)
        own, nxt, new = prints[:n], prints[1 : n + 1], prints[n + 1 :]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in new]), pa.array(likeness(own, new)), pa.array(likeness(own, nxt))],
            schema_names,
        )

    schema_names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, part, ended = [], [], 0, None, 0

        def out(last: bool):
            """All rows but the last have a successor; a range's tail row is only one."""
            nonlocal ids, texts, held
            while len(texts) > 1:
                stop, size = 1, 0
                while stop < len(texts) and (stop == 1 or size + len(texts[stop]) < CHUNK_BYTES // 2):
                    size += len(texts[stop])
                    stop += 1
                stop -= stop == len(texts)
                yield finish(ids[:stop], texts[:stop], texts[1 : stop + 1], kind)
                ids, texts = ids[stop:], texts[stop:]
            held = 0
            if last:
                ids, texts = [], []

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            parts, tails, docs, column = batch.column("part").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")
            for i, p in enumerate(parts):
                if p != part:
                    yield from out(True)
                    part, ended = p, 0
                if ended:
                    continue  # a repeat of the range's tail row
                ended = tails[i]
                ids.append(docs[i])
                texts.append(column[i].as_py())
                held += len(texts[-1])
                if held > CHUNK_BYTES:
                    yield from out(False)
        if texts:
            yield from out(True)

    return with_next(documents).select("part", "tail", "doc_id", "text").mapInArrow(run, schema)
