"""Line dedup behind two Bloom filters.

Each task notes the hashes of its documents' distinct line keys in a filter of
keys seen once and one of keys seen twice (by key in a task, by bit where tasks
meet). Filters have `per_key` bits for each line of the table, counted first, and
are cut into segments of fixed size, which are merged across tasks one by one.

Up to `broadcast_bits` the merged twice-filter is broadcast and tested where the
texts are. Beyond, it stays in its segments: the keys' hashes are sent to them, once
for each task that has them, and the suspects' hashes come back by a join. Either
way only keys that the filter suspects are shuffled, where their documents are
counted exactly; a filter that suspects too much changes no result.

A key is a line without blanks at its ends, A-Z lower-cased. Keys of at least
`min_chars` code points in at least `min_docs` documents (2 or more) lose all their
lines, except in the largest doc_id that holds the key.

Defined cases: null or empty text is one empty line and stays as it is; rows that
repeat a doc_id count as one document, and all are treated alike; a null doc_id is
the smallest; an empty table gives an empty result; very long texts are one row like
any other; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import numbered, ready, row_order, whole_ids

_STRIP = " \t\n\v\f\r"
SEGMENT_BITS = 1 << 22


def line_keys(text: str | None, min_chars: int) -> list[str | None]:
    """The key of each line, or None where it is too short."""
    # bytes.lower() changes A-Z only, and does a whole text at once.
    return [k if len(k := line.strip(_STRIP)) >= min_chars else None for line in (text or "").encode().lower().decode().split("\n")]


def own_keys(text: str | None, min_chars: int) -> list[str]:
    """The distinct keys of a text."""
    return list({k: 0 for k in line_keys(text, min_chars) if k is not None})


def hashed(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))


def filter_bits(documents: DataFrame, per_key: int = 8) -> int:
    """Bits for all lines, rounded up to a power of two of at least one segment."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n = documents.agg(F.sum(lines.cast("long"))).first()[0] or 0
    return max(SEGMENT_BITS, 1 << (per_key * n - 1).bit_length()) if n else SEGMENT_BITS


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key, both in one segment."""
    first = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return first, first // SEGMENT_BITS * SEGMENT_BITS + (hashes >> np.uint64(40)).astype(np.int64) % SEGMENT_BITS


def _runs(own: np.ndarray) -> list[tuple[int, slice]]:
    """Each value of a sorted array with the slice that it fills."""
    values, first = np.unique(own, return_index=True)
    return [(int(v), slice(s, e)) for v, s, e in zip(values, first, [*first[1:], len(own)], strict=False)]


def _by_segment(at: np.ndarray) -> dict[int, bytes]:
    """Sorted bits as positions (unsigned 32-bit) within their segments."""
    return {segment: (at[part] % SEGMENT_BITS).astype("<u4").tobytes() for segment, part in _runs(at // SEGMENT_BITS)}


def twice_filter(documents: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(segment, twice): packed, compressed bits of keys seen in two documents or more."""

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [hashed(own_keys(text.as_py(), min_chars)) for batch in batches for text in batch.column("text")]
        hashes, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        once, twice = (_by_segment(np.unique(np.concatenate(positions(h, bits)))) for h in (hashes, hashes[count > 1]))
        columns = [pa.array(list(once), pa.int32()), pa.array(list(once.values()), pa.binary()), pa.array([twice.get(s, b"") for s in once], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["segment", "once", "twice"])

    def merge(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
        for pdf in pdfs:
            for a, b in zip(pdf.once, pdf.twice, strict=True):
                a = np.frombuffer(a, "<u4")
                twice[a[once[a]]] = True
                twice[np.frombuffer(b, "<u4")] = True
                once[a] = True
        yield pd.DataFrame({"segment": [key[0]], "twice": [zstandard.compress(np.packbits(twice).tobytes(), 3)]})

    return documents.select("text").mapInArrow(note, "segment int, once binary, twice binary").groupBy("segment").applyInPandas(merge, "segment int, twice binary")


def _held(packed: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(at[0]), bool)
    for x in at:
        hit &= (packed[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def suspects_here(docs: DataFrame, merged: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(o, h, key) that a broadcast filter suspects."""
    whole = np.zeros(bits // 8, np.uint8)
    for part in merged.collect():  # at most `broadcast_bits`
        at = part.segment * SEGMENT_BITS // 8
        whole[at : at + SEGMENT_BITS // 8] = np.frombuffer(zstandard.decompress(part.twice), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        for batch in batches:
            own = [own_keys(text.as_py(), min_chars) for text in batch.column("text")]
            keys, row = [k for some in own for k in some], np.repeat(np.arange(len(own)), [len(some) for some in own])
            hit = _held(packed, positions(hashed(keys), bits))
            row = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([batch.column("o").take(row), batch.column("h").take(row), pa.array(keys, pa.string()).filter(pa.array(hit))], ["o", "h", "key"])

    return docs.select("o", "h", "text").mapInArrow(suspect, "o long, h long, key string")


def suspects_by_segment(docs: DataFrame, merged: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """The same where the filter stays in its segments and hashes are sent to them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [hashed(own_keys(text.as_py(), min_chars)) for batch in batches for text in batch.column("text")]
        hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        own = (hashes & np.uint64(bits - 1)).astype(np.int64) // SEGMENT_BITS
        order = np.argsort(own, kind="stable")
        hashes, runs = hashes[order], _runs(own[order])
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in runs], pa.int32()), pa.array([hashes[part].tobytes() for _, part in runs], pa.binary())], ["segment", "hashes"])

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"x": np.zeros(0, np.int64)})
        hashes = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in left.hashes]))
        packed = np.frombuffer(zstandard.decompress(right.twice.iloc[0]), np.uint8)
        first, second = positions(hashes, bits)
        return pd.DataFrame({"x": hashes[_held(packed, (first % SEGMENT_BITS, second % SEGMENT_BITS))].view(np.int64)})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [own_keys(text.as_py(), min_chars) for text in batch.column("text")]
            keys, row = [k for some in own for k in some], np.repeat(np.arange(len(own)), [len(some) for some in own])
            yield pa.RecordBatch.from_arrays([pa.array(hashed(keys).view(np.int64)), batch.column("o").take(pa.array(row)), batch.column("h").take(pa.array(row))], ["x", "o", "h"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = own_keys(batch.column("text")[i].as_py(), min_chars)
                wanted = np.isin(hashed(keys).view(np.int64), batch.column("xs")[i].values.to_numpy())
                mine = pa.array(np.full(int(wanted.sum()), i))
                yield pa.RecordBatch.from_arrays([batch.column("o").take(mine), batch.column("h").take(mine), pa.array(keys, pa.string()).filter(pa.array(wanted))], ["o", "h", "key"])

    sent = docs.select("text").mapInArrow(send, "segment int, hashes binary")
    found = sent.groupBy("segment").cogroup(merged.groupBy("segment")).applyInPandas(test, "x long")
    held = docs.select("o", "h", "text").mapInArrow(pairs, "x long, o long, h long").join(found, "x", "left_semi")
    wanted = held.groupBy("o", "h").agg(F.collect_set("x").alias("xs"))
    return docs.select("o", "h", "text").join(wanted, ["o", "h"]).mapInArrow(named, "o long, h long, key string")


def drop_repeated_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, counts: tuple[str, str] | None = None, salts: int = 8, broadcast_bits: int = 1 << 30) -> DataFrame:
    """`documents` with the kept lines as text, and the numbers of lines before and of lines dropped under the names `counts`."""
    whole_ids(documents)
    ready(documents.sparkSession)
    others, back = numbered(documents, "text")
    docs = documents.select(*others, row_order().alias("o"), F.xxhash64("text").alias("h"), "text")
    bits = filter_bits(docs)
    merged = twice_filter(docs, min_chars, bits)
    found = suspects_here if bits <= broadcast_bits else suspects_by_segment
    suspects = found(docs, merged, min_chars, bits).distinct().checkpoint()
    repeated = suspects.groupBy("key").agg(F.count_distinct("o").alias("n"), F.max("o").alias("holder")).where(F.col("n") >= max(2, min_docs))
    salted = repeated.select("key", "holder", F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"))
    lost = (
        suspects.withColumn("salt", F.expr(f"pmod(hash(o, h), {salts})").cast("int"))
        .join(salted, ["key", "salt"]).where(F.col("o") != F.col("holder"))
        .groupBy("o", "h").agg(F.collect_list("key").alias("lost"))
    )
    joined = docs.join(lost, ["o", "h"], "left").drop("o", "h")
    kept = [f for f in joined.schema if f.name not in ("text", "lost")]
    schema = StructType([*kept, StructField("text", StringType()), StructField("lines", LongType()), StructField("dropped", LongType())])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, lost in zip(batch.column("text"), batch.column("lost"), strict=True):
                text = text.as_py()
                if not lost.is_valid:
                    texts.append(text)
                    lines.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                gone, own = set(lost.as_py()), text.split("\n")
                left = [line for line, key in zip(own, line_keys(text, min_chars), strict=True) if key not in gone]
                texts.append("\n".join(left))
                lines.append(len(own))
                dropped.append(len(own) - len(left))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema.names)

    out = joined.mapInArrow(drop, schema)
    return out.select(*back("text"), *[F.col(c).alias(name) for c, name in zip(("lines", "dropped"), counts or (), strict=False)])
