"""Exact substring dedup by a distributed merge sort of suffixes.

All suffixes of all texts cannot be exchanged within a few times the input's size,
so the suffixes sorted are those at anchors (see `anchors`) that are open: the
edges of repeated passages. Each map task sorts its open suffixes, front-codes them
(common-prefix length with the one before, then the rest) and deals the runs by
anchor piece. A loser tree merges the runs of a bucket: every comparison starts
at the prefix length that both sides are known to share with the last winner.
The merged order with its common-prefix lengths gives, for every offset of a
window against its anchor, classes of equal right contexts; left contexts are
classed in the same way, and windows equal on both sides are repeats.

Defined cases: null is empty; texts shorter than `length` bytes lose nothing; rows
that repeat (same doc_id and text) are copies of one another; doc_ids may be null
or repeat; an empty table gives an empty result; extra columns are ignored; a very
long text is anchored alone, in one pass. Rows are told apart by doc_id and a
64-bit hash of doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import bucket_count, packed, records, repeats
from .common import ready, row_key, row_order
from .textkit import chunks, flat

GRAM = 80


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 32
    while a[known : known + step] == b[known : known + step]:
        known += step
    x = int.from_bytes(a[known : min(known + step, n)], "big") ^ int.from_bytes(b[known : min(known + step, n)], "big")
    return known + (min(step, n - known) * 8 - x.bit_length()) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common-prefix lengths and remainders of sorted strings."""
    lengths = np.zeros(len(strings), "<u2")
    rest = []
    for i, s in enumerate(strings):
        if i:
            lengths[i] = common_prefix(strings[i - 1], s)
        rest.append(s[lengths[i] :])
    return lengths, rest


class LoserTree:
    """Merges front-coded runs; yields (string, prefix shared with the one before, run, place).

    Every waiting head keeps the length of the prefix that it shares with the
    string that beat it. When two heads meet, both lengths refer to the last winner:
    the longer one is the smaller string, without looking at any byte, and only equal
    lengths are compared further, from that length on.
    """

    def __init__(self, runs: list[tuple[np.ndarray, list[bytes]]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.place = [0] * self.k
        self.head: list[bytes | None] = [None] * self.k
        self.known = [0] * self.k
        self.tree = [-1] * self.k
        for i, (_, rest) in enumerate(runs):
            self.head[i] = rest[0] if len(rest) else None
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.tree[node] = self._play(a, b)
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.known[a] != self.known[b]:
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        shared = common_prefix(x, y, self.known[a])
        if x[shared : shared + 1] <= y[shared : shared + 1]:
            self.known[b] = shared
            return a, b
        self.known[a] = shared
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, int, int]]:
        while (string := self.head[self.winner]) is not None:
            i = self.winner
            yield string, self.known[i], i, self.place[i]
            self.place[i] += 1
            lengths, rest = self.runs[i]
            if self.place[i] < len(rest):
                shared = int(lengths[self.place[i]])
                self.head[i], self.known[i] = string[:shared] + rest[self.place[i]], shared
            else:
                self.head[i] = None
            node, win = (i + self.k) // 2, i
            while node >= 1:
                win, self.tree[node] = self._play(win, self.tree[node])
                node //= 2
            self.winner = win


def equal_windows(right_order: np.ndarray, right_shared: np.ndarray, left_order: np.ndarray, left_shared: np.ndarray, lead: np.ndarray, more: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, records) whose window at that offset from the anchor equals another record's.

    The orders list records by right and left context; shared[i] is the prefix that
    entry i shares with the entry before it.
    """
    for d in range(int((lead - more).min()), int(lead.max()) + 1):
        has = (lead >= d) & (lead - more <= d)
        if has.sum() < 2:
            continue
        sides = []
        for order, shared, need in ((right_order, right_shared, length - d), (left_order, left_shared, d)):
            side = np.empty(len(order), np.int64)
            side[order] = np.cumsum(shared < need) if need else 0
            sides.append(side)
        who = np.flatnonzero(has)
        _, inverse, count = np.unique(sides[0][who] * (len(lead) + 1) + sides[1][who], return_inverse=True, return_counts=True)
        yield d, who[count[inverse] > 1]


def keyed(documents: DataFrame) -> DataFrame:
    """The columns that both joins on texts read, so that Spark shuffles them once."""
    return documents.select(row_key().alias("key"), row_order().alias("o"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(key, o, spans): byte ranges [start, end) of repeats, packed as start * 2^32 + end; docs is `keyed`."""
    ready(docs.sparkSession)
    n = bucket_count(docs)
    gram = min(GRAM, max(1, length * 2 // 5))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in chunks(batch))
        yield from packed((records(*flat(part.column("text")), np.asarray(part.column("key")), np.asarray(part.column("o")), length, gram) for part in parts), n, False)

    found = repeats(docs.select("key", "o", "text").mapInArrow(anchor, "bucket int, packed binary"), False).checkpoint()
    wanted = found.where("open").groupBy("key", "o").agg(F.collect_set(F.struct("start", "lead", "more", "alone", "bucket")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted, front-coded runs of open suffixes with their left contexts."""
        for batch in batches:
            rows: dict[int, list] = {}
            for key, o, text, wanted in zip(*(batch.column(c) for c in ("key", "o", "text", "wanted")), strict=True):
                key, o, raw = key.as_py(), o.as_py(), text.as_py().encode()
                for w in wanted.as_py():
                    a = w["start"] + w["lead"]
                    rows.setdefault(w["bucket"], []).append((raw[a : w["start"] + w["more"] + length], raw[w["start"] : a], key, w["start"], w["lead"], w["more"], w["alone"], o))
            buckets_, blobs = [], {c: [] for c in ("shared", "rest_n", "rest", "left", "meta")}
            for bucket, some in rows.items():
                some.sort(key=lambda r: r[0])
                shared, rest = front_code([r[0] for r in some])
                buckets_.append(bucket)
                blobs["shared"].append(shared.tobytes())
                blobs["rest_n"].append(np.array([len(x) for x in rest], "<u2").tobytes())
                blobs["rest"].append(b"".join(rest))
                blobs["left"].append(b"".join(r[1] for r in some))
                blobs["meta"].append(np.array([r[2:] for r in some], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(buckets_, pa.int32()), *(pa.array(v, pa.binary()) for v in blobs.values())], ["bucket", *blobs])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        runs, metas, lefts = [], [], []
        for shared, rest_n, rest, left, meta in zip(pdf.shared, pdf.rest_n, pdf.rest, pdf.left, pdf.meta, strict=True):
            ends = np.cumsum(np.frombuffer(rest_n, "<u2").astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]])
            runs.append((np.frombuffer(shared, "<u2"), [rest[s:e] for s, e in zip(starts, ends, strict=True)]))
            metas.append(np.frombuffer(meta, "<i8").reshape(-1, 6))
            ends = np.cumsum(metas[-1][:, 2])
            lefts += [left[s:e][::-1] for s, e in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        first = np.cumsum([0, *(len(m) for m in metas)])
        meta = np.concatenate(metas)
        order, shared = [], []
        for _, known, i, place in LoserTree(runs):
            order.append(first[i] + place)
            shared.append(known)
        left_order = sorted(range(len(lefts)), key=lefts.__getitem__)
        left_shared, _ = front_code([lefts[i] for i in left_order])
        left_shared = left_shared.astype(np.int64)
        if len(left_shared):
            left_shared[0], shared[0] = 0, 0
        out = []
        lead, more, alone = meta[:, 2], meta[:, 3], meta[:, 4] > 0
        for d, who in equal_windows(np.array(order), np.array(shared), np.array(left_order), left_shared, lead, more, length):
            who = who[alone[who]]
            out.append(np.stack([who, np.full(len(who), d)], 1))
        hits = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        hits = hits[np.lexsort((-hits[:, 1], hits[:, 0]))]
        at = meta[hits[:, 0], 1] + lead[hits[:, 0]] - hits[:, 1]
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:, 0] != hits[:-1, 0]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hits)) - 1 if len(hits) else head
        return pd.DataFrame({"key": meta[hits[head, 0], 0], "o": meta[hits[head, 0], 5], "start": at[head], "end": at[tail] + length})

    runs = docs.join(wanted, ["key", "o"]).mapInArrow(run, "bucket int, shared binary, rest_n binary, rest binary, left binary, meta binary")
    edges = runs.groupBy("bucket").applyInPandas(merge, "key long, o long, start long, end long")
    flagged = found.where("not alone").select("key", "o", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("more") + length).cast("long").alias("end"))
    return flagged.union(edges).groupBy("key", "o").agg(F.collect_set(F.shiftleft("start", 32) + F.col("end")).alias("spans"))


def remove_repeats(documents: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked."""
    docs = keyed(documents)
    joined = docs.join(repeated_spans(docs, length), ["key", "o"], "left").select("doc_id", "text", "spans")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py().encode()
                kept, at, removed, count = [], 0, 0, 0
                end = -1
                for s in np.sort(np.asarray(spans.values)).tolist() if spans.is_valid else ():
                    start, stop = s >> 32, s & 0xFFFFFFFF
                    if start > end:
                        count += 1
                        kept.append(raw[at:start])
                    removed += max(0, stop - max(start, at))
                    at = end = max(at, stop)
                rest = b"".join(kept) + raw[at:]
                rows.append((len(raw), removed, count, hashlib.sha256(rest).hexdigest(), rest)[: 4 + with_text])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [x.split()[0] for x in schema.split(", ")])

    return joined.mapInArrow(cut, schema)
