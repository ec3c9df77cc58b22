"""Byte-level BPE over whole texts, with merges done on padded numpy matrices.

A text is split by the tokenizer's pattern. The distinct pieces that a task has
not met yet are grouped by length, padded into matrices and merged: in each round
every row merges its leftmost pair of least rank, found in an open-addressed hash
table of pairs, and rows are compacted. Pieces over `LONG` bytes take a heap
instead, with the same merges, so that one huge run costs n log n. The cache of
pieces in a worker is bounded.

Defined cases: null is the empty text, which has no ids; ids and rows may repeat;
an empty table gives none; extra columns are ignored unless kept, and may be named
like the operator's own; a very long text is one row like any other; equal ranks
are merged from the left; any text decodes to its own bytes. Ranks that lack one of the
256 single bytes are refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import numbered

LONG = 512
_CACHE = 400_000
_NONE = np.int64(1) << 40


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a rank file."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Merger:
    """Encodes pieces by a rank list."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for t, rank in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self._table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 1
        while len(left):
            free = self.keys[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            left, at = left[~put], (at[~put] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks."""
        out = np.full(a.shape, _NONE, np.int64)
        where = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a.ravel()[where] << 32) | b.ravel()[where]
        at, flat = self._slot(keys), out.ravel()
        for _ in range(self.probes):
            have = self.keys[at]
            hit = have == keys
            flat[where[hit]] = self.values[at[hit]]
            on = ~hit & (have >= 0)
            where, keys, at = where[on], keys[on], (at[on] + 1) & self.mask
            if not len(where):
                break
        return out

    def encode_same_length(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of one length bucket; shorter ones are padded with -1."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.lookup(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), _NONE)
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        rows = np.arange(len(pieces))
        while len(rows):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), _NONE)
            done = least >= _NONE
            for i in np.flatnonzero(done):
                out[rows[i]] = ids[i][ids[i] >= 0]
            live = ~done
            rows, ids, rank, best, least = rows[live], ids[live], rank[live], best[live], least[live]
            if not len(rows):
                break
            line, cols = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.where(cols <= best[:, None], ids[:, :-1], ids[:, 1:])
            ids[line, best] = least
            old = rank
            rank = np.where(cols[:-1] < best[:, None], old[:, :-1], old[:, 1:])
            width = ids.shape[1]
            if width > 1:
                right = np.minimum(best, width - 2)
                rank[line, right] = self.lookup(ids[line, right], ids[line, right + 1])
                before = np.maximum(best - 1, 0)
                rank[line, before] = self.lookup(ids[line, before], ids[line, before + 1])
        return out

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := self.pairs.get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole])
            elif len(p) > LONG:
                out[i] = self.encode_long(p)
            else:
                buckets.setdefault((len(p) + 3) // 4 if len(p) < 32 else len(p).bit_length() * 16, []).append(i)
        for rows in buckets.values():
            for at in range(0, len(rows), 8192):
                some = rows[at : at + 8192]
                for i, ids in zip(some, self.encode_same_length([pieces[j] for j in some]), strict=True):
                    out[i] = ids
        return out


_mergers: dict[bytes, Merger] = {}


def _merger(tokens: list[bytes]) -> Merger:
    """The worker's merger for these tokens, kept by a digest of all of them."""
    digest = hashlib.sha256(b"".join(len(t).to_bytes(4, "little") + t for t in tokens)).digest()
    return _mergers.get(digest) or _mergers.setdefault(digest, Merger(tokens))


def encode(documents: DataFrame, path: str, pattern: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256, decoded_sha256, and the ids if asked; what is kept must not be named like these."""
    kept = documents.select(*keep)
    _, back = numbered(kept)
    docs = documents.select(*keep, "text").toDF(*[f"c{i}" for i in range(len(keep))], "text")
    tokens = read_ranks(path)
    if not {bytes([i]) for i in range(256)} <= set(tokens):
        raise ValueError("the ranks lack single bytes, so some texts have no encoding")
    shared = documents.sparkSession.sparkContext.broadcast(tokens)
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())] + [StructField("ids", ArrayType(IntegerType()))] * with_ids
    own = [f for f in docs.schema if f.name != "text"]
    schema = StructType([*own, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        merger = _merger(tokens)
        split, cache = regex.compile(pattern).findall, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [split(t) if (t := x.as_py()) else [] for x in batch.column("text")]
                new = list(set().union(*texts).difference(cache))
                if len(cache) + len(new) > _CACHE:
                    cache.clear()
                    new = list(set().union(*texts))
                for piece, ids in zip(new, merger.encode([p.encode() for p in new]), strict=True):
                    cache[piece] = ids.astype("<u4").tobytes()
                encoded = [b"".join(map(cache.__getitem__, pieces)) for pieces in texts]
                ids = [np.frombuffer(e, "<u4") for e in encoded]
                columns = [
                    *(batch.column(f.name) for f in own),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                    pa.array([hashlib.sha256(b"".join(map(tokens.__getitem__, i.tolist()))).hexdigest() for i in ids], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema).select(*back(), *[f.name for f in fields])
