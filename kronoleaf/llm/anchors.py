"""Content-chosen anchors of fixed-length windows, and which anchors repeat.

Every window of `length` items (bytes or words) has one anchor: the start of its
least-hashed `gram`-item piece, the leftmost of equals. Equal windows have their
anchors at equal offsets, so windows need only be compared with windows whose anchor
piece is the same. Neighbouring windows that share an anchor form one packed record
of 41 bytes. A task first combines its records of equal content: all but one of them
are settled there and then travel spread over all buckets, so a passage that a third
of all documents hold reaches its own bucket once a task. The others are dealt by
piece hash, in packed batches, over buckets whose number follows the bytes of text. In a bucket,

* a piece seen once: none of its windows repeat;
* records with equal content (piece and full context, 128 bits of hash): all
  their windows repeat;
* other records of a repeated piece (edges of repeated passages) are open: one
  record of each distinct content must be compared by content with the others.

A hot passage, however many documents hold it, leaves few contents to compare: only
one record of each distinct content goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buckets
from .textkit import Rolling, mix

#: piece hash, content hash, row key, document order, first window start, anchor offset in it, windows - 1,
#: and 1 where other records of the content were settled in the task, 2 for those
RECORD = np.dtype([("piece", "<u8"), ("content", "<u8"), ("key", "<i8"), ("order", "<i8"), ("start", "<i4"), ("lead", "<u2"), ("more", "<u2"), ("same", "u1")])
#: Items of a window at most: what the fields of a record and of front-coded runs can tell.
LONGEST = 30_000
BUCKET_BYTES = 64 << 20
FOUND = "key long, start int, lead int, more int, open boolean, alone boolean, bucket int, o long"


def records(values: np.ndarray, rows: np.ndarray, keys: np.ndarray, order: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Packed records of all windows of the rows; values are items or their hashes."""
    if length > LONGEST:
        raise ValueError(f"windows of more than {LONGEST} items are not supported")
    n, span = len(values), length - gram + 1
    if n < length:
        return np.zeros(0, RECORD)
    roll = Rolling(values)
    piece = mix(roll.grams(gram))
    low = np.uint64((1 << 28) - 1)
    least = (piece & ~low) | (np.arange(len(piece), dtype=np.uint64) & low)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    size = np.diff(rows)
    whole = np.flatnonzero(size >= length)
    first = np.repeat(rows[whole], size[whole] - length + 1)
    begin = np.cumsum(np.concatenate([[0], size[whole] - length + 1]))
    starts = first + np.arange(begin[-1]) - np.repeat(begin[:-1], np.diff(begin))
    at = starts + (((least[starts] & low).astype(np.int64) - starts) & int(low))
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    fresh[begin[:-1]] = True
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(at)) - 1
    s, e, a = starts[head], starts[tail] + length, at[head]
    row = np.repeat(whole, np.diff(begin))[head]
    out = np.zeros(len(head), RECORD)
    out["piece"], out["key"], out["order"] = piece[a], keys[row], order[row]
    out["content"] = mix(roll.ranges(s, e) ^ ((a - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (e - s).astype(np.uint64) * np.uint64(0xCA5A826395121157)))
    out["start"], out["lead"], out["more"] = s - rows[row], a - s, tail - head
    return out


def bucket_count(docs: DataFrame) -> int:
    """Buckets of about `BUCKET_BYTES` of text, and as many as shuffles have partitions at least."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(buckets(docs.sparkSession), -(-size // BUCKET_BYTES))


def again(r: np.ndarray) -> np.ndarray:
    """Which records equal the one before in all that says where they are: those of equal rows."""
    out = np.zeros(len(r), bool)
    out[1:] = True
    for name in ("piece", "content", "order", "key", "start"):
        out[1:] &= r[name][1:] == r[name][:-1]
    return out


def by_place(r: np.ndarray) -> np.ndarray:
    return r[np.lexsort((r["start"], r["key"], r["order"], r["content"], r["piece"]))]


def combined(r: np.ndarray, ordered: bool) -> np.ndarray:
    """The records with `same` set, from those of one task; equal rows have theirs once."""
    r = by_place(r)
    new = np.ones(len(r), bool)
    new[1:] = (r["piece"][1:] != r["piece"][:-1]) | (r["content"][1:] != r["content"][:-1])
    group = np.cumsum(new) - 1
    if ordered:
        r["same"] = 2 * (r["order"] > r["order"][new][group])
    else:
        r["same"] = np.where(new, np.bincount(group)[group] > 1, 2)
    return r[~again(r)]


def deal(made: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed records) of a batch."""
    spread = np.where(made["same"] == 2, made["key"].view("<u8"), made["piece"])
    where = (spread % np.uint64(n)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    made, where = made[order], where[order]
    edges = np.flatnonzero(np.diff(where, prepend=-1))
    for s, e in zip(edges, [*edges[1:], len(made)], strict=True):
        yield int(where[s]), made[s:e].tobytes()


def packed(parts: Iterator[np.ndarray], n: int, ordered: bool, most: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """A task's records, combined and dealt, `most` bytes of them at once."""

    def out() -> pa.RecordBatch:
        pairs = list(deal(combined(np.concatenate(held), ordered), n))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in pairs], pa.int32()), pa.array([x for _, x in pairs], pa.binary())], ["bucket", "packed"])

    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(x.nbytes for x in held) > most:
            yield out()
            held = []
    if sum(map(len, held)):
        yield out()


def repeats(blobs: DataFrame, ordered: bool) -> DataFrame:
    """Repeated and open records, from (bucket, packed).

    `ordered`: only windows with an equal in a smaller order count, so of equal
    contents those of the least order stay open instead of being flagged.
    """

    def rows(key: tuple, r: np.ndarray, open_: np.ndarray, alone: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": r["key"], "start": r["start"], "lead": r["lead"].astype(np.int32), "more": r["more"].astype(np.int32), "open": open_, "alone": alone, "bucket": np.int32(key[0]), "o": r["order"]})

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.concatenate([np.frombuffer(x, RECORD) for x in pdf.packed])
        done, r = by_place(r[r["same"] == 2]), r[r["same"] < 2]
        done = done[~again(done)]
        _, inverse, count = np.unique(r["piece"], return_inverse=True, return_counts=True)
        r = r[(count[inverse] > 1) | (r["same"] > 0)]
        r = by_place(r)
        if not len(r):
            return rows(key, done, np.zeros(len(done), bool), np.zeros(len(done), bool))
        new_piece = np.ones(len(r), bool)
        new_piece[1:] = r["piece"][1:] != r["piece"][:-1]
        new = new_piece.copy()
        new[1:] |= r["content"][1:] != r["content"][:-1]
        group = np.cumsum(new) - 1
        copies = np.bincount(group, 1 + r["same"])[group]
        piece = np.cumsum(new_piece) - 1
        contents = np.bincount(piece, new)[piece]
        if ordered:
            least = r["order"][np.flatnonzero(new)][group]
            flag, alone = r["order"] > least, r["order"] == least
            open_ = (contents > 1) & alone
        else:
            flag, alone = copies > 1, copies == 1
            open_ = (contents > 1) & new
        take = (flag | open_) & ~again(r)
        r, open_, alone = r[take], open_[take], alone[take]
        flag = flag[take]
        # A record that is flagged and open at once stands for both.
        no = np.zeros(len(done), bool)
        return rows(key, np.concatenate([done, r]), np.concatenate([no, open_]), np.concatenate([no, alone & ~flag]))

    return blobs.groupBy("bucket").applyInPandas(settle, FOUND)

