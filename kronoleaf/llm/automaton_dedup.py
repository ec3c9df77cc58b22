"""Repeated word passages by suffix automata of reference shards.

The reference of each document is every document with a smaller id, so it grows
with the corpus and cannot be broadcast whole. Windows of `length` words are first
reduced to their anchors (see `anchors`): equal windows share an anchor's bucket, so
a bucket is a shard that holds all that its windows can match. Passages equal in
full are settled by their hashes. For the rest (the edges of repeated passages) the
shard's distinct passages build one suffix automaton whose states carry the least
document that holds them; the same passages are streamed through it for their
matching statistics, and a window is removed where the state of its whole length
has a smaller document than its own. Words are compared as they are.

Defined cases: null has no words; fewer words than `length` lose nothing; rows that
repeat a doc_id have one rank, so they do not remove one another's words; a null
doc_id is the smallest; an empty table gives an empty result; extra columns are
ignored; a very long text is anchored alone, in one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import bucket_count, packed, records, repeats
from .common import ready, row_key, row_order, whole_ids
from .textkit import chunks, flat, word_bounds, word_hashes

GRAM = 12


class SuffixAutomaton:
    """A suffix automaton of several word sequences; `least[state]` is the least owner of the state's strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def add(self, words: list, owner: int) -> None:
        """Append one sequence; sequences never run into one another."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for word in words:
            to = nxt[last].get(word)
            if to is not None and length[to] == length[last] + 1:
                last = to
                if least[to] is None or owner < least[to]:
                    least[to] = owner
                continue
            clone_only = to is not None
            if not clone_only:
                state = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                least.append(owner)
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = state
                    p = link[p]
                if p < 0:
                    last = state
                    continue
                to = nxt[p][word]
                if length[to] == length[p] + 1:
                    link[state] = to
                    last = state
                    continue
            else:
                p = last
            clone = len(nxt)
            nxt.append(dict(nxt[to]))
            link.append(link[to])
            length.append(length[p] + 1)
            least.append(None)
            while p >= 0 and nxt[p].get(word) == to:
                nxt[p][word] = clone
                p = link[p]
            link[to] = clone
            if clone_only:
                last = clone
                least[clone] = owner
            else:
                link[state] = clone
                last = state

    def finish(self) -> None:
        """Carry least owners from longer strings to their suffixes."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and self.least[state] is not None and (self.least[up] is None or self.least[state] < self.least[up]):
                self.least[up] = self.least[state]

    def owners(self, words: list, window: int) -> Iterator[tuple[int, int]]:
        """(end, least owner) of each window of the streamed words that the automaton holds."""
        state, matched = 0, 0
        nxt, link, length = self.next, self.link, self.length
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            while length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if matched >= window:
                yield i + 1, self.least[state]


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """(key, o, spans): word ranges [start, end) that an earlier document holds, packed as start * 2^32 + end."""
    ready(docs.sparkSession)
    n = bucket_count(docs)
    gram = min(GRAM, max(1, length * 2 // 5))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(part: pa.RecordBatch) -> np.ndarray:
            hashes, _, _, rows = word_hashes(*flat(part.column("text")))
            return records(hashes, rows, np.asarray(part.column("key")), np.asarray(part.column("o")), length, gram)

        yield from packed((made(part) for batch in batches for part in chunks(batch)), n, True)

    found = repeats(docs.select("key", "o", "text").mapInArrow(anchor, "bucket int, packed binary"), True).checkpoint()
    wanted = found.where("open").groupBy("key", "o").agg(F.collect_set(F.struct("start", "more", "bucket")).alias("wanted"))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, o, text, wanted in zip(*(batch.column(c) for c in ("key", "o", "text", "wanted")), strict=True):
                raw = text.as_py().encode()
                starts, ends, _ = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                for w in wanted.as_py():
                    rows.append((w["bucket"], key.as_py(), o.as_py(), w["start"], raw[starts[w["start"]] : ends[w["start"] + w["more"] + length - 1]]))
            kinds = {"bucket": pa.int32(), "key": pa.int64(), "o": pa.int64(), "start": pa.int32(), "words": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        # Equal rows send the same passages; one of each is enough.
        pdf = pdf.drop_duplicates(["key", "o", "start"])
        sequences = [x.split() for x in pdf.words]
        known: dict[bytes, bytes] = {}
        sequences = [[known.setdefault(w, w) for w in s] for s in sequences]
        for s, o in zip(sequences, pdf.o.tolist(), strict=True):
            automaton.add(s, o)
        automaton.finish()
        out = []
        for s, o, key, start in zip(sequences, pdf.o.tolist(), pdf.key.tolist(), pdf.start.tolist(), strict=True):
            for end, owner in automaton.owners(s, length):
                if owner < o:
                    if out and out[-1][:2] == (key, o) and out[-1][3] == start + end - 1 and out[-1][2] >= start:
                        out[-1] = (key, o, out[-1][2], start + end)
                    else:
                        out.append((key, o, start + end - length, start + end))
        return pd.DataFrame(out, columns=["key", "o", "start", "end"])

    parts = docs.join(wanted, ["key", "o"]).mapInArrow(passages, "bucket int, key long, o long, start int, words binary")
    edges = parts.groupBy("bucket").applyInPandas(match, "key long, o long, start long, end long")
    flagged = found.where("not alone").select("key", "o", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("more") + length).cast("long").alias("end"))
    return flagged.union(edges).groupBy("key", "o").agg(F.collect_set(F.shiftleft("start", 32) + F.col("end")).alias("spans"))


def remove_repeats(documents: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept text if asked."""
    whole_ids(documents)
    docs = documents.select(row_key().alias("key"), row_order().alias("o"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = docs.join(repeated_spans(docs, length), ["key", "o"], "left").select("doc_id", "text", "spans")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().encode().split()
                kept, at = [], 0
                for s in np.sort(np.asarray(spans.values)).tolist() if spans.is_valid else ():
                    start, stop = s >> 32, s & 0xFFFFFFFF
                    kept += words[at:start]
                    at = max(at, stop)
                kept += words[at:]
                whole = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode())[: 3 + with_text])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [x.split()[0] for x in schema.split(", ")])

    return joined.mapInArrow(cut, schema)
