"""Quality classifier: hashed word n-gram logistic regression trained with FTRL.

Tokens are runs of letters, digits and non-ASCII bytes, or runs of ASCII
punctuation. Unigrams and bigrams are hashed into 2**bits weights. Training
takes at most `max_train` labelled rows (those with the smallest id hashes), the
one bounded sample here; each of `shards` tasks runs follow-the-regularised-leader
updates over its share and the weights are averaged. Scoring is a sparse dot
product over whole texts in one map over the documents, without a shuffle.

Defined cases: null and empty texts score by the bias alone; without labelled
rows every score is 0.5; rows repeated in either table count as they stand, and
labels whose id has several documents count once for each; a very long text is one
sparse row like any other; equal id hashes are chosen by label; empty tables score
nothing; extra columns are kept, whatever their names, but that `score` replaces
those named as its own two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import numbered
from .textkit import Rolling, chunks, flat, mix, row_of

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight index and row of every unigram and bigram."""
    kind = _CLASS[raw]
    change = np.ones(len(raw) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    words = mix(Rolling(raw).ranges(start, end))
    row = row_of(np.searchsorted(start, offsets))
    same = row[1:] == row[:-1]
    pairs = mix(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:])[same]
    shift = np.uint64(64 - bits)
    return np.concatenate([words, pairs]) >> shift, np.concatenate([row, row[:-1][same]])


def dots(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Sparse dot product of each row: occurrence weights over the root of their number."""
    at, row = features(raw, offsets, bits)
    n = len(offsets) - 1
    return np.bincount(row, weights[at], n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))


def fit(texts: list[str], labels: np.ndarray, bits: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in order; returns weights and bias."""
    z, g2 = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = gb = 0.0

    def leader(z, g2):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(g2)) / alpha + l2))

    rows = []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        at, count = np.unique(features(raw, np.array([0, len(raw)]), bits)[0].astype(np.int64), return_counts=True)
        rows.append((at, count / np.sqrt(max(count.sum(), 1))))
    for _ in range(epochs):
        for (at, value), label in zip(rows, labels, strict=True):
            w = leader(z[at], g2[at])
            bias = -zb / ((beta + gb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ value + bias, -35, 35)))
            g = (p - label) * value
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha * w
            g2[at] += g * g
            g = p - label
            zb += g - ((gb + g * g) ** 0.5 - gb**0.5) / alpha * bias
            gb += g * g
    return leader(z, g2), float(-zb / ((beta + gb**0.5) / alpha))


def train(documents: DataFrame, labels: DataFrame, max_train: int = 6000, shards: int = 3, bits: int = 18) -> tuple[np.ndarray, float]:
    """Averaged weights and bias; only bounded samples and weights leave the tasks."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("quality").cast("double").alias("label"))
        .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
        .orderBy(F.xxhash64("doc_id"), "label").limit(max_train)
    )
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "label"])
        w, b = fit(pdf.text.tolist(), pdf.label.to_numpy(), bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": [at.astype("<i4").tobytes()], "w": [w[at].astype("<f8").tobytes()], "b": [b]})

    parts = rows.select("label", "text", F.xxhash64("doc_id").alias("order"), F.expr(f"pmod(xxhash64(doc_id, 7), {shards})").alias("shard")).groupBy("shard").applyInPandas(one, "at binary, w binary, b double").collect()
    weights, bias = np.zeros(1 << bits), 0.0
    for part in parts:
        weights[np.frombuffer(part.at, "<i4")] += np.frombuffer(part.w, "<f8") / len(parts)
        bias += part.b / len(parts)
    return weights, bias


def _scored(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float) -> tuple[DataFrame, list]:
    """`documents` under names of their own with `score` and `predicted`, and their columns by name."""
    weights, bias = model
    bits = len(weights).bit_length() - 1
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    others, back = numbered(documents, "text")
    docs = documents.select(*others, F.col("text").cast("string").alias("text"))
    schema = StructType([*docs.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in chunks(batch):
                p = 1 / (1 + np.exp(-np.clip(dots(*flat(part.column("text")), w, bits) + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema), back("text")


def score(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """All columns of `documents` but those named score or predicted, with the model's `score` and `predicted`."""
    scored, columns = _scored(documents, model, threshold)
    kept = [c for c, name in zip(columns, documents.columns, strict=True) if name.lower() not in ("score", "predicted")]
    return scored.select(*kept, "score", "predicted")


def accepted(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """The rows of `documents`, with all their own columns, whose score reaches the threshold."""
    scored, columns = _scored(documents, model, threshold)
    return scored.where("predicted = 1").select(*columns)
