"""Language identification by words first, then shorter and shorter character n-grams.

Counts of words per language come from every training document. The `max_words`
words of each language with most occurrences are known; every other word backs
off to the longest of its character n-grams (from `longest` down to 1) that are
known, averaged over the whole word, over the `max_grams` most frequent n-grams of each language, counted over
all words. Both bounds keep the model's broadcast fixed; they prune the model, not
the counts, and nothing else does: a word met once counts, and so does a language
of one short text. Known words of over `_LONG` letters are held by their SHA-256. A
document's score is the posterior of its best language under evenly weighted
languages.

Defined cases: text that is null or has no letter gets `und` with score 0;
training rows with null language or text are skipped, and a language without any
letter in its texts is not learned; with no training rows all is `und`; equal scores go to the language first in code-point order; ids may repeat.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import buckets, numbered

_LETTERS = regex.compile(r"\p{L}+")
_CACHE = 300_000
_LONG = 64


def _words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def train(documents: DataFrame, max_words: int = 20_000, max_grams: int = 20_000, longest: int = 4) -> dict:
    """{'langs', 'words': {word: log frequencies}, 'grams': the same by n-gram}."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def out():
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            for i, lang in enumerate(langs):
                seen[lang].update(_words(texts[i].as_py()))
            held = sum(map(len, seen.values()))
            if held > 4 * _CACHE:
                yield from out()
                seen.clear()
        yield from out()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def out():
            for lang, some in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(list(some)), pa.array(list(some.values()), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                some = seen[lang]
                for k in range(1, longest + 1):
                    for gram in grams(word, k):
                        some[gram] += n
            if sum(map(len, seen.values())) > 4 * _CACHE:
                yield from out()
                seen.clear()
        yield from out()

    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    schema = "lang string, word string, n long"
    words = usable.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")).checkpoint()

    def top(counts: DataFrame, most: int) -> tuple[list, dict[str, int]]:
        tally = counts.groupBy("lang", "n").agg(F.count("*").alias("m"))
        above = F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
        least = tally.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < most).groupBy("lang").agg(F.min("n").alias("least"))
        short = F.when(F.length("word") > _LONG, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word"))
        rows = counts.join(F.broadcast(least), "lang").where("n >= least").select("lang", short.alias("word"), "n")
        # Only those with the least count can be many: first ranked in parts.
        for part in ([F.pmod(F.xxhash64("word"), F.lit(buckets(documents.sparkSession)))], []):
            rank = Window.partitionBy("lang", *part).orderBy(F.desc("n"), "word")
            rows = rows.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= most).drop("r")
        return rows.collect(), {r.lang: r.t for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}

    pieces = words.mapInArrow(split, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    known, totals = top(words, max_words)
    parts, gram_totals = top(pieces.checkpoint(), max_grams)
    langs = sorted(totals)
    return {"langs": langs, "longest": longest, "words": _logs(known, totals, langs), "grams": _logs(parts, gram_totals, langs)}


def _logs(rows: list, totals: dict[str, int], langs: list[str]) -> dict[str, np.ndarray]:
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r.word, np.zeros(len(langs)))[langs.index(r.lang)] = r.n
    total = np.array([totals[x] for x in langs], float)
    return {w: np.log((c + 0.5) / (total + 0.5 * max(len(counts), 1))) for w, c in counts.items()}


def word_scores(word: str, model: dict) -> np.ndarray:
    """A word's log frequency in each language, or that of its n-grams."""
    short = word if len(word) <= _LONG else "#" + hashlib.sha256(word.encode()).hexdigest()
    if (known := model["words"].get(short)) is not None:
        return known
    marked, total = f"^{word}$", np.zeros(len(model["langs"]))
    for n in range(min(model["longest"], len(marked)), 0, -1):
        found = 0
        for i in range(len(marked) - n + 1):
            if (g := model["grams"].get(marked[i : i + n])) is not None:
                total += g
                found += 1
        if found:
            return total / found
    return total


def predict(documents: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep`, lang_pred and score, from whole texts in one map."""
    _, back = numbered(documents.select(*keep))
    docs = documents.select(*keep, "text").toDF(*[f"c{i}" for i in range(len(keep))], "text")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own = [f for f in docs.schema if f.name != "text"]
    schema = StructType([*own, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs, ids, table = model["langs"], {}, np.zeros((1024, len(model["langs"])), np.float32)
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text"):
                text = text.as_py()
                words = _words(text) if text and langs else []
                if not words:
                    names.append("und")
                    scores.append(0.0)
                    continue
                if len(ids) > _CACHE:
                    ids.clear()
                for w in set(words).difference(ids):
                    if len(ids) == len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[len(ids)] = word_scores(w, model)
                    ids[w] = len(ids)
                total = table[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
                best = int(total.argmax())
                names.append(langs[best])
                scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema).select(*back(), "lang_pred", "score")
