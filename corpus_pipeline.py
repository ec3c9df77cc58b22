"""A corpus pipeline of five training-data stages over `documents`.

quality -> line dedup -> near dedup -> decontamination -> byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of `documents`; the last returns each document's
token count, token ids' digest and the digest of the decoded text.

Defined cases, for every stage: rows are told apart by doc_id and text, so ids may be
null or repeat; columns may hold nulls; columns beyond doc_id and text are carried as
they are, whatever their names, and are not read but for n_chars, which follows
the text in line dedup; null, empty and very long texts are rows like any other; an
empty table gives an empty table. What a stage makes of null texts, ties and
repeated rows stands in its own docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kronoleaf.llm import byte_bpe, decontam, line_dedup, near_dup, quality
from kronoleaf.llm.common import numbered, ready, row_key, row_order, table

#: The stages hold models and iterate to a fixed point, which SQL cannot express.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; all of them where there are no labels to learn from.

    Labels are learned by doc_id from the documents given. A null or empty text scores by
    the bias alone; rows that repeat score alike and stay or go together.
    """
    labels = table(spark, sf_dir, "labels")
    if labels.where("quality is not null and doc_id is not null").isEmpty():
        return docs
    return quality.accepted(docs, quality.train(docs, labels))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines dropped but in the largest doc_id that holds them; n_chars follows the text.

    No document goes, even where no line is left. A null text stays null. Rows that
    repeat a doc_id count as one document and keep their lines alike.
    """
    out = line_dedup.drop_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): one of the least doc_id, null being the least.

    Ids may repeat or be null: a row is kept for itself, not for its id, and of rows
    that repeat wholly one stays. Rows without words are in no group and all stay.
    """
    rows = near_dup.link_classes(docs, k=5, percent=80)
    equal = rows.where("n > 0").groupBy("group", "o", "key").agg(F.count("*").alias("c"))
    best = equal.groupBy("group").agg(F.min(F.struct("o", "key", "c")).alias("r"))
    kept = best.select("r.o", "r.key", "r.c").union(rows.where("n = 0").select("o", "key", F.lit(1)).distinct()).checkpoint()
    others, back = numbered(docs)
    keyed = docs.select(*others, row_order().alias("o"), row_key().alias("key"))
    single, repeated = (keyed.join(kept.where(c).select("o", "key"), ["o", "key"], "left_semi") for c in ("c = 1", "c > 1"))
    return single.union(repeated.dropDuplicates(["o", "key"])).select(*back())


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts have no words and stay; rows that repeat stay or go together.
    """
    hit = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select("o", "key")
    others, back = numbered(docs)
    return docs.select(*others, row_order().alias("o"), row_key().alias("key")).join(hit, ["o", "key"], "left_anti").select(*back())


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; a null text is encoded as the empty one."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


STAGES = [("quality", quality_filter), ("line_dedup", line_filter), ("near_dedup", near_filter), ("decontamination", benchmark_filter), ("byte_bpe", bpe_encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written in the shared checkpoint folder and read again."""
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
