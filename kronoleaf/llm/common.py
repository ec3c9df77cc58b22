"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST = -(2**63)


def ready(spark: SparkSession) -> None:
    """Take the shared checkpoint folder of the session; set one only where none is.

    On a cluster that is a folder of the warehouse, which executors share; a temporary
    folder serves a local session alone.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        local = context.master.startswith("local")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def buckets(spark: SparkSession) -> int:
    """How many groups packed rows are dealt over: as many as the session's shuffles have partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def whole_ids(documents: DataFrame) -> None:
    """Refuse ids of another type than whole numbers, where their order decides what is kept."""
    kind = documents.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be of a whole-number type, since its order decides what is kept; it is {kind.simpleString()}")


def row_order() -> Column:
    """doc_id as a long; null is the least."""
    return F.coalesce(F.col("doc_id").try_cast("long"), F.lit(LEAST))


def row_key() -> Column:
    """One key for equal (doc_id, text) rows, which all operators treat alike; joined together with `row_order`."""
    return F.xxhash64("doc_id", "text")


def numbered(df: DataFrame, *but: str) -> tuple[list[Column], Callable[..., list[Column]]]:
    """All columns except `but` under the names c0, c1, ..., so that an operator's own names clash with none;

    and a function that gives all columns of `df` back, in order and by name, with
    `but` taken from the columns of the names passed to it.
    """
    quoted = [f"`{c.replace('`', '``')}`" for c in df.columns]
    where = {c: f"c{i}" for i, c in enumerate(df.columns)}

    def back(*now: str) -> list[Column]:
        at = where | dict(zip(but, now, strict=True))
        return [F.col(at[c]).alias(c) for c in df.columns]

    return [F.col(q).alias(where[c]) for q, c in zip(quoted, df.columns, strict=True) if c not in but], back
