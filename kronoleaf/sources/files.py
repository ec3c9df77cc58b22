"""Files as tables: images, missing files, dictionaries, and sinks of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Endings of the images that are read.
ENDINGS = r"(?i)\.(jpg|jpeg|png)$"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, length, modified) of all files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), "length", F.col("modificationTime").alias("modified"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(id, file_path, file_name, file_hash, fallback_captured_at) of all images, ids and hashes by content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.rlike("path", F.lit(ENDINGS)))
    digest = F.sha2("content", 256)
    return rows.select(F.concat(F.lit("media_"), digest).alias("id"), F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), digest.alias("file_hash"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("fallback_captured_at"))


def missing(rows: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows whose file is not in a listing."""
    return rows.where(F.col(column).isNotNull()).join(files.select(F.col("file_path").alias(column)).distinct(), column, "left_anti")


def marked_missing(rows: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows with `is_missing` by a listing."""
    there = files.select(F.col("file_path").alias(column)).distinct().withColumn("there", F.lit(True))
    return rows.join(there, column, "left").withColumn("is_missing", F.col(column).isNotNull() & F.col("there").isNull()).drop("there")


def dictionary(spark: SparkSession, text: str, key: str, schema: str) -> DataFrame:
    """The records of a YAML dictionary, which is configuration and small; fields that are missing are null."""
    import yaml

    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in yaml.safe_load(text)[key]], schema)


def write_report(rows: DataFrame, path: str, form: str = "json") -> None:
    """Rows as JSON lines, CSV with a header, or Parquet."""
    writer = rows.write.mode("overwrite")
    (writer.option("header", "true") if form == "csv" else writer).format(form).save(path)
