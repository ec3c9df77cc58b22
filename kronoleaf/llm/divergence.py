"""How the sources of a language differ in their use of terms, counted in shards by DuckDB.

Each task counts the terms of its documents with DuckDB. The counts are hashed by
language and term into shards, where DuckDB sums them and keeps the terms of enough
documents. Spark sums the totals of groups and languages and joins them back as shares; in the
shards DuckDB then takes each group's leading terms and, for two sources that share terms,
the part of their sum that depends on both. The rest of a pair's sum depends on one
source's counts alone and comes from how often each count occurs. Spark merges sums and ranks.

A pair's sum over all kept terms, with f00 for a term that neither has, is
V*f00 + sum over s's terms of (f(p,t0)-f00) + sum over t's terms of (f(s0,p)-f00)
+ sum over shared terms of (f(p,p')-f(p,t0)-f(s0,p')+f00). All numbers are whole; since a group's
shares add up to 1e9 + V at most, each sum stays below 2 * (1e9 + V)**2, within a long while V is below a billion.

Shards follow the bytes of text, so that one is held in a task's memory. A term's rows in a
shard are one a source and counting task before they are summed, and the result itself has a row for each
two sources of a language.

Cases: null text, lang and source are ''; equal rows are documents of their own; a document
without terms still makes its group; without kept terms all pairs are 0; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .anchors import bucket_count
from .common import A_TO_Z, ready
from .textkit import chunks

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Rows of counts that a task holds before it sums or hands them on, and text bytes counted at once.
HELD_ROWS, AT_ONCE = 1_000_000, 8 << 20


def _engine(columns: str):
    """A DuckDB of the task with an empty table `held`."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
    con.execute(f"CREATE TABLE held ({columns})")
    return con


def _add(con, rows: pa.RecordBatch, sql: str) -> int:
    con.register("batch", pa.Table.from_batches([rows]))
    con.execute(f"INSERT INTO held {sql}")
    con.unregister("batch")
    return con.execute("SELECT count(*) FROM held").fetchall()[0][0]


def _out(con, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.execute(sql).to_arrow_reader(50_000)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d) of a task's documents: occurrences, and documents that have it."""
    con = _engine("lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, d BIGINT")
    sums = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM held GROUP BY ALL ORDER BY lang, term"
    words = f"SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}'), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS rid, * FROM batch)"
    each = f"SELECT any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n FROM ({words}) GROUP BY rid, term"
    for batch in batches:
        for part in chunks(batch, limit=AT_ONCE):
            if _add(con, part, f"SELECT lang, source, term, sum(n), count(*) FROM ({each}) GROUP BY ALL") > HELD_ROWS:
                yield from _out(con, sums)
                con.execute("TRUNCATE held")
    yield from _out(con, sums)


def keep_terms(kept_in: int):
    """(lang, source, term, n, nl, first) of a shard: counts of terms in enough documents, the language's, and one row a term marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine("lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, d BIGINT")
        least = 0
        for batch in batches:
            if _add(con, batch, "SELECT * FROM batch") > 2 * least + HELD_ROWS:
                con.execute("CREATE OR REPLACE TABLE held AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM held GROUP BY ALL")
                least = con.execute("SELECT count(*) FROM held").fetchall()[0][0]
        yield from _out(
            con,
            f"""WITH s AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d) AS d FROM held GROUP BY ALL),
            t AS (SELECT lang, term, sum(n)::BIGINT AS nl, min(source) AS one FROM s GROUP BY ALL HAVING sum(d) >= {kept_in})
            SELECT lang, source, term, n, nl, (source = one)::INTEGER AS first FROM s JOIN t USING (lang, term)""",
        )

    return run


def compare(top: int):
    """(part, lang, source, item, value) of a shard: leading terms of each group, and what two sources' shared terms add to their sum."""

    def f(p: str, q: str) -> str:
        return f"({p}-{q})*({p}-{q})//{q}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine("lang VARCHAR, source VARCHAR, term VARCHAR, p BIGINT, p0 BIGINT, q BIGINT")
        for batch in batches:
            _add(con, batch, "SELECT * FROM batch")
        yield from _out(con, f"SELECT 'term' AS part, lang, source, term AS item, {f('p', 'q')} AS value FROM held WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}")
        yield from _out(
            con,
            f"""SELECT 'pair' AS part, a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")} - {f("a.p", "b.p0")} - {f("a.p0", "b.p")} + {f("a.p0", "b.p0")})::BIGINT AS value
            FROM held a JOIN held b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL""",
        )

    return run


def share(n: Column, total: Column) -> Column:
    """1 + floor(1e9 * (n + 1) / total), exact."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + F.lit(1)), total.cast("decimal(19,0)"))


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q), exact."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(documents: DataFrame, kept_in: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others of its language, and its leading terms."""
    ready(documents.sparkSession)
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    shards = bucket_count(docs)
    counts = docs.mapInArrow(count_terms, "lang string, source string, term string, n long, d long")
    kept = counts.repartition(shards, "lang", "term").mapInArrow(keep_terms(kept_in), "lang string, source string, term string, n long, nl long, first int").checkpoint()

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v"))
    langs = sums.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("v").alias("v"))
    groups = docs.select("lang", "source").distinct().join(sums.drop("v"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["n", "n_lang", "v"]).withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n") + F.col("v")))).checkpoint()

    shares = kept.join(groups.withColumnRenamed("n", "total"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total") + F.col("v")).alias("p"), "p0", share(F.col("nl"), F.col("n_lang") + F.col("v")).alias("q")
    )
    found = shares.repartition(shards, "lang", "term").mapInArrow(compare(top), "part string, lang string, source string, item string, value long").checkpoint()

    terms = found.where("part = 'term'")
    alike = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    one = groups.select("lang", "source", F.col("p0").alias("s0"), "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("t0"))
    pairs = one.join(other, "lang").where("source != item")
    f00 = gain(F.col("s0"), F.col("t0"))
    parts = [
        pairs.select("lang", "source", "item", F.coalesce(F.col("v") * f00, F.lit(0)).alias("value")),
        pairs.join(alike, ["lang", "source"]).select("lang", "source", "item", (F.col("m") * (gain(F.col("p"), F.col("t0")) - f00)).alias("value")),
        pairs.join(alike.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("m") * (gain(F.col("s0"), F.col("p")) - f00)).alias("value")),
        found.where("part = 'pair'").select("lang", "source", "item", "value"),
    ]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select(F.lit("pair").alias("part"), "lang", "source", "item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = whole.withColumn("rank", F.row_number().over(by)).union(terms.select("part", "lang", "source", "item", "value").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
