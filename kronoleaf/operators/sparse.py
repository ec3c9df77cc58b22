"""Nearest sparse vectors by an inverted index with bounds, exact.

Vectors are rows (key, index, value). Each place's list has a largest and a least value, which bound what the place can
add to a query's product. A first pass scores the rows of each query's strongest lists and gives a sure lower
limit for its k-th best. With it, the lists of a query are put in the order of their bounds; the last ones, whose bounds
sum to less than the limit, can bring no row into the best by themselves and are not opened. Rows from the
opened lists are scored in full only if their sum so far and the bound of the rest reach the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import written

SPARE = 1e-9


def bounded(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, index, q, bound, place, rest): the places of each query by falling bound, and what those after may add."""
    lists = index.groupBy("index").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    rows = queries.join(lists, "index").withColumn("bound", F.greatest(F.lit(0.0), F.col("q") * F.col("hi"), F.col("q") * F.col("lo")))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "index")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    return rows.select("query", "index", "q", "bound", F.row_number().over(order).alias("place"), F.coalesce(F.sum("bound").over(after), F.lit(0.0)).alias("rest"))


def full_scores(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, key, score) of (query, key) pairs, over all their places."""
    both = pairs.join(queries, "query").join(index, ["key", "index"], "left")
    return both.groupBy("query", "key").agg(F.sum(F.coalesce(F.col("q") * F.col("value"), F.lit(0.0))).alias("score"))


def top(queries: DataFrame, index: DataFrame, k: int, seeds: int = 2, counted: list | None = None) -> DataFrame:
    """(query, key, score, rank) of the `k` best keys of each query; ties go to the least key.

    `queries` is (query, index, q), `index` (key, index, value), each with a row for each filled place. A
    query with fewer than k keys of a positive score returns those alone. `counted`, if given, gets the number of pairs scored in full.
    """
    places = written(bounded(queries, index))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    seed = places.where(F.col("place") <= seeds).join(index, "index").groupBy("query", "key").agg(F.sum(F.col("q") * F.col("value")).alias("score"))
    seed = seed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query", "key")
    limit = full_scores(seed, queries, index).withColumn("r", F.row_number().over(order)).groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("limit"))
    limit = written(limit.select("query", F.greatest(F.coalesce("limit", F.lit(0.0)), F.lit(0.0)).alias("limit")))
    limited = places.join(limit, "query", "left").fillna(0.0, ["limit"])
    # A place is opened unless it and all after it sum to less than the limit.
    opened = limited.where(F.col("bound") + F.col("rest") >= F.col("limit") - SPARE).where("bound > 0")
    left = opened.groupBy("query").agg(F.min("rest").alias("unopened"), F.first("limit").alias("limit"))
    partial = opened.select("query", "index", "q").join(index, "index").groupBy("query", "key").agg(F.sum(F.col("q") * F.col("value")).alias("partial"))
    pairs = written(partial.join(left, "query").where(F.col("partial") + F.col("unopened") >= F.col("limit") - SPARE).select("query", "key"))
    if counted is not None:
        counted.append(pairs.count())
    scores = full_scores(pairs, queries, index).withColumn("score", F.round("score", 9)).where("score > 0")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def semantic_search(questions: DataFrame, question: str, sources: DataFrame, source: str, text: str, k: int) -> DataFrame:
    """(question, source, score, rank): the `k` rows of `sources` whose texts are nearest to each question's, ties by the least source.

    `questions` has its id and `query_text`. Equal texts have one vector: contents are searched,
    and each one found stands for its first k rows. Blank texts take no part.
    """
    from .clusters import text_vectors

    hashed = lambda df, column: df.where(F.trim(column) != "").withColumn("content", F.sha2(column, 256))
    own, asked = hashed(sources.select(source, text), text), hashed(questions.select(question, "query_text"), "query_text")
    # A content goes by its least source, so that equal scores are ordered as their rows are.
    contents = own.groupBy("content").agg(F.min(source).alias("key"), F.min(text).alias("t"))
    index = written(text_vectors(contents, "key", "t"))
    wanted = written(text_vectors(asked.groupBy(F.col("content").alias("query")).agg(F.min("query_text").alias("t")), "query", "t").withColumnRenamed("value", "q"))
    best = top(wanted, index, k)
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("content").orderBy(source))).where(F.col("place") <= k)
    rows = asked.select(question, F.col("content").alias("query")).join(best.select("query", "key", "score"), "query")
    rows = rows.join(contents.select("key", "content"), "key").join(first.select("content", source), "content")
    order = Window.partitionBy(question).orderBy(F.desc("score"), source)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(question, source, "score", "rank")
