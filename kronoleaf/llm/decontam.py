"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

The shingles are windows of `size` consecutive words of an item (an item of fewer
words is one window). A window's words are ordered by rarity over all documents;
because containment must be whole, a document that holds the window holds its
rarest word, so one prefix word a window is joined. Length and position bounds (the
window must fit around that word in the document) come next, then the exact
comparison with the item-sized slice of the document, inside the join's condition.
Words are joined by their full lower-case form, which is coarser than that of A-Z
and much cheaper; the exact comparison lower-cases A-Z only and joins the slice with
blanks, which no word holds, so that the join stays in generated code and a
document's array of words is never copied for each of its words.

Distinct windows up to `broadcast_windows` (counted first) are broadcast and the
texts never move. Beyond that, words in the set of prefix words are shuffled with
the slice around them.

Defined cases: null has no words; items without words have no window; repeated
doc_ids count as one document in `hits`; repeated items and windows count once;
null doc_ids hit like any other; items with a null item_id hit too, but are not
among a document's `items`, which may so be empty; a very long text is exploded to its
words row by row; empty tables give no hits; only item_id, doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, ready, row_key, row_order

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def pieces(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, with an empty piece beside a gap at either end."""
    return F.split(F.coalesce(text, F.lit("")), GAP, -1)


def word_count(text: Column) -> Column:
    """The number of words, from the text as it stands."""
    w = pieces(text)
    return (F.size(w) - (F.element_at(w, 1) == "").cast("int") - ((F.element_at(w, -1) == "") & (F.size(w) > 1)).cast("int")).cast("long")


def word_array(text: Column) -> Column:
    """Lower-cased (A-Z) words without empty pieces."""
    return F.filter(pieces(ascii_lower(text)), lambda w: w != "")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, id, window): the distinct windows of each item; id is a digest of the window."""
    words = benchmark.select(F.col("item_id").alias("item"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    at = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(size)).alias("window"))
    return at.select("item", F.md5(F.array_join("window", " ")).alias("id"), "window").distinct()


def hits(documents: DataFrame, held: DataFrame, size: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """(o, key, at, n, id): every occurrence of a window of `held`, by row and word position from 1."""
    windows = held.select("id", "window").dropDuplicates(["id"]).checkpoint()
    small = windows.count() <= broadcast_windows
    hint = F.broadcast if small else lambda df: df
    vocabulary = windows.select(F.explode("window").alias("word")).select(F.lower("word").alias("word")).distinct()
    texts = documents.select(row_order().alias("o"), row_key().alias("key"), pieces(F.col("text")).alias("w"))
    counts = documents.select(F.explode(pieces(F.lower("text"))).alias("word")).join(hint(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    ranked = vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    placed = windows.select("id", F.posexplode("window").alias("off", "word")).withColumn("word", F.lower("word")).join(ranked, "word")
    rarest = placed.groupBy("id").agg(F.min(F.struct("n", "word", "off")).alias("r"))
    prefixes = windows.join(rarest, "id").select(F.col("r.word").alias("word"), F.col("r.off").alias("off"), F.array_join("window", " ").alias("window"), "id", F.size("window").alias("n"))
    prefixes = prefixes.checkpoint()
    spread = texts.select("o", "key", "w", F.posexplode("w").alias("p", "word")).withColumn("word", F.lower("word"))
    if small:
        d, q = spread.alias("d"), F.broadcast(prefixes).alias("q")
        start = F.col("d.p") - F.col("q.off")
        fits = (start >= 0) & (start + F.col("q.n") <= F.size("d.w"))
        same = ascii_lower(F.array_join(F.slice("d.w", F.when(fits, start + 1).otherwise(1), F.col("q.n")), " ")) == F.col("q.window")
        return d.join(q, (F.col("d.word") == F.col("q.word")) & fits & same).select("d.o", "d.key", (start + 1).alias("at"), F.col("q.n").alias("n"), "q.id")
    wanted = prefixes.select("word").distinct()
    near = F.slice("w", F.greatest(F.col("p") - size + 2, F.lit(1)), F.lit(2 * size - 1))
    d = spread.join(wanted, "word", "left_semi").select("o", "key", "word", "p", near.alias("near"), F.least(F.col("p"), F.lit(size - 1)).alias("left")).alias("d")
    q = prefixes.alias("q")
    start = F.col("d.left") - F.col("q.off")
    fits = (start >= 0) & (start + F.col("q.n") <= F.size("d.near"))
    same = ascii_lower(F.array_join(F.slice("d.near", F.when(fits, start + 1).otherwise(1), F.col("q.n")), " ")) == F.col("q.window")
    return d.join(q, (F.col("d.word") == F.col("q.word")) & fits & same).select("d.o", "d.key", (F.col("d.p") - F.col("q.off") + 1).alias("at"), F.col("q.n").alias("n"), "q.id")


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """(o, key, n_hit, items) of documents with a hit; o is `row_order()` and key `row_key()`.

    Occurrences are written once. A document's are merged as intervals, so a long
    document's hits are never expanded to words; items meet distinct windows only.
    """
    ready(documents.sparkSession)
    held = item_windows(benchmark, size).checkpoint()
    found = hits(documents, held, size, broadcast_windows).distinct().checkpoint()
    order = Window.partitionBy("o", "key").orderBy("at", "n")
    reach = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("at") + F.col("n") - F.greatest(F.col("at"), F.coalesce(reach, F.lit(0))), F.lit(0))
    covered = found.withColumn("fresh", fresh).groupBy("o", "key").agg(F.sum("fresh").alias("n_hit"))
    met = found.select("o", "key", "id").distinct().join(held.where("item is not null").select("id", F.col("item").cast("string").alias("item")), "id")
    items = met.groupBy("o", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return covered.join(items, ["o", "key"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
