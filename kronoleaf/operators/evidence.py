"""Evidence links of events: counts, modality, previews, confidence and strength."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def counts(evidence: DataFrame, event: str, kinds: dict[str, Column]) -> DataFrame:
    """One conditional-count aggregate in place of a scalar subquery for each kind."""
    return evidence.groupBy(event).agg(F.count("*").alias("n_evidence"), *[F.count_if(c).alias(k) for k, c in kinds.items()])


def with_counts(events: DataFrame, evidence: DataFrame, event: str, kinds: dict[str, Column]) -> DataFrame:
    """Events with their counts; 0 where none."""
    got = counts(evidence, event, kinds)
    return events.join(got, event, "left").fillna(0, ["n_evidence", *kinds])


def modality(first: Column, second: Column, names: tuple[str, str]) -> Column:
    return F.when((first > 0) & (second > 0), "both").when(first > 0, names[0] + "_only").when(second > 0, names[1] + "_only").otherwise("none")


def preview(evidence: DataFrame, event: str, kind: str, order: list, most: int = 5) -> DataFrame:
    """At most so many rows of each kind of each event, with their rank."""
    w = Window.partitionBy(event, kind).orderBy(*order)
    return evidence.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def confidence(items: Column, both: Column, located: Column, place: Column, activity: Column, visual_only: Column) -> Column:
    """Hundredths of an event's confidence from its members, as a long."""
    score = (
        F.lit(35) + F.when(items >= 2, 12).otherwise(0) + F.when(items >= 5, 8).otherwise(0) + F.when(both, 15).otherwise(0)
        + F.when(located >= 1, 12).otherwise(0) + F.when(located >= 3, 4).otherwise(0) + F.when(place, 6).otherwise(0) + F.when(activity, 6).otherwise(0)
    )
    return F.when(visual_only, F.least(score, F.lit(74))).otherwise(F.least(score, F.lit(95))).cast("long")


#: Evidence kinds that together make strong or medium evidence.
STRONG = (("vlm", "ocr", "line", "event"), ("embedding", "vlm", "ocr", "event"), ("embedding", "vlm", "ocr", "line"))
MEDIUM = (("vlm", "event"), ("vlm", "line"), ("vlm", "ocr"), ("embedding", "vlm"), ("event", "photo"), ("line", "photo"))


def strength(kinds: Column, strong: tuple = STRONG, medium: tuple = MEDIUM) -> Column:
    """strong, medium or weak by which sets the kinds contain."""

    def holds(sets: tuple) -> Column:
        out = F.lit(False)
        for s in sets:
            out = out | (F.size(F.array_intersect(kinds, F.array(*map(F.lit, s)))) == len(s))
        return out

    return F.when(holds(strong), "strong").when(holds(medium), "medium").otherwise("weak")
