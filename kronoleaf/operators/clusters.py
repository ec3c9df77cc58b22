"""Vectors of texts, clusters of vectors and of places, and labels of coordinates."""

from __future__ import annotations

from math import atan2, cos as cos_, radians, sin, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import written
from .geo import fixed, haversine, valid
from .search import flag

DIMENSIONS = 384


def text_vectors(texts: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, index, value): hashed and signed counts of a text's grams of one to three characters, without blanks and
    in lower case, scaled to length 1. Only filled places are rows; a blank text has none."""
    flat = F.regexp_replace(F.lower(text), r"(?U)\s+", "")
    grams = lambda n: F.when(F.length("flat") >= n, F.transform(F.sequence(F.lit(1), F.length("flat") - n + 1), lambda i: F.substring("flat", i, n))).otherwise(F.array().cast("array<string>"))
    rows = texts.select(key, flat.alias("flat")).where("flat <> ''").select(key, F.explode(F.concat(*map(grams, (1, 2, 3)))).alias("gram"))
    counts = rows.groupBy(key, "gram").agg(F.count("*").alias("n"))
    digest = F.sha2("gram", 256)
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimensions
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = counts.groupBy(key, at.cast("int").alias("index")).agg(F.sum(sign * F.col("n")).alias("v")).where("v <> 0")
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v")).cast("double")).alias("norm"))
    return sums.join(norm, key).select(key, "index", (F.col("v") / F.col("norm")).alias("value"))


def unhashed(contents: DataFrame, existing: DataFrame, keys: list[str], text: str, model: str) -> DataFrame:
    """Texts to embed: not blank, and without a vector of the model for the same content; with the content's hash."""
    rows = contents.where(F.trim(text) != "").withColumn("content_hash", F.sha2(text, 256))
    return rows.join(existing.where(F.col("embedding_model") == model).select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")


def decoded(blob: Column, dimensions: Column) -> Column:
    """Floats of little-endian 32-bit bytes; null where the length does not fit the dimension."""

    @F.pandas_udf("array<float>")
    def read(blobs: pd.Series, dims: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, "<f4") if b is not None and d is not None and len(b) == 4 * d else None for b, d in zip(blobs, dims, strict=True)])

    return read(blob, dimensions)


def encoded(vector: Column) -> Column:
    """Little-endian 32-bit bytes of an array of floats."""

    @F.pandas_udf("binary")
    def write(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return write(vector)


def best_of_each(scores: DataFrame, key: str, kind: str, score: str) -> DataFrame:
    """(key, score, kind): each key's best score over kinds, cut to 0..1, and its kind; of equal scores that of the first kind."""
    cut = F.greatest(F.lit(0.0), F.least(F.col("b.score"), F.lit(1.0)))
    best = scores.groupBy(key).agg(F.min_by(F.struct(F.col(score).alias("score"), F.col(kind).alias("kind")), F.struct(-F.col(score), F.col(kind))).alias("b"))
    return best.select(key, cut.alias("score"), F.col("b.kind").alias("kind"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): each node with the least id reachable over edges (a, b). Labels spread to neighbours and then jump to their
    label's label, so long chains end in few rounds; each round is written in the checkpoint folder."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(nodes.select("id", F.col("id").alias("root")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.id == near.a, "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        jump = step.select(F.col("id").alias("low"), F.col("low").alias("far"))
        moved = written(step.join(jump, "low", "left").select("id", F.col("root").alias("was"), F.least("low", F.coalesce("far", "low")).alias("root")))
        labels = moved.select("id", "root")
        if moved.where("was <> root").isEmpty():
            return labels
    raise RuntimeError(f"components are still open after {rounds} rounds")


def vector_clusters(vectors: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(cluster, id, distance, confidence, is_representative): components of at least `least` members with their distances from the
    normalised mean. Vectors are `id` and `v` of length 1; means are taken place by place, never as gathered vectors."""
    placed = components(vectors.select("id"), edges).withColumnRenamed("root", "cluster")
    big = placed.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster")
    own = placed.join(big, "cluster").join(vectors, "id")
    cells = written(own.select("cluster", "id", F.posexplode("v").alias("i", "x")).withColumn("x", F.col("x").cast("double")))
    mean = cells.groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    norm = mean.groupBy("cluster").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    dots = cells.join(mean, ["cluster", "i"]).groupBy("cluster", "id").agg(F.sum(F.col("x") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("own"))
    far = dots.join(norm, "cluster").select("cluster", "id", F.round(1 - F.col("dot") / (F.col("own") * F.col("norm")), 6).alias("distance"))
    facts = far.groupBy("cluster").agg(F.min_by("id", F.struct("distance", "id")).alias("first"), F.round(F.greatest(F.lit(0.0), F.least(1 - F.avg("distance"), F.lit(1.0))), 4).alias("confidence"))
    return far.join(facts, "cluster").select("cluster", "id", "distance", "confidence", (F.col("id") == F.col("first")).alias("is_representative"))


def replaced_clusters(existing: DataFrame, made: DataFrame, method: str, linked: DataFrame) -> DataFrame:
    """The cluster table with a method's rows replaced; refused where people are linked with rows that would go."""
    gone = existing.where(F.col("method") == method)
    if not gone.join(linked.select(F.col("cluster_id").alias("id")), "id", "left_semi").isEmpty():
        raise ValueError("clusters that people are linked with cannot be replaced")
    return existing.where(F.col("method") != method).unionByName(made.withColumn("method", F.lit(method)).select(*existing.columns))


def location_points(media: DataFrame, privacy: str = "exact_private") -> DataFrame:
    """A point of each medium with valid coordinates and a time."""
    at = F.coalesce("captured_at", "fallback_captured_at")
    return media.where(valid("gps_lat", "gps_lon") & (at != "")).select(F.concat(F.lit("lp_media_"), "id").alias("id"), F.col("id").alias("media_id"), at.alias("captured_at"), F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"), F.lit(privacy).alias("privacy_level"))


def columns_around(height: float, highest: float) -> int:
    """Grid columns around the globe, each as wide as `height` degrees of latitude at least, as far as `highest` reaches; one at the poles."""
    if highest + height >= 89.9:
        return 1
    return max(1, int(360 * float(np.cos(np.radians(highest + height))) / height))


def islands(points: DataFrame, metres: float) -> DataFrame:
    """Points with `island`: components of occupied grid cells that touch, across 180 degrees too. Cells are twice `metres` wide at
    least, so points of different islands are more than that apart."""
    lat = 2 * metres / 111_000
    highest = points.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    around = columns_around(lat, highest)
    column = lambda x: F.pmod(x, F.lit(around))
    at = points.withColumn("cy", F.floor(F.col("lat") / lat)).withColumn("cx", column(F.floor((F.col("lon") + 180) * (around / 360)))).withColumn("cell", F.concat_ws(":", "cy", "cx"))
    cells = written(at.select("cell", "cy", "cx").distinct())
    step = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    near = cells.select("cell", "cy", "cx", step.alias("s")).select(F.col("cell").alias("a"), F.concat_ws(":", F.col("cy") + F.col("s.y"), column(F.col("cx") + F.col("s.x"))).alias("b"))
    edges = near.join(cells.select(F.col("cell").alias("b")), "b", "left_semi")
    roots = components(cells.select(F.col("cell").alias("id")), edges).select(F.col("id").alias("cell"), F.col("root").alias("island"))
    return at.join(roots, "cell").drop("cell", "cy", "cx")


class Centres:
    """Running centres on a grid of cells as wide as the radius: a point looks at its own and the eight cells around."""

    def __init__(self, metres: float, highest: float):
        self.metres, self.high = metres, metres / 111_000
        self.around = columns_around(self.high, highest)
        self.lat, self.lon, self.n, self.cells = [], [], [], {}

    def _cell(self, lat: float, lon: float) -> tuple[int, int]:
        return int(np.floor(lat / self.high)), int((lon + 180) / 360 * self.around) % self.around

    def add(self, lat: float, lon: float) -> int:
        """The nearest centre within the radius, the first of equals, or a new one; it moves to the mean of its points."""
        y, x = self._cell(lat, lon)
        best, at = self.metres, None
        p, cos = radians(lat), cos_(radians(lat))
        for row in (y - 1, y, y + 1):
            for column in {(x - 1) % self.around, x, (x + 1) % self.around}:
                for k in self.cells.get((row, column), ()):
                    q = radians(self.lat[k])
                    h = sin((q - p) / 2) ** 2 + cos * cos_(q) * sin(radians(self.lon[k] - lon) / 2) ** 2
                    far = 2 * 6_371_000 * atan2(sqrt(h), sqrt(1 - h))
                    if far < best or far == best and (at is None or k < at):
                        best, at = far, k
        if at is None:
            at = len(self.n)
            self.lat.append(lat)
            self.lon.append(lon)
            self.n.append(1)
            self.cells.setdefault((y, x), []).append(at)
            return at
        old = self._cell(self.lat[at], self.lon[at])
        self.n[at] += 1
        self.lat[at] += (lat - self.lat[at]) / self.n[at]
        turn = (lon - self.lon[at] + 180) % 360 - 180 if abs(lon - self.lon[at]) > 180 else lon - self.lon[at]
        moved = self.lon[at] + turn / self.n[at]
        self.lon[at] = (moved + 180) % 360 - 180 if abs(moved) > 180 else moved
        new = self._cell(self.lat[at], self.lon[at])
        if new != old:
            self.cells[old].remove(at)
            self.cells.setdefault(new, []).append(at)
        return at


def leader_clusters(points: DataFrame, metres: float) -> DataFrame:
    """(id, leader): in order of time and id each point joins the nearest centre within `metres`, or starts a cluster named by itself;
    centres are running means, of longitudes the short way round.

    A point joins a centre only where it lies within twice the distance of that cluster's
    latest member, so islands of points further apart than that are folded independently;
    the fold of one island depends on order and cannot be split, but takes time near its number of points,
    since a point is compared with the centres of nine cells only.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["captured_at", "id"])
        centres, leaders, out = Centres(metres, float(pdf.lat.abs().max())), [], []
        for i, y, x in zip(pdf.id, pdf.lat, pdf.lon, strict=True):
            k = centres.add(float(y), float(x))
            if k == len(leaders):
                leaders.append(i)
            out.append(leaders[k])
        return pd.DataFrame({"id": pdf.id, "leader": out})

    kind = dict(points.dtypes)["id"]
    return islands(points.select("id", "captured_at", "lat", "lon"), metres).groupBy("island").applyInPandas(fold, f"id {kind}, leader {kind}")


def place_clusters(points: DataFrame, metres: float = 100.0, least: int = 3) -> DataFrame:
    """Leader clusters of at least `least` points: centroid, radius, counts and times, numbered by size, then first time."""
    rows = points.join(leader_clusters(points, metres), "id")
    got = rows.groupBy("leader").agg(F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), F.count("*").alias("point_count"), F.count_distinct("media_id").alias("photo_count"), F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at")).where(F.col("point_count") >= max(1, least))
    far = rows.join(got.select("leader", "centroid_lat", "centroid_lon"), "leader").withColumn("d", haversine(F.col("lat"), F.col("lon"), F.col("centroid_lat"), F.col("centroid_lon")))
    radius = far.groupBy("leader").agg(F.greatest(F.lit(float(metres)), F.max("d") + 10).alias("radius_m"))
    order = Window.orderBy(F.desc("point_count"), "first_seen_at", "leader")
    return got.join(radius, "leader").withColumn("cluster_id", F.format_string("place_cluster_%03d", F.row_number().over(order)))


def place_candidates(points: DataFrame, metres: float = 500.0, least: int = 5) -> DataFrame:
    """Leader clusters as places to be named: centre, a radius rounded up to 50 metres, and days, numbered by size."""
    rows = points.join(leader_clusters(points, metres), "id")
    got = rows.groupBy("leader").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("photo_count"), F.min(F.substring("captured_at", 1, 10)).alias("date_start"), F.max(F.substring("captured_at", 1, 10)).alias("date_end")).where(F.col("photo_count") >= max(1, least))
    far = rows.select("id", "leader", F.col("lat").alias("y"), F.col("lon").alias("x")).join(got.select("leader", "lat", "lon"), "leader").groupBy("leader").agg(F.max(haversine(F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))).alias("d"))
    radius = F.greatest(F.lit(float(metres)), F.ceil((F.col("d") + 50) / 50) * 50.0)
    order = Window.orderBy(F.desc("photo_count"), "leader")
    return got.join(far, "leader").select(F.format_string("candidate_place_%03d", F.row_number().over(order)).alias("cluster_id"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "photo_count", F.round(radius, 1).alias("radius_m"), "date_start", "date_end")


def coordinate_label(lat: Column, lon: Column, privacy: Column, exact: bool) -> Column:
    """Hidden for sensitive places unless exact positions are shown; six decimals then, three otherwise."""
    digits = 6 if exact else 3
    one = lambda c: F.when(c.isNull(), "unknown").otherwise(fixed(c, digits))
    label = F.concat_ws(", ", one(lat), one(lon))
    return label if exact else F.when(privacy == "sensitive", "非表示").otherwise(label)


def cluster_listing(clusters: DataFrame, places: DataFrame, *, status: str | None = None, named: bool | None = None, least: int = 0) -> DataFrame:
    """Clusters with the place made of them; by status, by whether they are named, and by size, the largest first."""
    p = places.select("cluster_id", F.col("id").alias("place_id"), "display_name", flag("hidden").alias("hidden"))
    rows = clusters.join(p, "cluster_id", "left").where(F.col("point_count") >= least)
    rows = rows if status is None else rows.where(F.col("status") == status)
    rows = rows if named is None else rows.where(F.col("place_id").isNotNull() == F.lit(named))
    return rows.orderBy(F.desc("point_count"), "cluster_id")
