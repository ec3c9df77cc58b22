"""Distances, coarse cells and nearest places within a radius."""

from pyspark.sql import Column, DataFrame, functions as F


def haversine(a_lat, a_lon, b_lat, b_lon) -> Column:
    """Metres on a sphere of radius 6,371,000 m."""
    p, q = F.radians(a_lat), F.radians(b_lat)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(b_lon - a_lon) / 2), 2)
    return 2 * 6_371_000 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def valid(lat: str, lon: str) -> Column:
    """Whether both can be read as numbers in range."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return F.coalesce(number(lat).between(-90, 90) & number(lon).between(-180, 180), F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """A double as text with so many decimals, rounded by its exact binary value, halves to even.

    The product with the power of ten is taken with its rounding error (by a split of
    the double), which tells the side of an apparent tie.
    """
    power = float(10**digits)
    x = F.abs(value)
    big = x * 134_217_729.0
    high = big - (big - x)
    product = x * power
    error = (high * power - product) + (x - high) * power
    whole = F.floor(product)
    half = product - whole
    up = (half > 0.5) | ((half == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + up.cast("long")
    text = F.concat(F.floor(n / int(power)).cast("string"), F.lit("."), F.lpad((n % int(power)).cast("string"), digits, "0"))
    return F.concat(F.when((value < 0) & (n > 0), "-").otherwise(""), text)


def coarse(lat: Column, lon: Column) -> Column:
    """A cell of four decimals."""
    return F.concat_ws(",", fixed(lat, 4), fixed(lon, 4))


def nearest_within(points: DataFrame, point_id: str, places: DataFrame, place_id: str, cell_degrees: float) -> DataFrame:
    """Each point's nearest place whose own radius holds it; least id on ties.

    An equi-join on grid cells: a place goes to every cell that its radius can
    reach, across 180 degrees too, so no point meets all places.
    """
    around = max(1, int(360 / cell_degrees))
    reach_lat = F.col("radius_m") / 111_000.0
    reach_lon = reach_lat / F.greatest(F.cos(F.radians(F.least(F.abs("place_lat") + reach_lat, F.lit(89.0)))), F.lit(0.01))
    column = lambda lon: F.floor((lon + 180) * (around / 360))
    rows = F.sequence(F.floor((F.col("place_lat") - reach_lat) / cell_degrees), F.floor((F.col("place_lat") + reach_lat) / cell_degrees))
    first = column(F.col("place_lon") - reach_lon)
    columns = F.sequence(first, F.least(column(F.col("place_lon") + reach_lon), first + around - 1))
    cells = places.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(F.transform(columns, lambda x: F.pmod(x, F.lit(around)))))
    at = points.withColumn("cy", F.floor(F.col("lat") / cell_degrees)).withColumn("cx", F.pmod(column(F.col("lon")), F.lit(around)))
    d = haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    near = at.join(cells, ["cy", "cx"]).withColumn("d", d).where(F.col("d") <= F.col("radius_m"))
    return near.groupBy(point_id).agg(F.min(F.struct("d", place_id)).alias("best")).select(point_id, F.col(f"best.{place_id}").alias(place_id), F.col("best.d").alias("distance_m"))
