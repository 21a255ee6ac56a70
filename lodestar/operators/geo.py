"""Reverse geocoding: the nearest place within fifty kilometres by a join on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_words

# Reach, size of the earth, and words of place names that say nothing.
MAX_KM, EARTH_KM = 50.0, 6371.0
FILLER = "state of county region province district municipality governorate city the and".split()
#: Kilometres of a degree of latitude, rounded down, and the widest search in cells to either side.
DEGREE_KM, WIDEST = 111.0, 25


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def nearest_place(photos: DataFrame, places: DataFrame, max_km: float = MAX_KM) -> DataFrame:
    """photos(id, lat, lon) with city, state, code and km of the nearest of places, nulls if none is in reach.

    Each photo asks for the one-degree cells in reach (more of them towards the poles, around the date line) and
    meets their places by equality. Equally near places: the last by (lat, lon, city) counts. Photos without a
    position have no place. Photos that repeat an id need different positions.
    """
    # the nearest point of a great circle lies a little poleward, hence the latitude at the edge of reach
    edge = F.least(F.abs("lat") + max_km / DEGREE_KM, F.lit(89.0))
    reach = F.least(F.ceil(F.lit(max_km / DEGREE_KM) / F.cos(F.radians(edge))), F.lit(WIDEST)).cast("int")
    row, col = F.floor("lat").cast("int"), F.floor("lon").cast("int")
    wrapped = lambda c: F.pmod(c + 180, F.lit(360)) - 180
    asked = photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", "lat", "lon", F.explode(F.sequence(row - 1, row + 1)).alias("row"), reach.alias("reach"), col.alias("col"))
    asked = asked.select("id", "lat", "lon", "row", F.explode(F.array_distinct(F.transform(F.sequence(F.col("col") - F.col("reach"), F.col("col") + F.col("reach")), wrapped))).alias("col"))
    listed = places.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"), "city", "state", "code", F.floor("lat").cast("int").alias("row"), wrapped(F.floor("lon").cast("int")).alias("col"))
    met = asked.join(listed, ["row", "col"]).withColumn("km", distance_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("km") <= max_km)
    best = met.groupBy("id", "lat", "lon").agg(F.max_by(F.struct("city", "state", "code", "km"), F.struct(-F.col("km"), "plat", "plon", "city")).alias("p"))
    out = photos.join(best, ["id", "lat", "lon"], "left")
    return out.select(*photos.columns, "p.city", "p.state", "p.code", "p.km")


def place_words(found: DataFrame, countries: DataFrame) -> DataFrame:
    """Append country and words: the distinct words of city, state and country without fillers."""
    named = found.join(countries.select("code", F.col("name").alias("country")), "code", "left").withColumn("country", F.coalesce("country", F.lit("")))
    parts = [split_words(F.col(c)) for c in ("city", "state", "country")]
    return named.withColumn("words", F.array_except(F.array_distinct(F.concat(*parts)), F.array(*[F.lit(w) for w in FILLER])))


def photo_words(taken: Column, words: Column) -> Column:
    """Place words with the year and the English month of the photo."""
    when = F.timestamp_seconds(taken)
    dated = F.when(taken.isNotNull(), F.array(F.date_format(when, "yyyy"), F.lower(F.date_format(when, "MMMM")))).otherwise(F.array().cast("array<string>"))
    return F.array_union(F.coalesce(words, F.array().cast("array<string>")), dated)
