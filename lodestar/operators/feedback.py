"""Click memory: an append-only log whose weights decay by half every sixty days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 60.0
DAY = 86400.0


def decayed(ts: Column, now: float, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """What one click at ts is worth now; clicks of the future count as fresh."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (F.lit(now) - ts) / DAY) / half_life_days)


def click_weights(clicks: DataFrame, now: float, terms: list[str] | None = None) -> DataFrame:
    """(path, weight) of clicks(term, path, ts), of all terms or of the given ones."""
    asked = clicks if terms is None else clicks.where(F.col("term").isin(terms))
    return asked.groupBy("path").agg(F.sum(decayed(F.col("ts"), now)).alias("weight"))


def term_click_weights(clicks: DataFrame, now: float) -> DataFrame:
    """(term, path, weight): the memory by term."""
    return clicks.groupBy("term", "path").agg(F.sum(decayed(F.col("ts"), now)).alias("weight"))


def renamed_clicks(clicks: DataFrame, renames: DataFrame) -> DataFrame:
    """The log after renames(old_path, new_path, ts), one per path.

    A term's clicks of the old path before the rename go to the new one and replace what the same term had there
    before; terms that the old path didn't have keep their clicks at the new path.
    """
    log = clicks.withColumn("__n", F.monotonically_increasing_id())
    r = renames.select("old_path", "new_path", F.col("ts").alias("at"))
    moved = log.join(r, F.col("path") == F.col("old_path")).where("ts <= at")
    taken_over = moved.select("term", F.col("new_path").alias("path"), "at").distinct()
    replaced = log.join(taken_over, ["term", "path"]).where("ts <= at").select("__n")
    stay = log.join(moved.select("__n").union(replaced).distinct(), "__n", "left_anti")
    return stay.select("term", "path", "ts").union(moved.select("term", F.col("new_path").alias("path"), "ts"))
