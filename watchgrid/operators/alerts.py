"""Alert states as transitions and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filled(polls: DataFrame) -> DataFrame:
    """A region missing from an accepted poll has level 0 there."""
    regions = F.broadcast(polls.select("region").distinct().agg(F.collect_set("region").alias("all")))  # bounded: regions of a country
    grid = polls.select("poll_at").distinct().join(regions).select("poll_at", F.explode("all").alias("region"))
    return grid.join(polls, ["poll_at", "region"], "left").select("poll_at", "region", F.coalesce("level", F.lit(0)).alias("level"))


def transitions(states: DataFrame) -> DataFrame:
    """Rows whose level differs from the region's poll before; the first sight is silent."""
    by = Window.partitionBy("region").orderBy("poll_at")
    return states.withColumn("before", F.lag("level").over(by)).where("before <> level").select("region", "poll_at", "before", "level")


def intervals(states: DataFrame) -> DataFrame:
    """(region, level, started_at, ended_at): runs of one level above 0; ended_at is null while open."""
    by = Window.partitionBy("region").orderBy("poll_at")
    change = states.withColumn("before", F.lag("level").over(by)).where("before is null or before <> level")
    return change.withColumn("ended_at", F.lead("poll_at").over(by)).where("level > 0").select("region", "level", F.col("poll_at").alias("started_at"), "ended_at")


def alerts_at(found: DataFrame, at: str) -> DataFrame:
    """Intervals open at a time, given as open."""
    t = F.lit(at).cast("timestamp_ntz")
    return found.where((F.col("started_at") <= t) & (F.col("ended_at").isNull() | (F.col("ended_at") > t))).select("region", "level", "started_at")
