"""Walks back through archived pages, and intervals open at many times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.session import cut


def backfill_pages(archive: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(messages, walks) of all channels, walked from the newest page backwards.

    ``archive``: channel, before (null for the newest page), message_id: what was served for the messages below an id. A channel goes on below the
    smallest id of its page, until a page is empty, has nothing below what was asked for, or was its ``most``th. ``messages``: channel,
    message_id, page (from 1, the first that had it). ``walks``: channel, pages, oldest_id, ended (end, stuck or limit). Every round goes on from a written frontier
    of one row a channel, whose ids only fall, so lineage stays bounded and rounds end. Rows of null channels or messages are left out; channels
    without a newest page have no walk.
    """
    rows = archive.where("channel is not null and message_id is not null").select("channel", "before", "message_id")
    pages = cut(rows.groupBy("channel", "before").agg(F.min("message_id").alias("low"))).withColumnRenamed("before", "asked")
    at = pages.where("asked is null").select("channel", "asked", "low", F.lit(1).alias("page"))
    walked = at = cut(at)
    for page in range(2, most + 1):
        falls = at.where("asked is null or low < asked").select("channel", F.col("low").alias("asked"))
        at = cut(falls.join(pages, ["channel", "asked"]).select("channel", "asked", "low", F.lit(page).alias("page")))
        if at.isEmpty():
            break
        walked = walked.union(at)
    asked = rows.withColumnRenamed("before", "asked")
    served = asked.alias("r").join(walked.alias("w"), F.expr("r.channel = w.channel and r.asked <=> w.asked"))
    messages = served.groupBy("r.channel", "r.message_id").agg(F.min("w.page").alias("page"))
    last = walked.groupBy("channel").agg(F.max("page").alias("pages"), F.min("low").alias("oldest_id"), F.max_by(F.struct("asked", "low"), "page").alias("x"))
    ended = F.when(F.col("x.asked").isNotNull() & (F.col("x.low") >= F.col("x.asked")), "stuck").when(F.col("pages") == most, "limit").otherwise("end")
    return messages, last.select("channel", "pages", "oldest_id", ended.alias("ended"))


def open_at(times: DataFrame, intervals: DataFrame, at: str = "at", start: str = "started_at", end: str = "ended_at", least: int = 60) -> DataFrame:
    """``times`` joined with the ``intervals`` that are open then: start <= at < end, a null end never comes.

    An interval lies in the few bins of the narrowest level that holds it in at most five; bins grow fourfold from level to level, from
    ``least`` seconds to centuries, so a time is looked up once a level that occurs. Both sides meet by (level, bin), no pair is tried beyond
    a shared bin. Repeated rows stay repeated; null times, null starts and intervals that end before they begin give nothing.
    Columns of both sides need names of their own.
    """
    second = lambda c: F.unix_seconds(c.cast("timestamp"))
    levels = range(16)
    width = lambda k: least * 4**k
    begin, until = second(F.col(start)), second(F.col(end))
    span = until - begin
    level = F.coalesce(*[F.when(span <= 4 * width(k), F.lit(k)) for k in levels[:-1]], F.lit(levels[-1]))
    wide = F.element_at(F.array(*[F.lit(width(k)) for k in levels]), F.col("_level") + 1)
    held = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))).withColumn("_level", level)
    # the widest bins span 2,000 years: one of them, or two, hold all times that an open interval may meet
    last = F.when(F.col(end).isNull(), F.floor(begin / wide) + 1).otherwise(F.floor(until / wide))
    held = held.withColumn("_bin", F.explode(F.sequence(F.floor(begin / wide), last)))
    used = sorted(r[0] for r in held.select("_level").distinct().collect())  # at most 16 numbers
    asked = times.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>")))
    asked = asked.withColumn("_bin", F.floor(second(F.col(at)) / wide))
    met = asked.join(held, ["_level", "_bin"]).where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(end) > F.col(at))))
    return met.drop("_level", "_bin")
