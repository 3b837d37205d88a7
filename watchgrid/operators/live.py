"""The live state: what a snapshot and the changes after it add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.operators.records import seq_gaps

#: How far back the live map reaches.
HISTORY_MIN = 180
COLUMNS = ["kind", "id", "seq", "at", "seen", "gone", "value"]


def changes(events: DataFrame) -> DataFrame:
    """Changes of entities (``COLUMNS``) from events: type, seq, at, id, seen, ended, new_id, value.

    A started alert that has ended, an ended alert and a revised track without a ``new_id`` are gone; a track revised into another one
    is two changes. Any other type changes nothing.
    """
    alert, track, source = F.col("type").isin("alert.started", "alert.ended"), F.col("type").isin("track.observed", "track.revised"), F.col("type") == "source.status"
    kind = F.when(alert, "alert").when(track, "track").when(source, "source")
    revised = F.col("type") == "track.revised"
    gone = (F.col("type") == "alert.ended") | ((F.col("type") == "alert.started") & F.coalesce("ended", F.lit(False))) | (revised & F.col("new_id").isNull())
    same = F.struct(F.when(revised, F.coalesce("new_id", "id")).otherwise(F.col("id")).alias("id"), gone.alias("gone"))
    moved = F.struct(F.col("id"), F.lit(True).alias("gone"))
    rows = events.withColumn("kind", kind).where("kind is not null")
    each = F.when(revised & (F.col("new_id") != F.col("id")), F.array(same, moved)).otherwise(F.array(same))
    return rows.withColumn("x", F.explode(each)).select("kind", "x.id", "seq", "at", "seen", "x.gone", "value")


def head(log: DataFrame, base: int) -> DataFrame:
    """One row, ``head``: the last number that follows ``base`` without a gap (``base`` if the next one is missing)."""
    seqs = log.where(F.col("seq") > base).select("seq").union(log.sparkSession.range(base, base + 1).select(F.col("id").alias("seq")))
    gap = seq_gaps(seqs).agg(F.min("after").alias("after"))
    return seqs.agg(F.max("seq").alias("last")).crossJoin(F.broadcast(gap)).select(F.coalesce("after", "last").alias("head"))


def pruned(state: DataFrame, now, history_min: int = HISTORY_MIN) -> DataFrame:
    """``state`` without tracks last seen more than ``history_min`` minutes before ``now`` (a column or a literal)."""
    return state.where((F.col("kind") != "track") | (F.col("seen") >= now - F.make_dt_interval(mins=F.lit(history_min))))


def newest(rows: DataFrame) -> DataFrame:
    """The last change of each entity; of repeated ones of a number, one that is gone wins."""
    last = F.max_by(F.struct("seq", "at", "seen", "gone", "value"), F.struct("seq", "gone"))
    return rows.groupBy("kind", "id").agg(last.alias("x")).select("kind", "id", "x.*")


def live(snapshot: DataFrame | None, log: DataFrame, base: int = 0, history_min: int = HISTORY_MIN) -> DataFrame:
    """State (``COLUMNS`` but gone) after ``snapshot``, taken at number ``base``, and the changes in ``log`` up to the first gap in numbers.

    Changes at or before ``base`` and repeated ones change nothing. Now is the time of the newest change that counts. A gap must be
    closed by whoever reads the log; what follows it isn't applied. Empty tables give an empty state. Rows with a null number are left out.
    """
    later = log.where(F.col("seq") > base).crossJoin(F.broadcast(head(log, base))).where("seq <= head").select(*COLUMNS)
    rows = later if snapshot is None else later.union(snapshot.withColumn("gone", F.lit(False)).select(*COLUMNS))
    now = F.broadcast(rows.agg(F.max("at").alias("now")))
    return pruned(newest(rows).where("not gone").crossJoin(now), F.col("now"), history_min).drop("gone", "now")
