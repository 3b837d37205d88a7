"""States at a time, differences between times, versions, cursors and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.operators.proximity import speed_kmh


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# What a relation's place means.
def point_kind(relation: Column) -> Column:
    """What a report's coordinate means; null where it drops out."""
    return F.when(relation.isin("over", "past", "through"), "position").when(relation == "towards", "destination").when(relation == "launch", "launch")


def to_observation(reports: DataFrame) -> DataFrame:
    """Reports as points: a launch is where it came from, all else where it is or goes; without a point a report drops out. A speed is
    given only to positions that aren't areas, of types that are projected."""
    kind = point_kind(F.col("relation"))
    launch = kind == "launch"
    lat, lon = (F.when(launch, F.col(f"from_{x}")).otherwise(F.col(f"to_{x}")) for x in ("lat", "lon"))
    area = ~launch & F.col("to_area")
    found = reports.select("report_id", "observed_at", "channel_no", "type", "n", kind.alias("kind"), area.alias("area"), lat.alias("lat"), lon.alias("lon"), "course_deg", "confidence")
    speed = F.when((F.col("kind") == "position") & ~F.col("area"), speed_kmh(F.col("type")))
    return found.where("kind is not null and lat is not null and lon is not null").withColumn("speed_kmh", speed)


def tracks_at(points: DataFrame, when: str, tail_min: int = 60) -> DataFrame:
    """One row a track seen in the ``tail_min`` minutes up to a time: first, last, latest point and path.

    ``points``: track_id, report_id, observed_at, kind, lat, lon. The path of a track is bounded by the tail, not by the table.
    """
    t = at(when)
    seen = points.where((F.col("observed_at") <= t) & (F.col("observed_at") > t - F.expr(f"interval {tail_min} minutes")))
    path = F.array_sort(F.collect_list(F.struct("observed_at", "report_id")))
    last = F.max_by(F.struct("kind", "lat", "lon"), F.struct("observed_at", "report_id"))
    found = seen.groupBy("track_id").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), last.alias("x"), path.alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["report_id"].cast("string")), ",")
    return found.select("track_id", "first_seen", "last_seen", F.col("x.kind").alias("last_kind"), F.round("x.lat", 6).alias("lat"), F.round("x.lon", 6).alias("lon"), text.alias("path"))


def state_diff(open_: DataFrame, wanted: DataFrame) -> DataFrame:
    """(region, ends, starts): equal levels are kept and left out, 0 is no alert; one full outer join on the region."""
    one, two = open_.select("region", F.col("level").alias("ends")), wanted.select("region", F.col("level").alias("starts"))
    return one.join(two, "region", "full").fillna(0, ["ends", "starts"]).where("ends <> starts")


def latest_version(captures: DataFrame) -> DataFrame:
    """The newest capture of each message; combined before the shuffle, so many versions of one message cost a row a task."""
    newest = F.max_by(F.struct("capture", F.sha1("text").alias("content_hash")), "capture")
    return captures.groupBy("channel", "message_id").agg(newest.alias("x")).select("channel", "message_id", F.col("x.capture").alias("capture"), F.col("x.content_hash").alias("content_hash"))


def channel_cursor(captures: DataFrame) -> DataFrame:
    """Newest and oldest message of each channel, and how many it has."""
    return captures.groupBy("channel").agg(F.max("message_id").alias("last_id"), F.min("message_id").alias("oldest_id"), F.count_distinct("message_id").alias("n_messages"))


def page_gaps(captures: DataFrame) -> DataFrame:
    """A capture of a channel that begins after the last one's end and one more: (channel, capture, after, before)."""
    pages = captures.groupBy("channel", "capture").agg(F.min("message_id").alias("before"), F.max("message_id").alias("last"))
    after = F.lag("last").over(Window.partitionBy("channel").orderBy("capture"))
    return pages.withColumn("after", after).where("after > 0 and before > after + 1").select("channel", "capture", "after", "before")


def events_after(log: DataFrame, seq: int, limit: int) -> DataFrame:
    """The next ``limit`` changes after ``seq``; the limit is the page a consumer asks for."""
    return log.where(F.col("seq") > seq).orderBy("seq").limit(limit)


def level_flips(seen: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """Rows whose flag differs from the row before of the same key; nothing for the first."""
    before = F.lag(flag).over(Window.partitionBy(by).orderBy(order))
    return seen.withColumn("was", before).where(f"was <> {flag}")


def bursts(matches: DataFrame) -> DataFrame:
    """One message a subscriber: its lines by distance. Lines were deduplicated, so they are bounded by types and reasons."""
    line = F.concat_ws("|", "type", "reason", F.col("n").cast("string"))
    lines = F.sort_array(F.collect_list(F.struct("distance_km", "type", "reason", "n", line.alias("line"))))
    by = matches.groupBy("subscriber_id").agg(lines.alias("lines"), F.min("distance_km").alias("nearest_km"))
    return by.select("subscriber_id", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines.line", ";").alias("message"), "nearest_km")
