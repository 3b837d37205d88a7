"""Tracks' sessions as a stream with a watermark: late sightings still count for a while, gaps close a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late a sighting may come, and the longest gap within a session, in minutes.
LATE_MIN = 30
GAP_MIN = 25


def closed_sessions(sightings: DataFrame, late_min: int = LATE_MIN, gap_min: int = GAP_MIN) -> DataFrame:
    """(type, channel_no, first_seen, last_seen, n_reports) of the sessions that nothing can extend any more.

    ``sightings``: report_id, type, channel_no, observed_at. A sighting repeated within the watermark counts once, one older than the watermark
    is dropped, one without a time too. A gap of more than ``gap_min`` minutes closes a session; it comes out once the watermark has passed
    its last sighting by that gap, so what is still open at the end isn't there.
    """
    rows = sightings.where("observed_at is not null").withWatermark("observed_at", f"{late_min} minutes").dropDuplicatesWithinWatermark(["report_id"])
    # a session's end is not part of it, and a gap of exactly ``gap_min`` doesn't close it
    session = F.session_window("observed_at", f"{gap_min} minutes 1 microsecond")
    found = rows.groupBy(session.alias("session"), "type", "channel_no").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count("*").alias("n_reports"))
    return found.select("type", "channel_no", "first_seen", "last_seen", "n_reports")
