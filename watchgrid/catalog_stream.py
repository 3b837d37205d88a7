"""Queries that run a stream over a table's files to its end, with SQL of the same state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.session import shared_folder
from watchgrid.operators import live
from watchgrid.sources.fixtures import view, with_views
from watchgrid.streaming import ingest, outbox, sessions, state
from watchgrid.streaming.live import CHANGES, live_changes


def _source(spark, sf: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _result(frame: DataFrame) -> DataFrame:
    """All that a stream of appended rows gives, written and read again."""
    spark = frame.sparkSession
    at = _folder(spark)
    frame.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{at}/out")


def q_ingest(spark, sf):
    d = _source(spark, sf, "documents").where("doc_id is not null")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    captures = d.select(F.col("source").alias("channel"), F.col("doc_id").alias("message_id"), at.alias("captured_at"), "text")
    store = _folder(spark)
    ingest.ingest(captures, store, f"{store}-checkpoint").awaitTermination()
    return ingest.version(spark, store).select("channel", "message_id", "content_hash", "parse_state")


def _polls(spark, sf):
    level = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return _source(spark, sf, "events").select((F.col("user_id") % 25).alias("region"), F.col("ts").cast("timestamp").alias("poll_at"), level.alias("level"))


def _plain(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def q_transitions(spark, sf):
    return _plain(_result(state.alert_transitions(_polls(spark, sf))), "poll_at")


def q_intervals(spark, sf):
    return _plain(_result(state.alert_intervals(_polls(spark, sf))), "started_at", "ended_at")


def q_edits(spark, sf):
    """Captures in three runs of one stream: first sights, then edits and repeats, then texts from before that came late."""
    d = view(spark, sf, "fx_first_captures")
    at = _folder(spark)
    later = F.when(F.col("message_id") % 5 == 0, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text"))
    day = F.make_dt_interval(days=F.lit(1))
    portions = [
        d,
        d.where("message_id % 5 = 0 or message_id % 3 = 1").withColumns({"text": later, "captured_at": F.col("captured_at") + day}),
        d.where("message_id % 7 = 0").withColumns({"text": F.concat(F.lit("old "), "text"), "captured_at": F.col("captured_at") - day}),
    ]
    for k, rows in enumerate(portions):
        rows.write.parquet(f"{at}/in/{k}")
        source = spark.readStream.schema(d.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        ingest.ingest(source, f"{at}/store", f"{at}/checkpoint").awaitTermination()
    return ingest.version(spark, f"{at}/store").select("channel", "message_id", "content_hash", "parse_state")


def _changes(spark, sf) -> DataFrame:
    return view(spark, sf, "fx_changes").withColumns({c: F.col(c).cast("timestamp") for c in ("at", "seen")})


def q_live(spark, sf):
    """A snapshot at number 1,000 and all changes after it."""
    log = _changes(spark, sf)
    return _plain(live.live(live.live(None, log.where("seq <= 1000")), log, 1000), "at", "seen")


def q_live_stream(spark, sf):
    """The same state by streams of three runs: thirds of the log, each with changes of the third before, late or repeated; tracks
    expire, alerts and sources don't. The last step is the view that readers get: what expires now isn't shown."""
    log, at = _changes(spark, sf), _folder(spark)
    third = F.floor(F.col("seq") * 3 / (F.lit(log.agg(F.max("seq")).first()[0] or 0) + 1))
    for k in range(3):
        late = F.col("seq") % 11 == 0
        log.where(((third == k) & ~late) | ((third == k - 1) & (late | (F.col("seq") % 7 == 0))) | (F.lit(k == 2) & (third == 2))).write.parquet(f"{at}/in/{k}")
        source = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        for name, rows, minutes in (("tracks", source.where("kind = 'track'"), live.HISTORY_MIN), ("others", source.where("kind <> 'track'"), None)):
            frame = live_changes(rows, minutes)
            frame.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(CHANGES).parquet(f"{at}/tracks").union(spark.read.schema(CHANGES).parquet(f"{at}/others"))
    now = F.broadcast(log.agg(F.max("at").alias("now")))
    state_ = live.pruned(live.newest(out).where("not gone").crossJoin(now), F.col("now")).drop("gone", "now")
    return _plain(state_, "at", "seen")


def direct(rows: pd.DataFrame) -> pd.Series:
    """A channel that refuses every fourth reader."""
    return rows["subscriber_id"] % 4 != 0


def browser(rows: pd.DataFrame) -> pd.Series:
    """A channel that only every third reader has."""
    return rows["subscriber_id"] % 3 == 0


#: Passes of the outbox query, four minutes apart in its faster time.
PASSES = 6


def _outbox(spark, sf):
    """Lines in six runs of one stream, by time; the table's time runs much faster, so that the repeat time matters."""
    d, at = view(spark, sf, "fx_lines").withColumn("at", F.col("at").cast("timestamp")), _folder(spark)
    for k in range(PASSES):
        d.where(F.col("pass") == k).drop("pass").write.parquet(f"{at}/in/{k}")
        source = spark.readStream.schema(d.drop("pass").schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        outbox.notify(source, {"direct": direct, "browser": browser}, f"{at}/store", f"{at}/checkpoint").awaitTermination()
    return f"{at}/store"


def q_deliveries(spark, sf):
    """What became of each line: suppressed, sent, or failed on all channels."""
    return outbox.verdicts(spark, _outbox(spark, sf)).select("line_id", "subscriber_id", "batch", "verdict")


def q_passes(spark, sf):
    return outbox.passes(spark, _outbox(spark, sf))


def q_late(spark, sf):
    """Sessions by a stream of three runs: the earlier half of the time, but for some sightings just before its end, then these, the later half and repeats,
    then sightings that are days late."""
    r = view(spark, sf, "fx_reports").select("report_id", "type", "channel_no", F.col("observed_at").cast("timestamp").alias("observed_at"))
    at, half = _folder(spark), F.lit("2024-01-16 00:00:00").cast("timestamp")
    early = F.col("observed_at") <= half
    just = early & (F.col("observed_at") > half - F.expr("interval 25 minutes")) & (F.col("report_id") % 3 == 0)
    old = (F.col("observed_at") < half - F.expr("interval 1 day")) & (F.col("report_id") % 11 == 0)
    portions = [r.where(early & ~just & ~old), r.where(just | ~early).union(r.where(early & ~old & (F.col("observed_at") > half - F.expr("interval 10 minutes")))), r.where(old)]
    for k, rows in enumerate(portions):
        rows.write.parquet(f"{at}/in/{k}")
        source = spark.readStream.schema(r.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        frame = sessions.closed_sessions(source)
        frame.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _plain(spark.read.schema(frame.schema).parquet(f"{at}/out"), "first_seen", "last_seen")


def _passes_sql() -> str:
    """Pass after pass: what the ledger says before it, what is said already, what is taken, what the ledger says then."""
    out = ", g0 AS MATERIALIZED (SELECT 0::BIGINT AS subscriber_id, '' AS subject, TIMESTAMP '1970-01-01' AS said_at, 0.0e0 AS km WHERE false)"
    for k in range(PASSES):
        out += f""", n{k} AS MATERIALIZED (SELECT max("at") AS now FROM fx_lines WHERE pass = {k}),
v{k} AS MATERIALIZED (SELECT l.*, now, CASE WHEN coalesce(epoch_us(now) - epoch_us(said_at) < 300000000 OR (epoch_us(now) - epoch_us(said_at) < 1200000000 AND NOT CASE WHEN g.km <= 0 THEN l.distance_km > 0 ELSE abs(l.distance_km - g.km) / g.km >= 0.25e0 END), false) THEN 'suppressed'
  WHEN l.subscriber_id % 4 <> 0 OR l.subscriber_id % 3 = 0 THEN 'sent' ELSE 'failed' END AS verdict FROM fx_lines l, n{k} LEFT JOIN g{k} g ON g.subscriber_id = l.subscriber_id AND g.subject = l.subject WHERE pass = {k}),
t{k} AS MATERIALIZED (SELECT subscriber_id, subject, max(now) AS said_at, arg_max(distance_km, (distance_km, line_id)) AS km FROM v{k} WHERE verdict = 'sent' GROUP BY 1, 2),
g{k + 1} AS MATERIALIZED (SELECT * FROM t{k} UNION ALL SELECT * FROM g{k} g WHERE NOT EXISTS (SELECT 1 FROM t{k} t WHERE t.subscriber_id = g.subscriber_id AND t.subject = g.subject))"""
    every = " UNION ALL ".join(f"SELECT line_id, subscriber_id, pass AS batch, verdict FROM v{k}" for k in range(PASSES))
    return f"{out}, every AS ({every})"


def queries() -> dict:
    return {"sink_deliveries": q_deliveries, "notify_passes": q_passes, "late_data": q_late, "stream_ingest_edits": q_edits, "live_snapshot": q_live, "live_state_stream": q_live_stream, "stream_ingest": q_ingest, "alert_transitions_stream": q_transitions, "alert_intervals_stream": q_intervals}


_POLLS = """WITH p AS (SELECT user_id % 25 AS region, ts AS poll_at, max(CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) AS level FROM events GROUP BY user_id % 25, ts),
b AS (SELECT *, lag(level) OVER (PARTITION BY region ORDER BY poll_at) AS before FROM p),
c AS (SELECT *, lead(poll_at) OVER (PARTITION BY region ORDER BY poll_at) AS ended_at FROM b WHERE before IS NULL OR before <> level)
"""


def oracle_sql() -> dict:
    state_ = with_views(
        """, l AS (SELECT kind, id, max(seq) AS seq, arg_max("at", seq) AS "at", arg_max(seen, seq) AS seen, arg_max(gone, seq) AS gone, arg_max(value, seq) AS value FROM fx_changes GROUP BY kind, id)
SELECT kind, id, seq, "at", seen, value FROM l WHERE NOT gone AND (kind <> 'track' OR seen >= (SELECT max("at") FROM fx_changes) - INTERVAL 180 MINUTE)""",
        "fx_changes",
    )
    return {
        "stream_ingest_edits": with_views(" SELECT channel, message_id, sha1(CASE WHEN message_id % 5 = 0 THEN text || ' (edited)' ELSE text END) AS content_hash, 'pending' AS parse_state FROM fx_first_captures", "fx_first_captures"),
        "sink_deliveries": with_views(_passes_sql() + " SELECT * FROM every", "fx_lines"),
        "notify_passes": with_views(_passes_sql() + " SELECT batch, count(*) AS scanned, count(*) FILTER (WHERE verdict = 'sent') AS sent, count(DISTINCT subscriber_id) FILTER (WHERE verdict <> 'suppressed') AS recipients FROM every GROUP BY batch", "fx_lines"),
        "late_data": with_views(
            """, r AS (SELECT report_id, type, channel_no, observed_at FROM fx_reports WHERE NOT (observed_at < TIMESTAMP '2024-01-15' AND report_id % 11 = 0)),
l AS (SELECT *, lag(observed_at) OVER w AS before FROM r WINDOW w AS (PARTITION BY type, channel_no ORDER BY observed_at, report_id)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR observed_at - before > INTERVAL 25 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY type, channel_no ORDER BY observed_at, report_id) AS session FROM l)
SELECT type, channel_no, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS n_reports FROM s GROUP BY type, channel_no, session
HAVING max(observed_at) + INTERVAL 25 MINUTE < (SELECT max(observed_at) FROM r) - INTERVAL 30 MINUTE""",
            "fx_reports",
        ),
        "live_snapshot": state_,
        "live_state_stream": state_,
        "stream_ingest": "SELECT source AS channel, doc_id AS message_id, sha1(text) AS content_hash, 'pending' AS parse_state FROM documents WHERE doc_id IS NOT NULL",
        "alert_transitions_stream": _POLLS + "SELECT region, poll_at, before, level FROM b WHERE before <> level",
        "alert_intervals_stream": _POLLS + "SELECT region, level, poll_at AS started_at, ended_at FROM c WHERE level > 0 AND ended_at IS NOT NULL",
    }
