"""Queries of history, versions and regions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import q_proximity
from watchgrid.functions import geo
from watchgrid.functions.text import course_approach, course_stated
from watchgrid.operators import alerts, audience, history, proximity, regions
from watchgrid.sources.fixtures import view, with_views

NOW = "2024-01-15 12:00:00"
EARLIER = "2024-01-15 06:00:00"


def q_observation(spark, sf):
    return history.to_observation(view(spark, sf, "fx_reports")).withColumn("confidence", F.round("confidence", 6))


def q_alerts_diff(spark, sf):
    found = alerts.intervals(alerts.filled(view(spark, sf, "fx_alert_polls")))
    return history.state_diff(alerts.alerts_at(found, EARLIER), alerts.alerts_at(found, NOW))


def q_latest(spark, sf):
    return history.latest_version(view(spark, sf, "fx_captures"))


def q_page_gap(spark, sf):
    # an hour's reports stand for a capture of the channel
    r = view(spark, sf, "fx_reports")
    return history.page_gaps(r.select(F.col("channel_no").alias("channel"), F.date_trunc("hour", "observed_at").alias("capture"), F.col("report_id").alias("message_id")))


def q_hash(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha1("text").alias("content_hash"))


def q_events_after(spark, sf):
    return history.events_after(view(spark, sf, "fx_log"), 100, 1000)


def q_seq_range(spark, sf):
    return view(spark, sf, "fx_log").agg(F.min("seq").alias("oldest_seq"), F.coalesce(F.max("seq"), F.lit(0)).alias("latest_seq"))


def q_stale(spark, sf):
    age = proximity.age_min(NOW)
    return view(spark, sf, "fx_reports").select("report_id", F.when(age > 25, True).otherwise(False).alias("stale"))


def q_flips(spark, sf):
    hourly = view(spark, sf, "fx_reports").groupBy("channel_no", F.date_trunc("hour", "observed_at").alias("hour")).agg(F.count("*").alias("n"))
    return history.level_flips(hourly.withColumn("healthy", F.col("n") >= 2), "channel_no", "hour", "healthy").select("channel_no", "hour", "healthy")


def q_burst(spark, sf):
    return history.bursts(q_proximity(spark, sf))


def q_notifiable(spark, sf):
    return view(spark, sf, "fx_subscribers").where("is_active and lat is not null and lon is not null").select("subscriber_id", "radius_km")


def q_course_rates(spark, sf):
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("double")), 6)
    return view(spark, sf, "fx_reports").groupBy("type").agg(share("course_deg").alias("with_course"), share("from_lat").alias("with_origin"))


def q_report_rate(spark, sf):
    ten = F.window(F.col("observed_at").cast("timestamp"), "10 minutes")
    return view(spark, sf, "fx_reports").groupBy("type", ten.alias("w")).agg(F.count("*").alias("n_reports")).select("type", F.col("w.start").cast("timestamp_ntz").alias("from_at"), "n_reports")


def _people(spark, sf):
    return view(spark, sf, "fx_subscribers").select("subscriber_id", F.concat(F.lit("User"), F.col("subscriber_id").cast("string")).alias("name"))


def _allowed(spark, sf):
    entry = F.expr("CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 400 AS VARCHAR(20)) WHEN 1 THEN '@USER' || (o_orderkey % 700) WHEN 2 THEN ' user' || (o_orderkey % 90) || ' ' ELSE '@' END")
    return spark.read.parquet(f"{sf}/orders.parquet").select(entry.alias("entry"))


def q_removed(spark, sf):
    return audience.removed(_people(spark, sf), _allowed(spark, sf)).select("subscriber_id")


def q_audience(spark, sf):
    return audience.audience(_people(spark, sf), _allowed(spark, sf)).select("subscriber_id")


def q_origin_course(spark, sf):
    """The course of each report: from its origin to its place, else as stated, else away from where it comes from, else from the centre of
    the context's region to the place."""
    a = [F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")]
    line = F.expr("CASE report_id % 5 WHEN 0 THEN 'з півночі на Суми' WHEN 1 THEN 'курсом на захід' ELSE 'повз Суми' END")
    centre = geo.bearing(F.when(F.col("report_id") % 2 == 0, 50.9077), F.lit(34.7981), F.col("to_lat"), F.col("to_lon"))
    course = F.coalesce(geo.bearing(*a), course_stated(line), course_approach(line), centre)
    return view(spark, sf, "fx_reports").select("report_id", F.round(course, 6).alias("course"))


def rings(spark, sf):
    """A quadrilateral with ragged corners for each region."""
    corner = lambda y, x: f"named_struct('lat', lat0 + {y}, 'lon', lon0 + {x})"
    ring = f"array({corner('0.0e0', '0.0e0')}, {corner('0.1e0', '3.4e0')}, {corner('1.45e0', '3.5e0')}, {corner('1.3e0', '0.2e0')}) AS ring"
    return view(spark, sf, "fx_polygons").selectExpr("region", ring)


def q_in_region(spark, sf):
    points = view(spark, sf, "fx_places").select(F.col("place_id").alias("point_id"), "lat", "lon")
    return regions.point_in_region(points, rings(spark, sf))


def q_bbox(spark, sf):
    return regions.bbox(rings(spark, sf)).select("region", *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")])


def queries() -> dict:
    return {
        "to_observation": q_observation,
        "alerts_diff": q_alerts_diff,
        "latest_version": q_latest,
        "page_gap": q_page_gap,
        "content_hash": q_hash,
        "events_after": q_events_after,
        "oldest_latest_seq": q_seq_range,
        "is_stale": q_stale,
        "source_flips": q_flips,
        "cross_source_burst": q_burst,
        "cross_source_burst_both_ends": q_burst,
        "notifiable": q_notifiable,
        "course_rates": q_course_rates,
        "report_rate": q_report_rate,
        "removed_audience": q_removed,
        "audience": q_audience,
        "resolve_course": q_origin_course,
        "point_in_region": q_in_region,
        "bbox": q_bbox,
    }


_OBSERVED = """, o AS (
  SELECT report_id, observed_at, channel_no, type, n, course_deg, round(confidence, 6) AS confidence, relation <> 'launch' AND to_area AS area,
    CASE WHEN relation = 'over' AND NOT to_area THEN CASE type WHEN 'uav' THEN 180.0e0 WHEN 'jet_uav' THEN 600.0e0 WHEN 'cruise' THEN 800.0e0 WHEN 'recon' THEN 150.0e0 END END AS speed_kmh,
    CASE relation WHEN 'over' THEN 'position' WHEN 'towards' THEN 'destination' WHEN 'launch' THEN 'launch' END AS kind,
    CASE WHEN relation = 'launch' THEN from_lat ELSE to_lat END AS lat, CASE WHEN relation = 'launch' THEN from_lon ELSE to_lon END AS lon
  FROM fx_reports)
"""
_ALLOWED = """, al AS (SELECT DISTINCT lower(regexp_replace(trim(CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 400 AS VARCHAR) WHEN 1 THEN '@USER' || (o_orderkey % 700) WHEN 2 THEN ' user' || (o_orderkey % 90) || ' ' ELSE '@' END), '^@', '')) AS k FROM orders),
i AS (SELECT subscriber_id FROM fx_subscribers WHERE CAST(subscriber_id AS VARCHAR) IN (SELECT k FROM al) OR 'user' || subscriber_id IN (SELECT k FROM al))"""
_CORNERS = """, s AS (
  SELECT region, lat0 + a AS lat1, lon0 + b AS lon1, lat0 + c AS lat2, lon0 + d AS lon2 FROM fx_polygons, (VALUES
    (0.0e0, 0.0e0, 0.1e0, 3.4e0), (0.1e0, 3.4e0, 1.45e0, 3.5e0), (1.45e0, 3.5e0, 1.3e0, 0.2e0), (1.3e0, 0.2e0, 0.0e0, 0.0e0)) AS v(a, b, c, d))
"""


def oracle_sql() -> dict:
    from watchgrid.catalog import _BEARING_X, _BEARING_Y, _FILLED, oracle_sql as core

    open_at = "SELECT region, level FROM c WHERE level > 0 AND poll_at <= TIMESTAMP '{0}' AND (ended_at IS NULL OR ended_at > TIMESTAMP '{0}')"
    lines, both = core()["proximity"], core()["proximity_both_ends"]
    return {
        "to_observation": with_views(_OBSERVED + "SELECT * FROM o WHERE kind IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL", "fx_reports"),
        "alerts_diff": with_views(
            _FILLED + f"SELECT region, coalesce(x.level, 0) AS ends, coalesce(y.level, 0) AS starts FROM ({open_at.format(EARLIER)}) x FULL JOIN ({open_at.format(NOW)}) y USING (region) WHERE x.level IS DISTINCT FROM y.level", "fx_alert_polls"
        ),
        "latest_version": with_views(" SELECT channel, message_id, max(capture) AS capture, sha1(arg_max(text, capture)) AS content_hash FROM fx_captures GROUP BY channel, message_id", "fx_captures"),
        "page_gap": with_views(
            """, p AS (SELECT channel_no AS channel, date_trunc('hour', observed_at) AS capture, min(report_id) AS before, max(report_id) AS last FROM fx_reports GROUP BY 1, 2),
g AS (SELECT *, lag(last) OVER (PARTITION BY channel ORDER BY capture) AS after FROM p)
SELECT channel, capture, after, before FROM g WHERE after > 0 AND before > after + 1""",
            "fx_reports",
        ),
        "content_hash": "SELECT doc_id, sha1(text) AS content_hash FROM documents",
        "events_after": with_views(" SELECT * FROM fx_log WHERE seq > 100 ORDER BY seq LIMIT 1000", "fx_log"),
        "oldest_latest_seq": with_views(" SELECT min(seq) AS oldest_seq, coalesce(max(seq), 0) AS latest_seq FROM fx_log", "fx_log"),
        "is_stale": with_views(f" SELECT report_id, TIMESTAMP '{NOW}' - observed_at > INTERVAL 25 MINUTE AS stale FROM fx_reports", "fx_reports"),
        "source_flips": with_views(
            """, h AS (SELECT channel_no, date_trunc('hour', observed_at) AS hour, count(*) >= 2 AS healthy FROM fx_reports GROUP BY 1, 2),
l AS (SELECT *, lag(healthy) OVER (PARTITION BY channel_no ORDER BY hour) AS was FROM h)
SELECT channel_no, hour, healthy FROM l WHERE was <> healthy""",
            "fx_reports",
        ),
        "cross_source_burst": f"""SELECT subscriber_id, count(*) AS n_lines,
  string_agg(type || '|' || reason || '|' || n, ';' ORDER BY distance_km, type, reason, n) AS message, min(distance_km) AS nearest_km FROM ({lines}) GROUP BY subscriber_id""",
        "cross_source_burst_both_ends": f"""SELECT subscriber_id, count(*) AS n_lines,
  string_agg(type || '|' || reason || '|' || n, ';' ORDER BY distance_km, type, reason, n) AS message, min(distance_km) AS nearest_km FROM ({both}) GROUP BY subscriber_id""",
        "notifiable": with_views(" SELECT subscriber_id, radius_km FROM fx_subscribers WHERE is_active AND lat IS NOT NULL AND lon IS NOT NULL", "fx_subscribers"),
        "course_rates": with_views(" SELECT type, round(count(course_deg) / count(*), 6) AS with_course, round(count(from_lat) / count(*), 6) AS with_origin FROM fx_reports GROUP BY type", "fx_reports"),
        "report_rate": with_views(" SELECT type, time_bucket(INTERVAL 10 MINUTE, observed_at, TIMESTAMP '2024-01-01') AS from_at, count(*) AS n_reports FROM fx_reports GROUP BY 1, 2", "fx_reports"),
        "removed_audience": with_views(_ALLOWED + " SELECT subscriber_id FROM fx_subscribers WHERE subscriber_id NOT IN (SELECT subscriber_id FROM i)", "fx_subscribers"),
        "audience": with_views(_ALLOWED + " SELECT subscriber_id FROM i", "fx_subscribers"),
        "resolve_course": with_views(
            f""" SELECT report_id, round(coalesce(fmod(degrees(atan2({_BEARING_Y}, {_BEARING_X})) + 360, 360), CASE report_id % 5 WHEN 0 THEN 180.0e0 WHEN 1 THEN 270.0e0 END,
  CASE WHEN report_id % 2 = 0 THEN fmod(degrees(atan2(sin(radians(to_lon - 34.7981e0)) * cos(radians(to_lat)), cos(radians(50.9077e0)) * sin(radians(to_lat)) - sin(radians(50.9077e0)) * cos(radians(to_lat)) * cos(radians(to_lon - 34.7981e0)))) + 360, 360) END), 6) AS course FROM fx_reports""",
            "fx_reports",
        ),
        "point_in_region": with_views(
            _CORNERS
            + """, k AS (SELECT place_id AS point_id, region, sum(CASE WHEN (lat1 > lat) <> (lat2 > lat) AND lon < (lon2 - lon1) * (lat - lat1) / nullif(lat2 - lat1, 0) + lon1 THEN 1 ELSE 0 END) AS n
  FROM (SELECT place_id, lat, lon FROM fx_places), s GROUP BY 1, 2)
SELECT point_id, min(region) AS region FROM k WHERE n % 2 = 1 GROUP BY point_id""",
            "fx_places",
            "fx_polygons",
        ),
        "bbox": with_views(_CORNERS + "SELECT region, round(min(lat1), 6) AS south, round(max(lat1), 6) AS north, round(min(lon1), 6) AS west, round(max(lon1), 6) AS east FROM s GROUP BY region", "fx_polygons"),
    }
