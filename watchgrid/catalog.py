"""All queries of the report and alert operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.functions import geo
from watchgrid.operators import alerts, proximity, records
from watchgrid.sources.fixtures import view, with_views

NOW = "2024-01-15 12:00:00"

_DISTANCE = "2 * 6371.0e0 * asin(sqrt(least(1.0e0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def _km(lat1, lon1, lat2, lon2):
    return _DISTANCE.format(a=lat1, b=lat2, c=lon1, d=lon2)


def q_proximity(spark, sf):
    return proximity.proximity_lines(view(spark, sf, "fx_reports"), view(spark, sf, "fx_subscribers"), NOW)


def q_matches(spark, sf):
    return proximity.proximity(view(spark, sf, "fx_reports"), view(spark, sf, "fx_subscribers"), NOW, digits=6)


def q_actionable(spark, sf):
    return proximity.actionable(view(spark, sf, "fx_reports"), NOW).select("report_id", "type", "n", "relation")


def q_geo(spark, sf):
    r = view(spark, sf, "fx_reports").where("from_lat is not null")
    a = [F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")]
    turn = geo.angle_diff(geo.bearing(*a), F.col("course_deg"))
    return r.select("report_id", F.round(geo.distance_km(*a), 6).alias("distance_km"), F.round(geo.bearing(*a), 6).alias("bearing"), F.round(turn, 6).alias("turn"))


def q_forecast(spark, sf):
    """10, 20 and 30 minutes after the report; none for stale reports, areas and what is no position."""
    speed = proximity.speed_kmh(F.col("type"))
    r = view(spark, sf, "fx_reports").where(proximity.recent(NOW, 25) & F.col("relation").isin("over", "past", "through") & ~F.col("to_area") & F.col("course_deg").isNotNull() & (speed > 0))
    r = r.withColumn("minutes", F.explode(F.array(*map(F.lit, (10, 20, 30)))))
    lat, lon = geo.destination(F.col("to_lat"), F.col("to_lon"), F.col("course_deg"), speed * F.col("minutes") / 60)
    return r.select("report_id", "minutes", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def q_transitions(spark, sf):
    return alerts.transitions(alerts.filled(view(spark, sf, "fx_alert_polls")))


def q_intervals(spark, sf):
    return alerts.intervals(alerts.filled(view(spark, sf, "fx_alert_polls")))


def q_alerts_at(spark, sf):
    return alerts.alerts_at(q_intervals(spark, sf), NOW)


def q_rank(spark, sf):
    return records.candidate_rank(view(spark, sf, "fx_places")).where("pick = 1").select("name", "region", "place_id", "rank", "confidence")


def _mentions(places):
    # one letter dropped from every fifth name
    mention = F.when(F.col("place_id") % 5 == 0, F.expr("concat(substr(name, 1, 3), substr(name, 5))")).otherwise(F.col("name"))
    return places.select(F.col("place_id").alias("mention_id"), mention.alias("mention"), "region")


def q_fuzzy_lexicon(spark, sf):
    places = view(spark, sf, "fx_places")
    return records.place_fuzzy(_mentions(places), places)


def q_ingest(spark, sf):
    c = view(spark, sf, "fx_captures")
    return records.ingest(c.where("capture = 1"), c.where("capture = 2"))


def q_gaps(spark, sf):
    return records.seq_gaps(view(spark, sf, "fx_log"))


def q_live(spark, sf):
    return records.live_state(view(spark, sf, "fx_log"))


def q_sessions(spark, sf):
    return records.sessions(view(spark, sf, "fx_reports"))


def q_source_health(spark, sf):
    """Enabled channels and whether their last success is at most two hours old."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("user_id % 5 <> 0")
    at = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    last = e.groupBy((F.col("user_id") % 20).alias("channel")).agg(F.max(F.when((F.col("event_type") != "error") & (F.col("ts") <= at), F.col("ts"))).alias("last_success"))
    return last.withColumn("healthy", F.coalesce(F.col("last_success") >= at - F.expr("interval 2 hours"), F.lit(False)))


def q_coverage(spark, sf):
    """Reports of each type and of all (type null), and how many have what."""
    r = view(spark, sf, "fx_reports")
    low = F.sum((F.col("confidence") < 0.6).cast("long")).alias("n_low")
    return r.rollup("type").agg(F.count("*").alias("n_reports"), low, F.count("course_deg").alias("n_course"), F.count("from_lat").alias("n_origin"))


def queries() -> dict:
    return {
        "proximity": q_proximity,
        "proximity_matches": q_matches,
        "proximity_both_ends": q_proximity,
        "proximity_both_ends_matches": q_matches,
        "report_actionable": q_actionable,
        "geo_columns": q_geo,
        "forecast": q_forecast,
        "alert_transitions": q_transitions,
        "alert_intervals": q_intervals,
        "alerts_at": q_alerts_at,
        "candidate_rank": q_rank,
        "place_fuzzy": q_fuzzy_lexicon,
        "place_fuzzy_lexicon": q_fuzzy_lexicon,
        "ingest_upsert": q_ingest,
        "seq_gaps": q_gaps,
        "live_state": q_live,
        "track_sessions": q_sessions,
        "source_health": q_source_health,
        "parse_coverage": q_coverage,
    }


_SPEED = "CASE type WHEN 'uav' THEN 180.0e0 WHEN 'jet_uav' THEN 600.0e0 WHEN 'cruise' THEN 800.0e0 WHEN 'recon' THEN 150.0e0 END"
_ACTIONABLE = f"""
a AS (SELECT *, epoch_us(TIMESTAMP '{NOW}') / 6e7 - epoch_us(observed_at) / 6e7 AS age, {_SPEED} AS speed FROM fx_reports
  WHERE confidence >= 0.6e0 AND NOT to_area AND (to_lat IS NOT NULL OR from_lat IS NOT NULL) AND observed_at <= TIMESTAMP '{NOW}' AND observed_at >= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE)"""
_TYPICAL = "CASE type WHEN 'uav' THEN 180.0e0 WHEN 'jet_uav' THEN 600.0e0 WHEN 'cruise' THEN 800.0e0 WHEN 'recon' THEN 150.0e0 WHEN 'ballistic' THEN 3000.0e0 WHEN 'kab' THEN 700.0e0 WHEN 'aviation' THEN 800.0e0 ELSE 200.0e0 END"
_MATCHES = f""", {_ACTIONABLE},
d AS (
  SELECT *, {_TYPICAL} AS typical, CASE WHEN to_lat IS NOT NULL THEN {_km('to_lat', 'to_lon', 'lat', 'lon')} END AS to_km,
    CASE WHEN from_lat IS NOT NULL THEN {_km('from_lat', 'from_lon', 'lat', 'lon')} END AS from_km,
    (to_lon - lon) * 111.32e0 * cos(radians(lat)) AS px, (to_lat - lat) * 110.57e0 AS py, radians(course_deg) AS h,
    fmod(degrees(atan2(sin(radians(lon - from_lon)) * cos(radians(lat)), cos(radians(from_lat)) * sin(radians(lat)) - sin(radians(from_lat)) * cos(radians(lat)) * cos(radians(lon - from_lon)))) + 360, 360) AS br
  FROM a, fx_subscribers WHERE is_active AND lat IS NOT NULL AND lon IS NOT NULL),
e AS (SELECT *, coalesce(to_km, from_km) AS distance_km, coalesce(from_km, to_km) AS target_km, abs(px * cos(h) - py * sin(h)) AS side,
    -(px * sin(h) + py * cos(h)) / speed * 60 - age AS eta FROM d),
m AS (
  SELECT *, CASE WHEN least(distance_km, target_km) <= radius_km THEN 'in_radius'
      WHEN relation IN ('over', 'past', 'through') AND to_lat IS NOT NULL AND age <= 25 AND eta >= 0 AND eta <= 30 AND side <= radius_km THEN 'approaching'
      WHEN from_lat IS NOT NULL AND least(abs(br - course_deg), 360 - abs(br - course_deg)) <= 30 AND target_km <= typical * 25 / 60 + radius_km THEN 'heading_towards' END AS reason
  FROM e)
"""
_LINES = """SELECT subscriber_id, type, reason, max(n) AS n, arg_min(report_id, (distance_km, report_id)) AS report_id, round(min(distance_km), 6) AS distance_km
FROM m WHERE reason IS NOT NULL GROUP BY subscriber_id, type, reason"""
_PAIRS = """SELECT subscriber_id, report_id, type, n, reason, round(distance_km, 6) AS distance_km, round(target_km, 6) AS target_km,
  round(CASE reason WHEN 'approaching' THEN eta WHEN 'heading_towards' THEN target_km / typical * 60 END, 6) AS eta_min, round(CASE WHEN reason = 'approaching' THEN side END, 6) AS closest_km
FROM m WHERE reason IS NOT NULL"""
_FILLED = """, g AS (
  SELECT poll_at, region, coalesce(level, 0) AS level
  FROM (SELECT DISTINCT poll_at FROM fx_alert_polls) CROSS JOIN (SELECT DISTINCT region FROM fx_alert_polls) LEFT JOIN fx_alert_polls USING (poll_at, region)),
b AS (SELECT *, lag(level) OVER (PARTITION BY region ORDER BY poll_at) AS before FROM g),
c AS (SELECT *, lead(poll_at) OVER (PARTITION BY region ORDER BY poll_at) AS ended_at FROM b WHERE before IS NULL OR before <> level)
"""
_BEARING_Y = "sin(radians(to_lon - from_lon)) * cos(radians(to_lat))"
_BEARING_X = "cos(radians(from_lat)) * sin(radians(to_lat)) - sin(radians(from_lat)) * cos(radians(to_lat)) * cos(radians(to_lon - from_lon))"


def oracle_sql() -> dict:
    return {
        "proximity": with_views(_MATCHES + _LINES, "fx_reports", "fx_subscribers"),
        "proximity_both_ends": with_views(_MATCHES + _LINES, "fx_reports", "fx_subscribers"),
        "proximity_matches": with_views(_MATCHES + _PAIRS, "fx_reports", "fx_subscribers"),
        "proximity_both_ends_matches": with_views(_MATCHES + _PAIRS, "fx_reports", "fx_subscribers"),
        "report_actionable": with_views(f", {_ACTIONABLE} SELECT report_id, type, n, relation FROM a", "fx_reports"),
        "geo_columns": with_views(
            f""", x AS (SELECT *, {_km('from_lat', 'from_lon', 'to_lat', 'to_lon')} AS d, fmod(degrees(atan2({_BEARING_Y}, {_BEARING_X})) + 360, 360) AS br FROM fx_reports WHERE from_lat IS NOT NULL)
SELECT report_id, round(d, 6) AS distance_km, round(br, 6) AS bearing, round(least(abs(br - course_deg), 360 - abs(br - course_deg)), 6) AS turn FROM x""",
            "fx_reports",
        ),
        "forecast": with_views(
            f""", x AS (SELECT report_id, minutes, {_SPEED} * minutes / 60 / 6371.0e0 AS d, radians(course_deg) AS b, radians(to_lat) AS p, to_lon
  FROM fx_reports, (VALUES (10), (20), (30)) AS v(minutes)
  WHERE course_deg IS NOT NULL AND {_SPEED} IS NOT NULL AND relation IN ('over', 'past', 'through') AND NOT to_area AND observed_at <= TIMESTAMP '{NOW}' AND observed_at >= TIMESTAMP '{NOW}' - INTERVAL 25 MINUTE),
y AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS t FROM x)
SELECT report_id, minutes, round(degrees(t), 6) AS lat,
  round(fmod(to_lon + degrees(atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(t))) + 540, 360) - 180, 6) AS lon FROM y""",
            "fx_reports",
        ),
        "alert_transitions": with_views(_FILLED + "SELECT region, poll_at, before, level FROM b WHERE before <> level", "fx_alert_polls"),
        "alert_intervals": with_views(_FILLED + "SELECT region, level, poll_at AS started_at, ended_at FROM c WHERE level > 0", "fx_alert_polls"),
        "alerts_at": with_views(_FILLED + f"SELECT region, level, poll_at AS started_at FROM c WHERE level > 0 AND poll_at <= TIMESTAMP '{NOW}' AND (ended_at IS NULL OR ended_at > TIMESTAMP '{NOW}')", "fx_alert_polls"),
        "candidate_rank": with_views(
            """, r AS (SELECT *, CASE place WHEN 'city' THEN 4 WHEN 'town' THEN 3 WHEN 'village' THEN 2 ELSE 1 END * 10000000 + population AS rank FROM fx_places),
n AS (SELECT *, row_number() OVER (PARTITION BY name, region ORDER BY rank DESC, place_id) AS pick, count(*) OVER (PARTITION BY name, region) AS k FROM r)
SELECT name, region, place_id, rank, CASE WHEN k = 1 THEN 1.0e0 WHEN k <= 3 THEN 0.8e0 ELSE 0.6e0 END AS confidence FROM n WHERE pick = 1""",
            "fx_places",
        ),
        "place_fuzzy": with_views(
            """, m AS (SELECT place_id AS mention_id, CASE WHEN place_id % 5 = 0 THEN substr(name, 1, 3) || substr(name, 5) ELSE name END AS mention, region FROM fx_places),
s AS (SELECT mention, name, levenshtein(mention, name) AS d FROM (SELECT DISTINCT mention FROM m WHERE length(mention) >= 5), (SELECT DISTINCT name FROM fx_places) WHERE mention[1] = name[1]),
b AS (SELECT mention, min(d) AS d FROM s GROUP BY mention HAVING min(d) = 1),
c AS (SELECT mention_id, d, p.place_id, count(*) OVER (PARTITION BY mention_id) AS k, row_number() OVER (PARTITION BY mention_id ORDER BY
    CASE place WHEN 'city' THEN 4 WHEN 'town' THEN 3 WHEN 'village' THEN 2 ELSE 1 END * 10000000 + population DESC, p.place_id) AS pick
  FROM m JOIN b USING (mention) JOIN s USING (mention, d) JOIN fx_places p ON p.name = s.name AND p.region = m.region)
SELECT mention_id, d::INT AS d, place_id, round(CASE WHEN k = 1 THEN 1.0e0 WHEN k <= 3 THEN 0.8e0 ELSE 0.6e0 END * 0.7e0, 6) AS confidence FROM c WHERE pick = 1""",
            "fx_places",
        ),
        "place_fuzzy_lexicon": with_views(
            """, m AS (SELECT place_id AS mention_id, CASE WHEN place_id % 5 = 0 THEN substr(name, 1, 3) || substr(name, 5) ELSE name END AS mention, region FROM fx_places),
s AS (SELECT mention, name, levenshtein(mention, name) AS d FROM (SELECT DISTINCT mention FROM m WHERE length(mention) >= 5), (SELECT DISTINCT name FROM fx_places) WHERE mention[1] = name[1]),
b AS (SELECT mention, min(d) AS d FROM s GROUP BY mention HAVING min(d) = 1),
c AS (SELECT mention_id, d, p.place_id, count(*) OVER (PARTITION BY mention_id) AS k, row_number() OVER (PARTITION BY mention_id ORDER BY
    CASE place WHEN 'city' THEN 4 WHEN 'town' THEN 3 WHEN 'village' THEN 2 ELSE 1 END * 10000000 + population DESC, p.place_id) AS pick
  FROM m JOIN b USING (mention) JOIN s USING (mention, d) JOIN fx_places p ON p.name = s.name AND p.region = m.region)
SELECT mention_id, d::INT AS d, place_id, round(CASE WHEN k = 1 THEN 1.0e0 WHEN k <= 3 THEN 0.8e0 ELSE 0.6e0 END * 0.7e0, 6) AS confidence FROM c WHERE pick = 1""",
            "fx_places",
        ),
        "ingest_upsert": with_views(
            """ SELECT b.channel, b.message_id, sha1(b.text) AS content_hash,
  CASE WHEN a.message_id IS NULL THEN 'inserted' WHEN a.text <> b.text THEN 'edited' ELSE 'unchanged' END AS state
FROM (SELECT * FROM fx_captures WHERE capture = 2) b LEFT JOIN (SELECT * FROM fx_captures WHERE capture = 1) a ON a.channel = b.channel AND a.message_id = b.message_id""",
            "fx_captures",
        ),
        "seq_gaps": with_views(" SELECT * FROM (SELECT lag(seq) OVER (ORDER BY seq) AS after, seq AS before FROM fx_log) WHERE before > after + 1", "fx_log"),
        "live_state": with_views(" SELECT entity, max(seq) AS seq, arg_max(value, seq) AS value FROM fx_log GROUP BY entity HAVING arg_max(kind, seq) <> 'delete'", "fx_log"),
        "track_sessions": with_views(
            """, l AS (SELECT *, lag(observed_at) OVER w AS before FROM fx_reports WINDOW w AS (PARTITION BY type, channel_no ORDER BY observed_at, report_id)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR observed_at - before > INTERVAL 25 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY type, channel_no ORDER BY observed_at, report_id) AS session FROM l)
SELECT type, channel_no, CAST(session AS BIGINT) AS session, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS n_reports FROM s GROUP BY type, channel_no, session""",
            "fx_reports",
        ),
        "source_health": """WITH l AS (SELECT user_id % 20 AS channel, max(ts) FILTER (WHERE event_type <> 'error' AND ts <= TIMESTAMP '2024-01-30') AS last_success FROM events WHERE user_id % 5 <> 0 GROUP BY 1)
SELECT *, coalesce(last_success >= TIMESTAMP '2024-01-29 22:00:00', false) AS healthy FROM l""",
        "parse_coverage": with_views(" SELECT type, count(*) AS n_reports, CAST(sum(CASE WHEN confidence < 0.6e0 THEN 1 ELSE 0 END) AS BIGINT) AS n_low, count(course_deg) AS n_course, count(from_lat) AS n_origin FROM fx_reports GROUP BY GROUPING SETS ((type), ())", "fx_reports"),
    }
