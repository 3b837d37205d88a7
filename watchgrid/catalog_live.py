"""Queries of feeds, region states, tracks and warnings, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import NOW, _km, _SPEED
from watchgrid.operators import feeds, history, notices, proximity, tracks
from watchgrid.sources.fixtures import view, with_views


def recent(spark, sf):
    """Reports of given tracks, all of the last 75 minutes."""
    at = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(mins="ago")
    return view(spark, sf, "fx_tracked").withColumn("observed_at", at).drop("ago")


def q_fixed(spark, sf):
    return feeds.fixed_string(view(spark, sf, "fx_feed_fixed"))


def q_states(spark, sf):
    return feeds.states(view(spark, sf, "fx_feed_states"))


def _sitrep(spark, sf):
    return feeds.sitrep(view(spark, sf, "fx_feed_sitrep"))


def _joined(rows, name="areas"):
    return rows.withColumn(name, F.array_join(name, "|"))


def q_sitrep(spark, sf):
    return _joined(_sitrep(spark, sf))


def q_threats(spark, sf):
    return feeds.threats(view(spark, sf, "fx_feed_sitrep"))


def q_district_states(spark, sf):
    return feeds.district_states(_sitrep(spark, sf), view(spark, sf, "fx_districts"))


def q_desired(spark, sf):
    return _joined(feeds.desired_alerts(_sitrep(spark, sf), view(spark, sf, "fx_districts")))


def q_region_states(spark, sf):
    """Alerts of every tenth feed stand for open ones, the others for ended."""
    found = feeds.desired_alerts(_sitrep(spark, sf), view(spark, sf, "fx_districts"))
    ended = F.when(F.col("poll_id") % 10 != 0, F.col("poll_id"))
    return feeds.region_states(found.withColumn("ended_at", ended)).drop("areas").withColumnRenamed("level", "colour")


def q_region_areas(spark, sf):
    found = feeds.desired_alerts(_sitrep(spark, sf), view(spark, sf, "fx_districts"))
    return _joined(feeds.region_states(found.withColumn("ended_at", F.when(F.col("poll_id") % 10 != 0, F.col("poll_id")))).select("region_id", "areas"))


def q_coverage(spark, sf):
    return feeds.coverage(_sitrep(spark, sf).select("poll_id", "region", F.explode("areas").alias("area")))


def _readers(spark, sf):
    # places of districts and regions by subscriber; every third has no district
    keys = F.array(*[F.lit(k) for k, _, _ in feeds.REGIONS])
    districts = F.array(*map(F.lit, ("сумський", "охтирський", "тернопільський", "одеський", "ізюмський")))
    s = view(spark, sf, "fx_subscribers")
    return s.select("subscriber_id", F.element_at(keys, (F.col("subscriber_id") % 26 + 1).cast("int")).alias("region"), F.when(F.col("subscriber_id") % 3 != 0, F.element_at(districts, (F.col("subscriber_id") % 5 + 1).cast("int"))).alias("district"))


def q_subscriber_alerts(spark, sf):
    changes = q_district_states(spark, sf).where("poll_id = 16 and active or poll_id = 20 and not active")
    kind = F.when(F.col("active"), "start").otherwise("stop")
    own = changes.select("region", "district", kind.alias("kind"))
    wide = own.select("region", F.lit(None).cast("string").alias("district"), "kind").distinct()
    return feeds.subscriber_alerts(_readers(spark, sf), own.union(wide))


def q_near_me(spark, sf):
    last = recent(spark, sf).withColumn("r", F.struct("observed_at", "report_id")).groupBy("track_id").agg(F.max_by(F.struct("type", "kind", "lat", "lon", "heading_deg", "observed_at", "area"), "r").alias("x"))
    t = last.select("track_id", "x.type", F.col("x.kind").alias("last_kind"), "x.lat", "x.lon", "x.heading_deg", "x.observed_at", "x.area")
    readers = view(spark, sf, "fx_subscribers").select(F.col("subscriber_id").alias("viewer_id"), "lat", "lon")
    return proximity.near_me(t, readers, NOW)


def q_tracks_at(spark, sf):
    return history.tracks_at(recent(spark, sf), NOW)


def q_segments(spark, sf):
    return tracks.track_segments(recent(spark, sf), NOW)


def q_coming(spark, sf):
    r = recent(spark, sf)
    last = r.groupBy("track_id").agg(F.max_by(F.struct("report_id", "kind", "lat", "lon", "heading_deg"), F.struct("observed_at", "report_id")).alias("x")).select("track_id", "x.*")
    return tracks.coming_from(last, r).withColumn("from_deg", F.round("from_deg", 6))


def _sightings(spark, sf):
    return history.to_observation(view(spark, sf, "fx_reports"))


def q_link(spark, sf):
    return tracks.track_link(_sightings(spark, sf)).withColumn("heading_deg", F.round("heading_deg", 6))


def q_track_update(spark, sf):
    points = _sightings(spark, sf)
    out = tracks.track_state(points.drop("course_deg"), tracks.track_link(points))
    return out.withColumns({c: F.round(c, 6) for c in ("lat", "lon", "heading_deg", "confidence")})


def _edited(spark, sf):
    """Reports with track and message before an edit that takes every third one's track away."""
    r = recent(spark, sf).withColumn("message_id", F.floor(F.col("report_id") / 4))
    return r, r.where("report_id % 3 <> 0")


def q_retract(spark, sf):
    return tracks.track_retract(*_edited(spark, sf))


def q_revise(spark, sf):
    before, after = _edited(spark, sf)
    return tracks.track_revise(tracks.track_retract(before, after), after)


def _lines(spark, sf):
    r = view(spark, sf, "fx_reports")
    return r.select((F.col("report_id") % 50).alias("subscriber_id"), F.concat_ws("|", "type", F.lit(""), "relation").alias("subject"), F.col("observed_at").alias("at"), F.col("report_id").alias("line_id"), F.abs(F.col("report_id") * 7 % 40).cast("double").alias("distance_km"))


def q_ledger(spark, sf):
    """Lines by minutes rather than hours: the table's time runs a hundredfold faster."""
    fast = F.col("at") - F.make_dt_interval(secs=(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(1e6) * F.lit(0.99))
    return notices.ledger(_lines(spark, sf).withColumn("at", fast)).select("subscriber_id", "subject", "line_id", "verdict")


def q_subject(spark, sf):
    return view(spark, sf, "fx_reports").select("report_id", notices.subject_key(F.col("type"), F.when(F.col("report_id") % 3 == 0, F.col("relation")), F.lit("in_radius")).alias("subject"))


def q_line(spark, sf):
    return notices.lines(_warnings(spark, sf)).select("report_id", "line")


def q_title(spark, sf):
    rows = notices.lines(_warnings(spark, sf)).groupBy("channel_no").agg(F.count("*").alias("n"), F.min_by("line", "report_id").alias("line"))
    return rows.select("channel_no", notices.title(F.col("line"), F.col("n")).alias("title"))


def _warnings(spark, sf):
    return view(spark, sf, "fx_reports").selectExpr(
        "report_id", "channel_no", "type", "n", "CASE WHEN report_id % 5 <> 0 THEN 'A<' || relation || '> & B' END AS place",
        "CASE report_id % 3 WHEN 0 THEN 'in_radius' WHEN 1 THEN 'approaching' ELSE 'heading_towards' END AS reason",
        "CAST(report_id % 90 AS DOUBLE) AS distance_km", "CASE WHEN report_id % 3 <> 0 THEN CAST(report_id % 30 AS DOUBLE) / 4 END AS eta_min", "CASE WHEN report_id % 3 = 1 THEN CAST(report_id % 9 AS DOUBLE) END AS closest_km",
    )


def queries() -> dict:
    return {
        "alerts_fixed_string": q_fixed,
        "alerts_states": q_states,
        "alerts_sitrep": q_sitrep,
        "alerts_threats": q_threats,
        "raion_states": q_district_states,
        "named_minus_raions": q_desired,
        "region_level": q_region_states,
        "region_areas": q_region_areas,
        "oblast_coverage": q_coverage,
        "subscriber_alerts": q_subscriber_alerts,
        "near_me": q_near_me,
        "tracks_at": q_tracks_at,
        "track_segments": q_segments,
        "coming_from": q_coming,
        "track_link": q_link,
        "track_update": q_track_update,
        "track_retract": q_retract,
        "track_revise": q_revise,
        "notice_ledger": q_ledger,
        "subject_key": q_subject,
        "warning_line": q_line,
        "warning_title": q_title,
    }


def oracle_sql() -> dict:
    keys = ", ".join(f"({i}, '{k}')" for i, k in enumerate(feeds.ORDER, 1))
    names = ", ".join(f"('{n}', '{k}')" for n, k in feeds.NAMES.items())
    state_names = ", ".join(f"('{n}', '{k}')" for n, k in feeds.STATE_NAMES.items())
    regions = ", ".join(f"('{k}', {n})" for k, _, n in feeds.REGIONS)
    area = r"""trim(replace(lower(regexp_replace(regexp_replace(regexp_replace(trim(x), '(?i)^м\.\s*', ''), '(?i)\s*\[hromada\]\s*', ''), '(?i)\s*(район|громада)\s*$', '')), '’', ''''))"""
    sitrep = rf""", n AS (SELECT * FROM (VALUES {names}) AS v(name, region)), g AS (SELECT * FROM (VALUES {regions}) AS v(region, total)),
s AS (SELECT poll_id, regexp_extract(raw, '(?s)## 3\. CURRENT WARNING STATUS(.*?)\n## ', 1) AS t FROM fx_feed_sitrep WHERE raw LIKE '%## 3. CURRENT WARNING STATUS%'),
ln AS (SELECT poll_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM s),
p AS (SELECT poll_id, i, trim(line) AS line, trim(regexp_extract(line, '\*\*[^(*]*\(([^)]+)\)\*\*', 1)) AS name FROM ln WHERE trim(line) LIKE '**%' AND line NOT ILIKE '%nominal alerts%' AND line NOT ILIKE '%cross-border launch-site%'),
a AS (SELECT poll_id, i, region, list_filter(regexp_extract_all(regexp_extract(line, '(?i)areas? affected:(.*)$', 1), '\(([^)]+)\)', 1), lambda x: regexp_matches(x, '[А-Яа-яіїєґІЇЄҐ]')) AS raws FROM p JOIN n USING (name)
  WHERE lower(regexp_extract(line, '—(.*)', 1)) LIKE '%air raid alert%'),
b AS (SELECT poll_id, i, region, list_transform(raws, lambda x: {area}) AS all_areas FROM a),
c AS (SELECT poll_id, i, region, list_filter(all_areas, lambda x, k: list_position(all_areas, x) = k) AS areas FROM b),
d AS (SELECT poll_id, region, arg_max(CASE WHEN total > 0 AND len(list_filter(areas, lambda x: x LIKE '%ий')) >= total THEN 'full' ELSE 'partial' END, i) AS level,
  arg_max(areas, i) FILTER (WHERE len(areas) > 0) AS areas FROM c JOIN g USING (region) GROUP BY poll_id, region),
sit AS (SELECT s.poll_id, g.region, coalesce(level, 'none') AS level, coalesce(areas, []::VARCHAR[]) AS areas FROM s CROSS JOIN g LEFT JOIN d ON d.poll_id = s.poll_id AND d.region = g.region)"""
    states = """, r AS (SELECT sit.poll_id, region, district, level, list_contains(areas, district) AS named FROM sit JOIN fx_districts USING (region)),
ds AS (SELECT poll_id, region, district, level <> 'none' AND (named OR NOT bool_or(named) OVER (PARTITION BY poll_id, region)) AS active FROM r)"""
    desired = """, o AS (SELECT *, (SELECT coalesce(list(district), []) FROM fx_districts f WHERE f.region = sit.region) AS districts FROM sit WHERE level <> 'none'),
w AS (SELECT *, list_sort(list_filter(areas, lambda x: NOT list_contains(districts, x))) AS rest FROM o),
al AS (SELECT poll_id, 'oblast:' || region AS region_id, region, 'oblast' AS level, 'full' AS severity, []::VARCHAR[] AS areas FROM w WHERE level = 'full'
  UNION ALL SELECT poll_id, 'raion:' || region || ':' || d, region, 'raion', 'full', [] FROM (SELECT poll_id, region, unnest(list_filter(areas, lambda x: list_contains(districts, x))) AS d FROM w WHERE level = 'partial')
  UNION ALL SELECT poll_id, 'oblast:' || region, region, CASE WHEN len(rest) > 0 THEN 'hromada' ELSE 'oblast' END, 'partial', rest FROM w WHERE level = 'partial' AND (len(rest) > 0 OR len(areas) = 0))"""
    tracked = f""", t AS (SELECT * EXCLUDE ago, TIMESTAMP '{NOW}' - to_minutes(ago) AS observed_at, ago FROM fx_tracked)"""
    last = ", z AS (SELECT track_id, unnest(arg_max({'report_id': report_id, 'type': type, 'kind': kind, 'lat': lat, 'lon': lon, 'heading_deg': heading_deg, 'ago': ago, 'area': area}, (observed_at, report_id))) FROM t GROUP BY track_id)"
    two = "fx_feed_sitrep", "fx_districts"
    lines = """, q AS (SELECT report_id, channel_no, type, n, CASE WHEN report_id % 5 <> 0 THEN 'A&lt;' || relation || '&gt; &amp; B' END AS place, report_id % 3 AS k, report_id % 90 AS km, (report_id % 30) / 4.0e0 AS eta, report_id % 9 AS closest FROM fx_reports),
wl AS (SELECT report_id, channel_no, '⚠️ ' || CASE type WHEN 'uav' THEN 'БпЛА' WHEN 'jet_uav' THEN 'Реактивний БпЛА' WHEN 'cruise' THEN 'Крилата ракета' WHEN 'recon' THEN 'Розвідник' ELSE 'Ціль' END || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END || ' — '
  || CASE WHEN place IS NULL THEN '~' || km || ' км від вас' WHEN k = 2 THEN 'курс на ' || place || ' (~' || km || ' км від вас)' ELSE place || ' (~' || km || ' км від вас)' END
  || CASE WHEN k <> 1 THEN '' WHEN closest < 2 THEN ' · курс прямо на вас' ELSE ' · пройде за ~' || closest || ' км' END
  || CASE WHEN k = 0 THEN '' WHEN eta < 1 THEN ' · вже поруч' WHEN k = 1 THEN ' · ~' || CAST(floor(eta + 0.5e0) AS INT) || ' хв (орієнтовно)' ELSE ' · до вас ~' || CAST(floor(eta + 0.5e0) AS INT) || ' хв' END AS line FROM q)"""
    readers = f""", u AS (SELECT subscriber_id, [{', '.join(f"'{k}'" for k, _, _ in feeds.REGIONS)}][subscriber_id % 26 + 1] AS region,
  CASE WHEN subscriber_id % 3 <> 0 THEN ['сумський', 'охтирський', 'тернопільський', 'одеський', 'ізюмський'][subscriber_id % 5 + 1] END AS district FROM fx_subscribers)"""
    return {
        "alerts_fixed_string": with_views(f", k AS (SELECT * FROM (VALUES {keys}) AS v(i, region)) SELECT poll_id, region, CASE raw[i] WHEN 'A' THEN 'full' WHEN 'P' THEN 'partial' ELSE 'none' END AS level FROM fx_feed_fixed, k WHERE length(raw) >= 27", "fx_feed_fixed"),
        "alerts_states": with_views(
            f""", n AS (SELECT * FROM (VALUES {state_names}) AS v(name, region)), j AS (SELECT poll_id, from_json(raw, '[{{"name":"VARCHAR","alert":"BOOLEAN"}}]') AS s FROM fx_feed_states WHERE json_valid(raw)),
x AS (SELECT poll_id, unnest(s) AS e FROM j WHERE len(s) >= 20)
SELECT poll_id, trim(e.name) AS name, n.region, CASE WHEN n.region IS NULL THEN NULL WHEN coalesce(e.alert, false) THEN 'full' ELSE 'none' END AS level FROM x LEFT JOIN n ON n.name = trim(e.name)""",
            "fx_feed_states",
        ),
        "alerts_sitrep": with_views(sitrep + " SELECT poll_id, region, level, array_to_string(areas, '|') AS areas FROM sit", "fx_feed_sitrep"),
        "alerts_threats": with_views(
            r""", s AS (SELECT poll_id, regexp_extract(raw, '(?s)## 4\. THREAT ACTIVITY(.*?)\n## ', 1) AS t FROM fx_feed_sitrep), l AS (SELECT poll_id, trim(unnest(string_split(t, chr(10)))) AS line, unnest(range(len(string_split(t, chr(10)))))::INT AS i FROM s)
SELECT poll_id, i, regexp_extract(line, '(\d\d:\d\d)', 1) AS at, trim(regexp_extract(line, '\d\s*—\s*([^*(]+)', 1)) AS kind, trim(regexp_extract(line, '\*\*\s*over\s*([^—]+)', 1)) AS place FROM l WHERE line LIKE '- **__:__ — %** over %'""",
            "fx_feed_sitrep",
        ),
        "raion_states": with_views(sitrep + states + " SELECT * FROM ds", *two),
        "named_minus_raions": with_views(sitrep + desired + " SELECT poll_id, region_id, region, level, severity, array_to_string(areas, '|') AS areas FROM al", *two),
        "region_level": with_views(
            sitrep + desired + " SELECT region_id, max(CASE WHEN level = 'raion' OR level = 'oblast' AND severity = 'full' THEN 2 ELSE 1 END) AS colour, count(*) AS n_alerts FROM al WHERE poll_id % 10 = 0 GROUP BY region_id", *two
        ),
        "region_areas": with_views(
            sitrep + desired + " SELECT region_id, array_to_string(list_sort(list_distinct(flatten(list(areas)))), '|') AS areas FROM al WHERE poll_id % 10 = 0 GROUP BY region_id", *two
        ),
        "oblast_coverage": with_views(
            sitrep + ", e AS (SELECT poll_id, region, unnest(areas) AS area FROM sit) SELECT poll_id, region, count(DISTINCT area) AS n_named, total AS n_districts, total > 0 AND count(DISTINCT area) >= total AS whole FROM e JOIN g USING (region) WHERE area LIKE '%ий' GROUP BY poll_id, region, total",
            "fx_feed_sitrep",
        ),
        "subscriber_alerts": with_views(
            sitrep + states + readers + """, h AS (SELECT region, district, CASE WHEN active THEN 'start' ELSE 'stop' END AS kind FROM ds WHERE poll_id = 16 AND active OR poll_id = 20 AND NOT active)
SELECT subscriber_id, min(kind) AS kind FROM u JOIN h ON CASE WHEN u.district IS NOT NULL THEN u.district = h.district ELSE u.region = h.region END GROUP BY subscriber_id""",
            *two,
            "fx_subscribers",
        ),
        "near_me": with_views(
            tracked + last + f""", v AS (SELECT subscriber_id AS viewer_id, lat AS vlat, lon AS vlon FROM fx_subscribers WHERE lat IS NOT NULL AND lon IS NOT NULL),
m AS (SELECT viewer_id, track_id, kind, {_km('lat', 'lon', 'vlat', 'vlon')} AS d, (lon - vlon) * 111.32e0 * cos(radians(vlat)) AS px, (lat - vlat) * 110.57e0 AS py, radians(heading_deg) AS h, {_SPEED} AS speed, ago FROM z, v WHERE ago <= 25 AND NOT area),
e AS (SELECT *, abs(px * cos(h) - py * sin(h)) AS side, -(px * sin(h) + py * cos(h)) / speed * 60 - ago AS eta FROM m),
f AS (SELECT viewer_id, track_id, CASE WHEN kind = 'position' AND side <= 40 AND eta BETWEEN 0 AND 60 THEN 'approach' WHEN kind = 'destination' AND d <= 40 THEN 'destination' END AS kind, round(eta, 6) AS eta, round(side, 6) AS side, round(d, 6) AS d FROM e)
SELECT viewer_id, track_id, kind, CASE WHEN kind = 'approach' THEN eta END AS eta_min, CASE WHEN kind = 'approach' THEN side END AS closest_km, CASE WHEN kind = 'destination' THEN d END AS distance_km,
  row_number() OVER (PARTITION BY viewer_id ORDER BY kind, CASE WHEN kind = 'approach' THEN eta ELSE d END, track_id) AS place FROM f WHERE kind IS NOT NULL""",
            "fx_tracked",
            "fx_subscribers",
        ),
        "tracks_at": with_views(
            tracked + """ SELECT track_id, min(observed_at) AS first_seen, max(observed_at) AS last_seen, arg_max(kind, (observed_at, report_id)) AS last_kind, round(arg_max(lat, (observed_at, report_id)), 6) AS lat,
  round(arg_max(lon, (observed_at, report_id)), 6) AS lon, string_agg(report_id, ',' ORDER BY observed_at, report_id) AS path FROM t WHERE ago >= 0 AND ago < 60 GROUP BY track_id""",
            "fx_tracked",
        ),
        "track_segments": with_views(
            tracked + """, s AS (SELECT *, lag(report_id) OVER (PARTITION BY track_id ORDER BY observed_at, report_id) AS from_id FROM t WHERE kind <> 'destination' AND ago BETWEEN 0 AND 60)
SELECT track_id, from_id, report_id AS to_id, round(0.9e0 - 0.8e0 * ago / 60, 2) AS opacity FROM s WHERE from_id IS NOT NULL AND ago < 60""",
            "fx_tracked",
        ),
        "coming_from": with_views(
            tracked + last + """, k AS (SELECT z.track_id, arg_max({'a': t.lat, 'b': t.lon}, (t.observed_at, t.report_id)) AS p FROM z JOIN t ON t.track_id = z.track_id WHERE z.kind = 'destination' AND t.kind <> 'destination' AND abs(t.lat - z.lat) + abs(t.lon - z.lon) >= 1e-6 GROUP BY 1)
SELECT z.track_id, round(coalesce(fmod(heading_deg + 180, 360), fmod(degrees(atan2(sin(radians(p.b - lon)) * cos(radians(p.a)), cos(radians(lat)) * sin(radians(p.a)) - sin(radians(lat)) * cos(radians(p.a)) * cos(radians(p.b - lon)))) + 360, 360)), 6) AS from_deg
FROM z LEFT JOIN k ON k.track_id = z.track_id WHERE kind = 'destination'""",
            "fx_tracked",
        ),
        "track_retract": with_views(" SELECT DISTINCT report_id // 4 AS message_id, track_id FROM fx_tracked a WHERE NOT EXISTS (SELECT 1 FROM fx_tracked b WHERE b.report_id // 4 = a.report_id // 4 AND b.track_id = a.track_id AND b.report_id % 3 <> 0)", "fx_tracked"),
        "track_revise": with_views(
            tracked + """, x AS (SELECT DISTINCT track_id FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.report_id // 4 = a.report_id // 4 AND b.track_id = a.track_id AND b.report_id % 3 <> 0)),
y AS (SELECT track_id, unnest(arg_max({'report_id': report_id, 'observed_at': observed_at, 'lat': lat, 'lon': lon}, (observed_at, report_id))) FROM t WHERE report_id % 3 <> 0 GROUP BY track_id)
SELECT x.track_id, y.report_id IS NULL AS deleted, report_id, observed_at, lat, lon FROM x LEFT JOIN y ON y.track_id = x.track_id""",
            "fx_tracked",
        ),
        "subject_key": with_views(" SELECT report_id, type || '|' || CASE WHEN report_id % 3 = 0 THEN relation ELSE '' END || '|in_radius' AS subject FROM fx_reports", "fx_reports"),
        "warning_line": with_views(lines + " SELECT report_id, line FROM wl", "fx_reports"),
        "warning_title": with_views(lines + ", f AS (SELECT channel_no, count(*) AS n, arg_min(line, report_id) AS line FROM wl GROUP BY channel_no) SELECT channel_no, substr(split_part(line, ' — ', 1), 1, 60) || CASE WHEN n > 1 THEN ' +' || (n - 1) ELSE '' END AS title FROM f", "fx_reports"),
    }
