"""Queries of the inbox, archived files, states over time and audits, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import NOW, _FILLED, _MATCHES, q_intervals
from watchgrid.catalog_live import recent
from watchgrid.catalog_places import q_resolve
from watchgrid.catalog_state import _CORNERS, rings
from watchgrid.catalog_text import _case, _has, lines, posts, re2
from watchgrid.functions import clauses as cl
from watchgrid.functions import geo
from watchgrid.functions import text as tx
from watchgrid.operators import feeds, inbox, proximity, regions
from watchgrid.session import cut
from watchgrid.sources import files
from watchgrid.sources.fixtures import view, with_views


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def q_replace(spark, sf):
    r = view(spark, sf, "fx_reports").selectExpr("report_id div 4 AS message_id", "report_id % 3 AS version", "report_id AS line", "type")
    return inbox.reports_replace(r)


def q_cache(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha1("text").alias("content_hash"))
    answers = d.where("doc_id % 2 = 0").groupBy("content_hash").agg(F.max(F.col("doc_id") % 4).alias("n"))
    return inbox.fallback_cache(d.select(F.col("doc_id").alias("message_id"), "content_hash", (F.col("doc_id") % 3).alias("n")), answers)


def q_budget(spark, sf):
    p = posts(spark, sf).select(F.date_trunc("hour", "posted_at").cast("timestamp_ntz").alias("batch"), F.col("post_id").alias("message_id"), "posted_at", F.sha1("text").alias("content_hash"), F.when(F.col("post_id") % 3 == 0, F.lit(1)).alias("called_at"))
    return inbox.fallback_budget(p, p.where("message_id % 7 = 0").select("content_hash").distinct(), 3)


def q_low(spark, sf):
    """The first 10 reports of low confidence."""
    return view(spark, sf, "fx_reports").where("confidence < 0.6").orderBy("report_id").limit(10).select("report_id", "type")


_RAW = """CASE event_id % 6 WHEN 0 THEN 'no answer' WHEN 1 THEN '{"targets":[{"type":"uav","to":"Суми"}]}' WHEN 2 THEN 'So: ```json' || chr(10) || '{"targets":[{"type":"kab","count":' || CAST(user_id % 250 AS VARCHAR(9)) || ',"confidence":0.9},{"type":"uav"}]}' || chr(10) || '``` end'
 WHEN 3 THEN '{"targets":[{"type":"balloon"}]}' WHEN 4 THEN '{"targets":[{"type":"uav","confidence":' || CAST(user_id % 3 AS VARCHAR(9)) || '}]}' ELSE '{"targets":[]}' END"""


def q_extraction(spark, sf):
    r = _events(spark, sf).select("event_id", inbox.extraction(F.expr(_RAW)).alias("t"))
    return r.select("event_id", F.size("t").alias("n"), F.get("t", F.lit(0))["type"].alias("type"), F.get("t", F.lit(0))["count"].cast("double").alias("count"), F.get("t", F.lit(0))["relation"].alias("relation"), F.get("t", F.lit(0))["confidence"].alias("confidence")).where("n >= 0").fillna(-1.0)


def _headed(spark, sf):
    head = F.regexp_extract("text", r"^\s*([А-ЯІЇЄҐ][А-Яа-яІіЇїЄєҐґ'’-]{3,20})\s*[:\-–—]\s*", 1)
    known = F.when(tx.normalise(head) == "сумщина", "sumska")
    kind = tx.classify_type(F.col("text"))
    return lines(spark, sf).select(F.col("post_id").alias("message_id"), "line", "text", known.alias("region"), F.when(kind != "unknown", kind).alias("type"))


def q_heading(spark, sf):
    rest = F.when(F.col("region").isNotNull(), F.regexp_replace("text", r"^\s*[А-ЯІЇЄҐ][А-Яа-яІіЇїЄєҐґ'’-]{3,20}\s*[:\-–—]\s*", "")).otherwise(F.col("text"))
    return _headed(spark, sf).select("message_id", "line", "region", rest.alias("rest"))


def q_sticky(spark, sf):
    return inbox.sticky_context(_headed(spark, sf), "region", "type").select("message_id", "line", "region", "type")


_KNOWN_NAMES = ["Суми", "Конотоп", "Ізюм"]


def q_misses(spark, sf):
    names = F.regexp_extract_all("text", F.lit(r"([А-ЯІЇЄҐ][^\s,.;:!?()]{2,})"), 1)
    names = F.filter(names, lambda n: ~n.rlike(inbox.TARGET))
    rows = lines(spark, sf).select(F.col("post_id").alias("message_id"), "line", "text", tx.classify_type(F.col("text")).alias("type"), (F.size(cl.cues(F.col("text"))) > 0).alias("has_cue"), F.size(names).alias("n_names"), F.size(F.array_intersect(names, F.array(*map(F.lit, _KNOWN_NAMES)))).alias("n_resolved"))
    out = inbox.miss_reasons(rows)
    return out.select("reason", "n", F.array_join("samples", "; ").alias("samples"))


def q_top_misses(spark, sf):
    """The 25 phrases that most often resolve to nothing."""
    p = view(spark, sf, "fx_phrases")
    left = p.join(q_resolve(spark, sf).select("mention_id"), "mention_id", "left_anti")
    return left.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(25)


def q_channel_state(spark, sf):
    e = _events(spark, sf)
    polls = e.select((F.col("user_id") % 20).alias("channel"), F.col("ts").alias("at"), F.col("event_id").alias("min_id"), (F.col("event_id") + 20).alias("max_id"), F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), F.col("event_id").cast("string"))).alias("error"))
    return inbox.channel_state(polls)


def q_health(spark, sf):
    last = view(spark, sf, "fx_reports").groupBy("channel_no").agg(F.max("observed_at").alias("last_seen"))
    return inbox.health_summary(last.withColumn("healthy", F.col("last_seen") >= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")))


def q_resume(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("consumer"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") * 17 - 20).alias("seq"))
    return inbox.resume(c, view(spark, sf, "fx_log"))


def q_append(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("change_id"), F.col("ts").alias("at"), "event_type")
    return inbox.append_log(e, 5000).select("change_id", "event_type", "seq")


def q_reports_messages(spark, sf):
    r, p = view(spark, sf, "fx_reports"), posts(spark, sf)
    return r.join(p.select((F.col("post_id") * 2).alias("report_id"), "post_id", F.length("text").alias("n_chars")), "report_id").select("report_id", "post_id", "type", "n_chars")


def q_shift(spark, sf):
    p = posts(spark, sf).where("post_id % 2 = 0")
    shift = F.make_dt_interval(mins=(F.col("post_id") % 90 - 45).cast("int"))
    return p.select("post_id", inbox.cache_time(shift, F.col("posted_at")).alias("observed_at"))


_TIMES = [f"2024-01-15 {h:02d}:30:00" for h in range(9, 13)]


def q_time_travel(spark, sf):
    """Open alerts and tracks seen within the hour before, at several times (a few literals, so broadcast)."""
    times = F.broadcast(spark.createDataFrame([(t,) for t in _TIMES], "t string").select(F.col("t").cast("timestamp_ntz").alias("at")))
    i = q_intervals(spark, sf)
    open_ = times.join(i, (F.col("started_at") <= F.col("at")) & (F.col("ended_at").isNull() | (F.col("ended_at") > F.col("at"))))
    r = view(spark, sf, "fx_reports").select("observed_at", "channel_no")
    seen = times.join(r, (F.col("observed_at") <= F.col("at")) & (F.col("observed_at") > F.col("at") - F.expr("interval 60 minutes")))
    row = lambda d, kind, key: d.select("at", F.lit(kind).alias("kind"), F.col(key).alias("key")).distinct()
    return row(open_, "alert", "region").union(row(seen, "track", "channel_no"))


def q_snapshot(spark, sf):
    """Alerts, tracks and sources at one time, with the log's number read before them, so that a reader who goes on from it misses nothing;
    written as a whole, then read."""
    at = F.lit(NOW).cast("timestamp_ntz")
    head = view(spark, sf, "fx_log").agg(F.max("seq")).first()[0]
    i = q_intervals(spark, sf).where((F.col("started_at") <= at) & (F.col("ended_at").isNull() | (F.col("ended_at") > at))).select(F.lit("alert").alias("kind"), F.col("region").alias("key"), F.col("level").cast("long").alias("value"))
    t = recent(spark, sf).groupBy("track_id").agg(F.count("*").alias("value")).select(F.lit("track").alias("kind"), F.col("track_id").alias("key"), "value")
    s = view(spark, sf, "fx_reports").where(F.col("observed_at") <= at).groupBy("channel_no").agg(F.count("*").alias("value")).select(F.lit("source").alias("kind"), F.col("channel_no").alias("key"), "value")
    return cut(i.union(t).union(s).withColumn("seq", F.lit(head).cast("long")))


def q_cursor(spark, sf, cursor: int = 50):
    """Where a notifier stands after its next batch of 300 reports, whatever became of them."""
    batch = view(spark, sf, "fx_reports").where(F.col("report_id") > cursor).orderBy("report_id").limit(300)
    return batch.agg(F.coalesce(F.max("report_id"), F.lit(cursor)).alias("cursor"), F.count("*").alias("n"))


def q_batches(spark, sf):
    r = view(spark, sf, "fx_reports").selectExpr("report_id div 300 AS batch", "report_id % 3 = 0 AS sent", "channel_no")
    return r.groupBy("batch").agg(F.count("*").alias("scanned"), F.count_if("sent").alias("sent"), F.count_distinct(F.when(F.col("sent"), F.col("channel_no"))).alias("recipients"))


def q_dry_run(spark, sf):
    """What would be sent: pairs and readers for each reason and type."""
    lines = proximity.reader_lines(view(spark, sf, "fx_reports"), view(spark, sf, "fx_subscribers"), NOW)
    return lines.groupBy("reason", "type").agg(F.sum("n_pairs").alias("n"), F.count("*").alias("n_readers"))


def q_nearest_live(spark, sf):
    """The 5 reports of the last 75 minutes nearest to a point."""
    km = geo.distance_km(F.lit(50.45), F.lit(30.52), F.col("lat"), F.col("lon"))
    return recent(spark, sf).select("report_id", F.round(km, 6).alias("km")).orderBy("km", "report_id").limit(5)


def q_retention(spark, sf):
    """How much of each table stays: messages 90 days, the ledger a day, cached answers 30 days, tracks 7 days, events 6 hours."""
    e = _events(spark, sf).select("ts")
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    rules = [("messages", "90 days"), ("ledger", "24 hours"), ("cache", "30 days"), ("tracks", "7 days"), ("events", "6 hours")]
    kept = [F.count_if(F.col("ts") >= now - F.expr(f"interval {age}")).alias(name) for name, age in rules]
    return e.agg(*kept).unpivot([], [n for n, _ in rules], "what", "n_kept")


def q_live_location(spark, sf):
    """The region of each user's latest place."""
    where = "44.5e0 + (event_id * 31 % 700) * 0.01e0 AS lat", "22.5e0 + (event_id * 17 % 1700) * 0.01e0 AS lon"
    e = _events(spark, sf).selectExpr("user_id", "ts", "event_id", *where)
    last = e.groupBy("user_id").agg(F.max_by(F.struct("lat", "lon"), F.struct("ts", "event_id")).alias("x")).select(F.col("user_id").alias("point_id"), "x.lat", "x.lon")
    return regions.point_in_region(last, rings(spark, sf)).select(F.col("point_id").alias("user_id"), "region")


def q_covered(spark, sf):
    """Region ids that alerts can carry without a polygon of their own."""
    made = feeds.desired_alerts(feeds.sitrep(view(spark, sf, "fx_feed_sitrep")), view(spark, sf, "fx_districts")).select("region_id").distinct()
    drawn = view(spark, sf, "fx_districts").select(F.explode(F.array(F.concat(F.lit("oblast:"), "region"), F.concat(F.lit("raion:"), "region", F.lit(":"), "district"))).alias("region_id")).distinct()
    return made.exceptAll(drawn)


def q_concerns(spark, sf):
    """Tracks whose path passes a reader within 40 km and 30 minutes."""
    last = recent(spark, sf).groupBy("track_id").agg(F.max_by(F.struct("type", "kind", "lat", "lon", "heading_deg", "observed_at", "area"), F.struct("observed_at", "report_id")).alias("x"))
    t = last.select("track_id", "x.type", F.col("x.kind").alias("last_kind"), "x.lat", "x.lon", "x.heading_deg", "x.observed_at", "x.area")
    readers = view(spark, sf, "fx_subscribers").select(F.col("subscriber_id").alias("viewer_id"), "lat", "lon")
    return proximity.near_me(t, readers, NOW, eta_max_min=30.0).where("kind = 'approach'").select("viewer_id", "track_id")


def q_track_order(spark, sf):
    """Tracks of each type by when they were last seen."""
    t = recent(spark, sf).groupBy("type", "track_id").agg(F.max("observed_at").alias("last_seen"))
    from pyspark.sql import Window

    return t.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("last_seen"), "track_id")))


_PAGE = """'<html>' || '<div class="tgme_widget_message_wrap"><div data-post="' || CASE doc_id % 5 WHEN 0 THEN 'Other' ELSE upper(source) END || '/' || CASE doc_id % 7 WHEN 0 THEN '0' ELSE CAST(doc_id AS VARCHAR(20)) END || '">'
 || '<a class="tgme_widget_message_reply"><div class="js-message_reply_text">old</div></a>' || CASE WHEN doc_id % 3 = 0 THEN '<a class="tgme_widget_message_photo_wrap"></a>' ELSE '' END
 || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '<div class="tgme_widget_message_text js-message_text">Line &amp; one<br/>two   <b>' || CAST(doc_id AS VARCHAR(20)) || '</b><br><br><br>&#1111;</div>' END
 || '<span class="tgme_widget_message_date"><time datetime="' || CASE doc_id % 11 WHEN 0 THEN 'soon' ELSE '2024-01-15T10:00:00+00:00' END || '"></time></span></div></div></html>'"""


def q_pages(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("channel"), F.expr(_PAGE).alias("html"))
    return files.page_messages(d).withColumn("posted_at", F.date_format("posted_at", "yyyy-MM-dd"))


_PLACE_FILE = """'{"columns":["place_id","name","population","region"],"rows":[["' || CAST(p_partkey AS VARCHAR(20)) || '","' || p_name || '","' || CASE p_partkey % 3 WHEN 0 THEN 'many' ELSE CAST(p_size AS VARCHAR(20)) END || '",null],["' || CAST(-p_partkey AS VARCHAR(20)) || '","x","1","sumska"]]}'"""


def q_places_load(spark, sf):
    d = spark.read.parquet(f"{sf}/part.parquet").select(F.expr(_PLACE_FILE).alias("raw"))
    return files.places_load(d).select("place_id", "name", "region", F.coalesce("population", F.lit(-1)).alias("population"))


_TAGS = """CASE p_partkey % 4 WHEN 0 THEN '{"name":"Sumy","population":"1 200"}' WHEN 1 THEN '{"name:uk":"Суми","name":"Sumy","katotth":"UA5900","population":"12 000"}' WHEN 2 THEN '{"name":"Ромни","alt_name":"Ромен","koatuu":"5910"}' ELSE '{"name":"Київ","koatuu":"8000","old_name":"Київ"}' END"""


def q_places_etl(spark, sf):
    return files.places_etl(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node_id"), F.expr(_TAGS).alias("tags")))


_RING = """'[[' || CAST(n_nationkey AS VARCHAR(9)) || ',1],[' || CAST(n_nationkey + 3 AS VARCHAR(9)) || ',1.5],[' || CAST(n_nationkey + 2 AS VARCHAR(9)) || ',4],[' || CAST(n_nationkey AS VARCHAR(9)) || ',1]]'"""
_GEOMETRY = f"""CASE n_nationkey % 3 WHEN 0 THEN '{{"type":"Polygon","coordinates":[' || {_RING} || ',[[0,0],[1,1],[0,1]]]}}' WHEN 1 THEN '{{"type":"MultiPolygon","coordinates":[[' || {_RING} || '],[[[5,5],[6,9],[5,9]]]]}}' ELSE '{{"type":"Point","coordinates":[1,2]}}' END"""


def q_polygons_load(spark, sf):
    d = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("region"), F.expr(_GEOMETRY).alias("geometry"))
    return files.polygons_load(d).drop("n_points")


def q_migrate(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_name")
    return files.migrate(s, {"s_suppkey": ("long", 0), "s_name": ("string", ""), "state": ("string", "new"), "tries": ("int", 0)})


def q_migrated(spark, sf):
    return files.reconcile(spark.read.parquet(f"{sf}/supplier.parquet"), q_migrate(spark, sf))


def queries() -> dict:
    return {
        "reports_replace": q_replace,
        "fallback_cache": q_cache,
        "fallback_budget": q_budget,
        "low_conf_samples": q_low,
        "extraction_valid": q_extraction,
        "heading": q_heading,
        "sticky_context": q_sticky,
        "miss_reasons": q_misses,
        "top_misses": q_top_misses,
        "channel_cursor": q_channel_state,
        "health_summary": q_health,
        "event_log": q_resume,
        "event_sink": q_append,
        "reports_messages": q_reports_messages,
        "cache_time_shift": q_shift,
        "time_travel": q_time_travel,
        "snapshot_write": q_snapshot,
        "notify_cursor": q_cursor,
        "batch_stats": q_batches,
        "dry_run": q_dry_run,
        "nearest_live": q_nearest_live,
        "retention": q_retention,
        "region_of_live_location": q_live_location,
        "region_ids_covered": q_covered,
        "concerns": q_concerns,
        "track_order": q_track_order,
        "page_messages": q_pages,
        "places_load": q_places_load,
        "places_etl": q_places_etl,
        "polygons_load": q_polygons_load,
        "table_migrate": q_migrate,
        "table_reconcile": q_migrated,
    }


def oracle_sql() -> dict:
    from watchgrid.catalog_live import oracle_sql as live

    l = ", l AS (SELECT post_id AS message_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS line FROM fx_posts)"  # noqa: E741
    kind = _case([(_has("text", [x]), f"'{t}'") for t, x in tx.TYPES], "'unknown'")
    head = r"regexp_extract(text, '^\s*([А-ЯІЇЄҐ][А-Яа-яІіЇїЄєҐґ''’-]{3,20})\s*[:\-–—]\s*', 1)"
    headed = f"{l}, h AS (SELECT message_id, line, text, CASE WHEN lower({head}) = 'сумщина' THEN 'sumska' END AS region, nullif({kind}, 'unknown') AS type FROM l)"
    cues = "|".join(f"(?:{p})" for _, p in cl.CUES)
    names = r"list_filter(regexp_extract_all(text, '[А-ЯІЇЄҐ][^\s,.;:!?()]{2,}'), lambda n: NOT regexp_matches(n, '(?i)бпла|шахед|герань|каб|ракет|реактивн|балістик|авіаці'))"
    times = ", ".join(f"(TIMESTAMP '{t}')" for t in _TIMES)
    inside = "sum(CASE WHEN (lat1 > lat) <> (lat2 > lat) AND lon < (lon2 - lon1) * (lat - lat1) / nullif(lat2 - lat1, 0) + lon1 THEN 1 ELSE 0 END) % 2 = 1"
    near = live()["near_me"].replace("eta BETWEEN 0 AND 60", "eta BETWEEN 0 AND 30")
    desired = live()["named_minus_raions"]
    return {
        "reports_replace": with_views(
            """, a AS (SELECT report_id // 4 AS message_id, report_id % 3 AS version, report_id AS line, type FROM fx_reports), b AS (SELECT *, max(version) OVER (PARTITION BY message_id) AS newest FROM a)
SELECT message_id, version, line, type, row_number() OVER (PARTITION BY message_id ORDER BY line) - 1 AS seq FROM b WHERE version = newest""",
            "fx_reports",
        ),
        "fallback_cache": """WITH d AS (SELECT doc_id, sha1(text) AS h FROM documents), a AS (SELECT h, max(doc_id % 4) AS n FROM d WHERE doc_id % 2 = 0 GROUP BY h)
SELECT doc_id AS message_id, CASE WHEN a.n > doc_id % 3 THEN 'fallback' ELSE 'rules' END AS source, CASE WHEN a.n > doc_id % 3 THEN a.n ELSE doc_id % 3 END AS n FROM d LEFT JOIN a USING (h)""",
        "fallback_budget": with_views(
            """, w AS (SELECT date_trunc('hour', posted_at) AS batch, post_id AS message_id, posted_at FROM fx_posts WHERE post_id % 3 <> 0 AND sha1(text) NOT IN (SELECT sha1(text) FROM fx_posts WHERE post_id % 7 = 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY posted_at, message_id) AS k FROM w) SELECT batch::TIMESTAMP AS batch, message_id FROM k WHERE k <= 3""",
            "fx_posts",
        ),
        "low_conf_samples": with_views(" SELECT report_id, type FROM fx_reports WHERE confidence < 0.6e0 ORDER BY report_id LIMIT 10", "fx_reports"),
        "extraction_valid": """SELECT event_id, CASE event_id % 6 WHEN 2 THEN 2 WHEN 5 THEN 0 ELSE 1 END::INT AS n, CASE event_id % 6 WHEN 2 THEN 'kab' WHEN 5 THEN NULL ELSE 'uav' END AS type,
  CASE event_id % 6 WHEN 2 THEN user_id % 250 WHEN 5 THEN -1 ELSE 1 END::DOUBLE AS count, CASE WHEN event_id % 6 <> 5 THEN 'towards' END AS relation, CASE event_id % 6 WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.9e0 WHEN 4 THEN user_id % 3 ELSE -1 END::DOUBLE AS confidence
FROM events WHERE event_id % 6 IN (1, 5) OR event_id % 6 = 2 AND user_id % 250 BETWEEN 1 AND 200 OR event_id % 6 = 4 AND user_id % 3 <= 1""",
        "heading": with_views(headed + r" SELECT message_id, line, region, CASE WHEN region IS NULL THEN text ELSE regexp_replace(text, '^\s*[А-ЯІЇЄҐ][А-Яа-яІіЇїЄєҐґ''’-]{3,20}\s*[:\-–—]\s*', '') END AS rest FROM h", "fx_posts"),
        "sticky_context": with_views(headed + " SELECT message_id, line, last_value(region IGNORE NULLS) OVER w AS region, last_value(type IGNORE NULLS) OVER w AS type FROM h WINDOW w AS (PARTITION BY message_id ORDER BY line ROWS UNBOUNDED PRECEDING)", "fx_posts"),
        "miss_reasons": with_views(
            f"""{l}, a AS (SELECT *, {kind} AS type, regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}])({cues})\\s') AS has_cue, {names} AS names FROM l WHERE regexp_matches(text, '(?i)бпла|шахед|герань|каб|ракет|реактивн|балістик|авіаці')),
b AS (SELECT *, CASE WHEN type = 'unknown' THEN 'type not recognised' WHEN NOT has_cue THEN 'no relation cue' WHEN len(names) = 0 THEN 'cue but no capitalised name' WHEN NOT list_has_any(names, ['Суми', 'Конотоп', 'Ізюм']) THEN 'no name resolves' ELSE 'other' END AS reason FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY message_id, line) AS k FROM b)
SELECT reason, count(*) AS n, string_agg(substr(text, 1, 78), '; ' ORDER BY message_id, line) FILTER (WHERE k <= 4) AS samples FROM c GROUP BY reason""",
            "fx_posts",
        ),
        "channel_cursor": """WITH p AS (SELECT user_id % 20 AS channel, ts AS seen_at, event_id AS min_id, event_id + 20 AS max_id, CASE WHEN event_type = 'error' THEN 'HTTP ' || event_id END AS error FROM events),
d AS (SELECT channel, coalesce(max(max_id) FILTER (WHERE error IS NULL), 0) AS last_id, coalesce(min(min_id) FILTER (WHERE error IS NULL), 0) AS oldest_id, max(seen_at) FILTER (WHERE error IS NULL) AS last_success FROM p GROUP BY channel)
SELECT d.*, count(p.seen_at) AS failures, arg_max(p.error, p.seen_at) AS last_error FROM d LEFT JOIN p ON p.channel = d.channel AND p.error IS NOT NULL AND (last_success IS NULL OR p.seen_at > last_success) GROUP BY ALL""",
        "health_summary": with_views(
            """, c AS (SELECT channel_no, max(observed_at) >= TIMESTAMP '2024-01-30 12:00:00' AS healthy FROM fx_reports GROUP BY 1)
SELECT CASE WHEN count(*) = 0 THEN 'warn' WHEN count(*) FILTER (WHERE NOT healthy) = 0 THEN 'ok' WHEN bool_or(healthy) THEN 'warn' ELSE 'bad' END AS level, count(*) FILTER (WHERE NOT healthy) AS n_bad, count(*) AS n FROM c""",
            "fx_reports",
        ),
        "event_log": with_views(
            """, e AS (SELECT min(seq) AS oldest, coalesce(max(seq), 0) AS head FROM fx_log), c AS (SELECT c_custkey AS consumer, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 17 - 20 END AS seq FROM customer),
f AS (SELECT consumer, seq, head, coalesce(seq <= head AND (oldest IS NULL OR seq >= oldest - 1), false) AS can FROM c, e)
SELECT consumer, CASE WHEN can THEN 'replay' ELSE 'snapshot' END AS how, CASE WHEN can THEN seq ELSE head END AS from_seq FROM f""",
            "fx_log",
        ),
        "event_sink": "SELECT event_id AS change_id, event_type, 5000 + row_number() OVER (ORDER BY ts, event_id) AS seq FROM events",
        "reports_messages": with_views(" SELECT report_id, post_id, type, length(text)::INT AS n_chars FROM fx_reports r JOIN fx_posts p ON p.post_id * 2 = r.report_id", "fx_reports", "fx_posts"),
        "cache_time_shift": with_views(" SELECT post_id, posted_at + to_minutes(post_id % 90 - 45) AS observed_at FROM fx_posts WHERE post_id % 2 = 0", "fx_posts"),
        "time_travel": with_views(
            _FILLED + f""", t AS (SELECT * FROM (VALUES {times}) AS v("at"))
SELECT DISTINCT "at", 'alert' AS kind, region AS key FROM t JOIN c ON level > 0 AND poll_at <= "at" AND (ended_at IS NULL OR ended_at > "at")
UNION ALL SELECT DISTINCT "at", 'track', channel_no FROM t JOIN fx_reports ON observed_at <= "at" AND observed_at > "at" - INTERVAL 60 MINUTE""",
            "fx_alert_polls",
            "fx_reports",
        ),
        "snapshot_write": with_views(
            _FILLED + f""", s AS (SELECT 'alert' AS kind, region AS key, level::BIGINT AS value FROM c WHERE level > 0 AND poll_at <= TIMESTAMP '{NOW}' AND (ended_at IS NULL OR ended_at > TIMESTAMP '{NOW}')
  UNION ALL SELECT 'track', track_id, count(*) FROM fx_tracked GROUP BY track_id UNION ALL SELECT 'source', channel_no, count(*) FROM fx_reports WHERE observed_at <= TIMESTAMP '{NOW}' GROUP BY channel_no)
SELECT s.*, (SELECT max(seq) FROM fx_log) AS seq FROM s""",
            "fx_alert_polls",
            "fx_tracked",
            "fx_reports",
            "fx_log",
        ),
        "notify_cursor": with_views(" SELECT coalesce(max(report_id), 50) AS cursor, count(*) AS n FROM (SELECT report_id FROM fx_reports WHERE report_id > 50 ORDER BY report_id LIMIT 300)", "fx_reports"),
        "batch_stats": with_views(" SELECT report_id // 300 AS batch, count(*) AS scanned, count(*) FILTER (WHERE report_id % 3 = 0) AS sent, count(DISTINCT channel_no) FILTER (WHERE report_id % 3 = 0) AS recipients FROM fx_reports GROUP BY 1", "fx_reports"),
        "dry_run": with_views(_MATCHES + "SELECT reason, type, count(*) AS n, count(DISTINCT subscriber_id) AS n_readers FROM m WHERE reason IS NOT NULL GROUP BY reason, type", "fx_reports", "fx_subscribers"),
        "nearest_live": with_views(
            " SELECT report_id, round(2 * 6371.0e0 * asin(sqrt(pow(sin(radians(lat - 50.45e0) / 2), 2) + cos(radians(50.45e0)) * cos(radians(lat)) * pow(sin(radians(lon - 30.52e0) / 2), 2))), 6) AS km FROM fx_tracked ORDER BY km, report_id LIMIT 5", "fx_tracked"
        ),
        "retention": "SELECT what, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-30' - age) AS n_kept FROM (VALUES ('messages', INTERVAL 90 DAY), ('ledger', INTERVAL 24 HOUR), ('cache', INTERVAL 30 DAY), ('tracks', INTERVAL 7 DAY), ('events', INTERVAL 6 HOUR)) AS v(what, age)",
        "region_of_live_location": with_views(
            _CORNERS + f""", u AS (SELECT user_id, arg_max({{'a': 44.5e0 + (event_id * 31 % 700) * 0.01e0, 'b': 22.5e0 + (event_id * 17 % 1700) * 0.01e0}}, (ts, event_id)) AS x FROM events GROUP BY user_id),
p AS (SELECT user_id, x.a AS lat, x.b AS lon FROM u), k AS (SELECT user_id, region, {inside} AS inside FROM p, s GROUP BY 1, 2) SELECT user_id, min(region) AS region FROM k WHERE inside GROUP BY user_id""",
            "fx_polygons",
        ),
        "region_ids_covered": f"""SELECT DISTINCT region_id FROM ({desired}) WHERE region_id NOT IN (SELECT unnest(['oblast:' || region, 'raion:' || region || ':' || district]) FROM (VALUES ('sumska', 'сумський'), ('sumska', 'охтирський'), ('sumska', 'конотопський'),
  ('ternopilska', 'тернопільський'), ('ternopilska', 'кременецький'), ('ternopilska', 'чортківський'), ('odeska', 'одеський'), ('odeska', 'ізмаїльський'), ('kharkivska', 'ізюмський')) AS v(region, district))""",
        "concerns": f"SELECT viewer_id, track_id FROM ({near}) WHERE kind = 'approach'",
        "track_order": with_views(
            f""", t AS (SELECT type, track_id, TIMESTAMP '{NOW}' - to_minutes(min(ago)) AS last_seen FROM fx_tracked GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY type ORDER BY last_seen DESC, track_id)::INT AS place FROM t""",
            "fx_tracked",
        ),
        "page_messages": """SELECT lower(source) AS channel, doc_id AS message_id, '2024-01-15' AS posted_at, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Line & one' || chr(10) || 'two ' || doc_id || chr(10) || chr(10) || 'ї' END AS text, doc_id % 3 = 0 AS has_media
FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0""",
        "places_load": "SELECT p_partkey AS place_id, p_name AS name, NULL::VARCHAR AS region, CASE p_partkey % 3 WHEN 0 THEN -1 ELSE p_size END::BIGINT AS population FROM part UNION ALL SELECT -p_partkey, 'x', 'sumska', 1 FROM part",
        "places_etl": """SELECT p_partkey AS node_id, name, population::BIGINT AS population, region, spelling FROM part JOIN (VALUES (1, 'Суми', 12000, 'sumska', 'Суми'), (1, 'Суми', 12000, 'sumska', 'Sumy'), (2, 'Ромни', 0, 'sumska', 'Ромни'),
  (2, 'Ромни', 0, 'sumska', 'Ромен'), (3, 'Київ', 0, 'kyiv', 'Київ')) AS v(k, name, population, region, spelling) ON p_partkey % 4 = k""",
        "polygons_load": """SELECT n_nationkey::BIGINT AS region, 0 AS part, 1.0e0 AS south, 4.0e0 AS north, n_nationkey::DOUBLE AS west, n_nationkey + 3.0e0 AS east FROM nation WHERE n_nationkey % 3 <> 2
UNION ALL SELECT n_nationkey, 1, 5.0e0, 9.0e0, 5.0e0, 6.0e0 FROM nation WHERE n_nationkey % 3 = 1""",
        "table_migrate": "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, 'new' AS state, 0 AS tries FROM supplier",
        "table_reconcile": "SELECT count(*) AS n_source, count(*) AS n_target, true AS same FROM supplier",
    }
