"""Queries of clauses and places, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog_state import _CORNERS, rings
from watchgrid.catalog_text import _case, _has, lines, re2
from watchgrid.functions import clauses as cl
from watchgrid.functions import text as tx
from watchgrid.operators import places, regions
from watchgrid.sources.fixtures import view, with_views


def lexicon(spark, sf):
    return view(spark, sf, "fx_lexicon")


def q_raw_type(spark, sf):
    return lines(spark, sf).select("post_id", "line", cl.raw_type(F.col("text")).alias("raw_type"))


def q_clauses(spark, sf):
    # two posts' lines as one gives lines of several clauses
    both = lines(spark, sf).select("post_id", "line", F.concat("text", F.lit(", "), "text").alias("text"))
    return both.select("post_id", "line", F.posexplode(cl.clauses(F.col("text"))).alias("clause", "text"))


def _cues(spark, sf):
    return lines(spark, sf).select("post_id", "line", F.posexplode(cl.cues(F.col("text"))).alias("nth", "cue"))


def q_relation(spark, sf):
    rows = _cues(spark, sf).withColumn("relation", cl.relation(F.col("cue")))
    return rows.groupBy("post_id", "line").agg(F.count("*").alias("n_cues"), F.max_by("relation", F.struct(cl.rank(F.col("relation")), -F.col("nth"))).alias("relation"))


def q_candidates(spark, sf):
    p = view(spark, sf, "fx_phrases")
    text = F.expr("CASE mention_id % 4 WHEN 0 THEN ' (північну ' || phrase WHEN 1 THEN 'м. ' || phrase WHEN 2 THEN 'село ' || phrase ELSE phrase END")
    return p.select("mention_id", F.array_join(cl.place_candidates(text), "|").alias("names"))


def q_evidence(spark, sf):
    kind = tx.classify_type(F.col("text"))
    inferred = tx.infer_bare_type(F.col("text")).isNotNull()
    long = lines(spark, sf).select("post_id", "line", F.concat_ws(" ", F.lit("раз два три чотири слова і ще"), "text").alias("text"))
    return long.select("post_id", "line", cl.has_evidence(F.col("text"), kind, inferred, tx.extract_count(F.col("text"))).alias("kept"))


def q_confidence(spark, sf):
    r = view(spark, sf, "fx_reports")
    found = cl.report_confidence(F.col("confidence"), F.col("type"), F.col("report_id") % 5 == 0, F.col("report_id") % 3 == 0)
    return r.select("report_id", F.round(found, 6).alias("confidence"))


def q_launchable(spark, sf):
    return view(spark, sf, "fx_reports").select("report_id", cl.launchable(F.col("type"), F.when(F.col("report_id") % 2 == 0, "Чорне море").otherwise("Суми")).alias("launchable"))


def q_forms(spark, sf):
    return places.place_forms(lexicon(spark, sf))


def q_forms_union(spark, sf):
    stored = lexicon(spark, sf).select("place_id", F.lower("name").alias("form"))
    return places.forms_union(stored, q_forms(spark, sf)).groupBy("place_id").agg(F.count("*").alias("n_forms"))


def q_regions(spark, sf):
    tokens = view(spark, sf, "fx_phrases").select("mention_id", F.regexp_extract("phrase", r"^(\S+)", 1).alias("token"))
    return places.region_match(tokens)


def q_waters(spark, sf):
    return places.water_match(view(spark, sf, "fx_phrases").select("mention_id", "phrase"))


def q_resolve(spark, sf):
    p = lexicon(spark, sf)
    return places.place_resolve(view(spark, sf, "fx_phrases"), p, places.place_forms(p))


def q_pick(spark, sf):
    return q_resolve(spark, sf).groupBy("match_kind", "confidence").agg(F.count("*").alias("n"))


def q_audit(spark, sf):
    """How often a misspelt phrase is taken for a place, with one of its mentions."""
    found = q_resolve(spark, sf).where("match_kind = 'fuzzy'").join(view(spark, sf, "fx_phrases").select("mention_id", "phrase"), "mention_id")
    return found.groupBy("phrase", "name", "region").agg(F.count("*").alias("n"), F.min("mention_id").alias("sample"))


def q_nearest(spark, sf):
    points = view(spark, sf, "fx_subscribers").select(F.col("subscriber_id").alias("point_id"), "lat", "lon")
    return places.nearest_place(points, lexicon(spark, sf))


def q_backfill(spark, sf):
    """Regions of located subscribers that have none: of the polygon they lie in; outside of all they keep none."""
    s = view(spark, sf, "fx_subscribers").select("subscriber_id", "lat", "lon", F.when(F.col("subscriber_id") % 4 == 0, F.col("subscriber_id") % 25).alias("region"))
    asked = s.where("region is null and lat is not null and lon is not null").select(F.col("subscriber_id").alias("point_id"), "lat", "lon")
    found = regions.point_in_region(asked, rings(spark, sf)).select(F.col("point_id").alias("subscriber_id"), F.col("region").alias("r"))
    return s.join(found, "subscriber_id", "left").select("subscriber_id", F.coalesce("region", "r").cast("string").alias("region"))


def q_in_region(spark, sf, region: int = 12):
    """Tracks with any point in a region."""
    points = view(spark, sf, "fx_tracked").select(F.col("report_id").alias("point_id"), "lat", "lon")
    inside = regions.point_in_region(points, rings(spark, sf).where(F.col("region") == region))
    return view(spark, sf, "fx_tracked").join(inside.select(F.col("point_id").alias("report_id")), "report_id", "left_semi").select("track_id").distinct()


def q_by_region(spark, sf):
    """Tracks of every region: its outer ring and, in the middle of it, a hole."""
    outer = rings(spark, sf)
    middle = view(spark, sf, "fx_polygons").selectExpr("region", "lat0 + 0.5e0 AS a", "lon0 + 1.0e0 AS b").selectExpr(
        "region", "array(struct(a as lat, b as lon), struct(a as lat, b + 1.0e0 as lon), struct(a + 0.5e0 as lat, b + 1.0e0 as lon), struct(a + 0.5e0 as lat, b as lon)) AS ring"
    )
    t = view(spark, sf, "fx_tracked").select("report_id", "track_id", "lat", "lon")
    found = regions.regions_of(t.select(F.col("report_id").alias("point_id"), "lat", "lon"), outer.select("region", "ring").union(middle))
    return t.join(found.withColumnRenamed("point_id", "report_id"), "report_id").select("track_id", "region").distinct()


def queries() -> dict:
    return {
        "tracks_by_region": q_by_region,
        "raw_type": q_raw_type,
        "split_lines_clauses": q_clauses,
        "relation": q_relation,
        "place_candidates": q_candidates,
        "untyped_evidence": q_evidence,
        "report_confidence": q_confidence,
        "launchable": q_launchable,
        "place_forms": q_forms,
        "forms_union": q_forms_union,
        "region_match": q_regions,
        "water_match": q_waters,
        "place_resolve": q_resolve,
        "pick_confidence": q_pick,
        "fuzzy_audit": q_audit,
        "nearest_place": q_nearest,
        "region_backfill": q_backfill,
        "tracks_in_region": q_in_region,
    }


def oracle_sql() -> dict:
    l = lambda q, text="text": with_views(f", l0 AS (SELECT post_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INT AS line FROM fx_posts), l AS (SELECT post_id, line, {text} AS text FROM l0) {q}", "fx_posts")  # noqa: E731, E741
    squeezed = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')"
    split = r"regexp_split_to_array(t, '\s*[,;]\s+')"
    cues = "|".join(p for _, p in cl.CUES)
    # the edge before a cue is taken along, so a space is doubled for cues that follow each other
    every = f"regexp_extract_all(replace(text, ' ', '  '), '(?i)(?:^|[^\\p{{L}}\\p{{N}}])((?:{cues})\\s)', 1)"
    kind = _case([(f"regexp_matches(c, '(?i)^({p})$')", f"'{n}'") for n, p in cl.CUES], "'towards'")
    order = _case([(f"r = '{k}'", v) for k, v in cl.RANK.items()])
    name = lambda t: f"regexp_extract({t}, '{cl.PLACE}', 1)"
    kinds = _case([(_has("text", [x]), f"'{t}'") for t, x in tx.TYPES], "'unknown'")
    waters = ", ".join(f"('{f}', '{n}')" for n, _, _, found in places.WATERS for f in found)
    words = r"""list_filter(list_transform(string_split(trim(regexp_replace(replace(lower(phrase), '’', ''''), '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[«"(]+|[»".,;:!?)]+$', '', 'g')), lambda w: w <> '')"""
    inside = "sum(CASE WHEN (lat1 > lat) <> (lat2 > lat) AND lon < (lon2 - lon1) * (lat - lat1) / nullif(lat2 - lat1, 0) + lon1 THEN 1 ELSE 0 END) % 2 = 1"
    return {
        "raw_type": l(f"SELECT post_id, line, nullif(regexp_extract(text, '(?i){cl.RAW_TYPE}', 1), '') AS raw_type FROM l"),
        "split_lines_clauses": l(
            f"""SELECT post_id, line, unnest(x) AS text, unnest(range(len(x)))::INT AS clause FROM (
  SELECT post_id, line, CASE WHEN len(list_filter({split}, lambda c: regexp_matches(c, '(?i){cl.SELF_CONTAINED}'))) > 1 THEN {split} ELSE [t] END AS x FROM (SELECT post_id, line, {squeezed} AS t FROM l))""",
            "text || ', ' || text",
        ),
        "relation": l(
            f""", e AS (SELECT post_id, line, unnest({every}) AS c0, unnest(range(len({every}))) AS nth FROM l), f AS (SELECT post_id, line, nth, regexp_replace(lower(trim(c0)), '\\s+', ' ', 'g') AS c FROM e),
g AS (SELECT *, {kind} AS r FROM f) SELECT post_id, line, count(*) AS n_cues, arg_max(r, ({order}, -nth)) AS relation FROM g GROUP BY post_id, line"""
        ),
        "place_candidates": with_views(
            f""", a AS (SELECT mention_id, regexp_replace(CASE mention_id % 4 WHEN 0 THEN ' (північну ' || phrase WHEN 1 THEN 'м. ' || phrase WHEN 2 THEN 'село ' || phrase ELSE phrase END, '{cl.NOISE}', '') AS p FROM fx_phrases),
b AS (SELECT mention_id, p, regexp_replace(regexp_replace(p, '(?i){cl.COMPASS}', ''), '{cl.NOISE}', '') AS q FROM a),
c AS (SELECT mention_id, {name('p')} AS x, CASE WHEN q <> p THEN {name('q')} ELSE '' END AS y FROM b)
SELECT mention_id, CASE WHEN x = '' OR x = y THEN y WHEN y = '' THEN x ELSE x || '|' || y END AS names FROM c""",
            "fx_phrases",
        ),
        "untyped_evidence": l(
            f"SELECT post_id, line, NOT ({kinds} = 'unknown' AND NOT {_has('text', [tx.BARE])} AND len(regexp_split_to_array(text, '\\s+')) > 8 AND NOT {_has('text', [cl.EVIDENCE])}) AS kept FROM l",
            "CASE WHEN text = '' THEN 'раз два три чотири слова і ще ' ELSE 'раз два три чотири слова і ще ' || text END",
        ),
        "report_confidence": with_views(" SELECT report_id, round(confidence * CASE WHEN report_id % 3 = 0 THEN CASE WHEN report_id % 5 = 0 THEN 0.7e0 ELSE 0.8e0 END WHEN type = 'unknown' THEN 0.7e0 WHEN report_id % 5 = 0 THEN 0.85e0 ELSE 1.0e0 END, 6) AS confidence FROM fx_reports", "fx_reports"),
        "launchable": with_views(" SELECT report_id, type IN ('uav', 'jet_uav', 'cruise', 'ballistic') AND report_id % 2 = 0 AS launchable FROM fx_reports", "fx_reports"),
        "water_match": with_views(
            f""", v AS (SELECT * FROM (VALUES {waters}) AS v(form, water)), w AS (SELECT mention_id, phrase, {words} AS w FROM fx_phrases)
SELECT mention_id, phrase, coalesce(a.water, b.water) AS water FROM w LEFT JOIN v a ON len(w) >= 3 AND a.form = array_to_string(w[1:3], ' ') LEFT JOIN v b ON len(w) >= 2 AND b.form = array_to_string(w[1:2], ' ')""",
            "fx_phrases",
        ),
        "nearest_place": with_views(
            """ SELECT subscriber_id AS point_id, arg_min(place_id, (pow(p.lat - s.lat, 2) + 0.41e0 * pow(p.lon - s.lon, 2), place_id)) AS place_id, arg_min(region, (pow(p.lat - s.lat, 2) + 0.41e0 * pow(p.lon - s.lon, 2), place_id)) AS region
FROM fx_subscribers s, fx_lexicon p WHERE s.lat IS NOT NULL AND s.lon IS NOT NULL AND region IS NOT NULL GROUP BY subscriber_id""",
            "fx_subscribers",
            "fx_lexicon",
        ),
        "region_backfill": with_views(
            _CORNERS + f""", k AS (SELECT subscriber_id, region, {inside} AS inside FROM fx_subscribers, s WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2)
SELECT u.subscriber_id, CAST(CASE WHEN u.subscriber_id % 4 = 0 THEN u.subscriber_id % 25 ELSE min(k.region) END AS VARCHAR) AS region FROM fx_subscribers u LEFT JOIN k ON k.subscriber_id = u.subscriber_id AND k.inside GROUP BY u.subscriber_id""",
            "fx_subscribers",
            "fx_polygons",
        ),
        "tracks_by_region": with_views(
            _CORNERS + f""", h AS (SELECT region, lat0 + 0.5e0 AS a, lon0 + 1.0e0 AS b FROM fx_polygons),
s2 AS (SELECT region, lat1, lon1, lat2, lon2 FROM s UNION ALL SELECT region, a, b, a, b + 1.0e0 FROM h UNION ALL SELECT region, a, b + 1.0e0, a + 0.5e0, b + 1.0e0 FROM h
  UNION ALL SELECT region, a + 0.5e0, b + 1.0e0, a + 0.5e0, b FROM h UNION ALL SELECT region, a + 0.5e0, b, a, b FROM h),
k AS (SELECT report_id, track_id, region, {inside} AS inside FROM fx_tracked, s2 GROUP BY 1, 2, 3) SELECT DISTINCT track_id, region FROM k WHERE inside""",
            "fx_tracked",
            "fx_polygons",
        ),
        "tracks_in_region": with_views(
            _CORNERS + f", k AS (SELECT report_id, track_id, {inside} AS inside FROM fx_tracked, s WHERE region = 12 GROUP BY 1, 2) SELECT DISTINCT track_id FROM k WHERE inside", "fx_tracked", "fx_polygons"
        ),
    }
