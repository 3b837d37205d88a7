"""Archived pages and reference data as rows. All in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid.functions.text import html_text

# The first two digits of an administrative code, and the region.
CODES = {
    "01": "krym", "05": "vinnytska", "07": "volynska", "12": "dnipropetrovska", "14": "donetska", "18": "zhytomyrska", "21": "zakarpatska", "23": "zaporizka", "26": "ivano-frankivska",
    "32": "kyivska", "35": "kirovohradska", "44": "luhanska", "46": "lvivska", "48": "mykolaivska", "51": "odeska", "53": "poltavska", "56": "rivnenska", "59": "sumska", "61": "ternopilska",
    "63": "kharkivska", "65": "khersonska", "68": "khmelnytska", "71": "cherkaska", "73": "chernivetska", "74": "chernihivska", "80": "kyiv", "85": "krym",
}
_MEDIA = "tgme_widget_message_(photo_wrap|video_player|document|voice|roundvideo_player|sticker)\\b"


def _inner(rest: Column) -> Column:
    """What stands before the end of a block that was open when ``rest`` began, blocks within it included; without an end, all of it."""
    parts = F.split(rest, r"(?i)(?=</?div\b)")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def step(s, part):
        depth = s["depth"] + F.when(part.rlike(r"(?i)^</div\b"), -1).when(part.rlike(r"(?i)^<div\b"), 1).otherwise(0)
        inside = (s["depth"] > 0) & (depth > 0)
        return F.struct(F.when(s["depth"] > 0, depth).otherwise(0).alias("depth"), (s["n"] + inside.cast("int")).alias("n"))

    n = F.aggregate(parts, start, step, lambda s: s["n"])
    return F.array_join(F.slice(parts, F.lit(1), n), "")


def page_messages(pages: DataFrame) -> DataFrame:
    """(channel, message_id, posted_at, text, has_media) of pages (channel, html), whose messages stand in blocks of their own.

    A block of another channel, without a positive number or a readable time gives no row; a message without text (a reply's
    preview is none) has ''. The markup is that of the public channel pages: one wrapper a message, no nested ones; a text may hold
    blocks of its own.
    """
    parts = F.split("html", r'(?=<div class="tgme_widget_message_wrap)')
    blocks = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    rows = pages.select(F.lower("channel").alias("channel"), F.explode(blocks).alias("b"))
    post = r'data-post="([^"/]+(?:/[^"/]+)*)/(\d+)[^"]*"'
    found = rows.select(
        "channel",
        F.lower(F.regexp_extract("b", post, 1)).alias("of"),
        F.regexp_extract("b", post, 2).try_cast("long").alias("message_id"),
        F.try_to_timestamp(F.regexp_extract("b", r'(?s)tgme_widget_message_date.*?<time[^>]*datetime="([^"]*)"', 1)).alias("posted_at"),
        _inner(F.regexp_extract("b", r'(?s)<div class="[^"]*js-message_text[^"]*"[^>]*>(.*)', 1)).alias("inner"),
        F.col("b").rlike(_MEDIA).alias("has_media"),
    )
    found = found.where("of = channel and message_id > 0 and posted_at is not null")
    return found.select("channel", "message_id", "posted_at", html_text(F.col("inner")).alias("text"), "has_media")


def places_load(files: DataFrame) -> DataFrame:
    """(place_id, name, region, place, population, lat, lon) of JSON files of ``columns`` and ``rows`` (arrays of text in that order)."""
    parsed = files.select(F.from_json("raw", "columns array<string>, rows array<array<string>>").alias("j"))
    rows = parsed.select("j.columns", F.posexplode("j.rows").alias("i", "r")).withColumn("m", F.map_from_arrays("columns", "r"))
    get = lambda k, kind="string": F.try_element_at("m", F.lit(k)).try_cast(kind).alias(k)
    return rows.select(get("place_id", "long"), get("name"), get("region"), get("place"), get("population", "long"), get("lat", "double"), get("lon", "double"))


def places_etl(nodes: DataFrame) -> DataFrame:
    """(node_id, name, population, region, spelling) of map nodes (node_id, tags as JSON): a name in Cyrillic, the Ukrainian one first; digits of
    the population; the region by code; a row for each spelling."""
    t = F.from_json("tags", "map<string,string>")
    tag = lambda k: F.try_element_at(F.col("t"), F.lit(k))
    rows = nodes.withColumn("t", t).withColumn("name", F.coalesce(tag("name:uk"), tag("name"))).where(F.col("name").rlike(r"[\x{0400}-\x{04FF}]"))
    code = F.coalesce(F.regexp_extract(tag("katotth"), r"^UA(\d\d)", 1), F.regexp_extract(tag("koatuu"), r"^(\d\d)", 1))
    region = F.try_element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), code)
    population = F.regexp_replace(tag("population"), r"\D", "").try_cast("long")
    spellings = F.array_distinct(F.array_compact(F.array(F.col("name"), tag("name"), tag("alt_name"), tag("old_name"))))
    return rows.select("node_id", "name", F.coalesce(population, F.lit(0)).alias("population"), region.alias("region"), F.explode(spellings).alias("spelling"))


def polygons_load(files: DataFrame) -> DataFrame:
    """(region, part, south, north, west, east, n_points) of the outer rings in GeoJSON features (key, geometry as JSON): polygons and multipolygons."""
    kind = F.get_json_object("geometry", "$.type")
    multi = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<array<double>>>>")
    single = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>")
    outer = F.when(kind == "Polygon", F.array(F.get(single, F.lit(0)))).when(kind == "MultiPolygon", F.transform(multi, lambda p: F.get(p, F.lit(0))))
    rows = files.select("region", F.posexplode(outer).alias("part", "ring"))
    x, y = F.transform("ring", lambda p: F.get(p, F.lit(0))), F.transform("ring", lambda p: F.get(p, F.lit(1)))
    return rows.select("region", "part", F.array_min(y).alias("south"), F.array_max(y).alias("north"), F.array_min(x).alias("west"), F.array_max(x).alias("east"), F.size("ring").alias("n_points"))


def migrate(source: DataFrame | None, columns: dict[str, tuple[str, object]], target: DataFrame | None = None, force: bool = False) -> DataFrame | None:
    """``source`` with the columns of a table: {name: (type, default)}. A missing source is skipped (None), a missing column takes its
    default, one too many is an error, and so is a target with rows, unless forced."""
    if target is not None and not force and not target.isEmpty():
        raise ValueError("the target has rows")
    if source is None:
        return None
    if extra := [c for c in source.columns if c not in columns]:
        raise ValueError(f"unknown columns: {', '.join(sorted(extra))}")
    return source.select(*[(F.col(c) if c in source.columns else F.lit(default)).cast(kind).alias(c) for c, (kind, default) in columns.items()])


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: rows of both sides and whether they agree."""
    a, b = source.agg(F.count("*").alias("n_source")), target.agg(F.count("*").alias("n_target"))
    return a.crossJoin(F.broadcast(b)).withColumn("same", F.col("n_source") == F.col("n_target"))
