"""Alert feeds as rows, and what they mean for regions and subscribers. All in built-in functions.

A feed that doesn't look as expected gives no rows at all: read as truth it would be an all-clear for everyone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid.functions.text import normalise_area

# Key, name and number of districts of each region.
REGIONS = [
    ("vinnytska", "Вінницька", 6),
    ("volynska", "Волинська", 4),
    ("dnipropetrovska", "Дніпропетровська", 7),
    ("donetska", "Донецька", 8),
    ("zhytomyrska", "Житомирська", 4),
    ("zakarpatska", "Закарпатська", 6),
    ("zaporizka", "Запорізька", 5),
    ("ivano-frankivska", "Івано-Франківська", 6),
    ("kyivska", "Київська", 7),
    ("kirovohradska", "Кіровоградська", 4),
    ("luhanska", "Луганська", 8),
    ("lvivska", "Львівська", 7),
    ("mykolaivska", "Миколаївська", 4),
    ("odeska", "Одеська", 7),
    ("poltavska", "Полтавська", 4),
    ("rivnenska", "Рівненська", 4),
    ("sumska", "Сумська", 5),
    ("ternopilska", "Тернопільська", 3),
    ("kharkivska", "Харківська", 7),
    ("khersonska", "Херсонська", 5),
    ("khmelnytska", "Хмельницька", 3),
    ("cherkaska", "Черкаська", 4),
    ("chernivetska", "Чернівецька", 3),
    ("chernihivska", "Чернігівська", 5),
    ("krym", "Крим", 35),
    ("kyiv", "Київ", 0),
]
# The order of the one-character feed.
ORDER = [*(k for k, _, _ in REGIONS if k not in ("krym", "kyiv")), "kyiv", "krym", "sevastopol"]
# Names of regions that aren't built from the table above.
NAMES = {f"{name} область": key for key, name, _ in REGIONS if key not in ("krym", "kyiv")} | {"м. Київ": "kyiv", "Київ": "kyiv", "Автономна Республіка Крим": "krym"}
#: More names of the list of states.
STATE_NAMES = NAMES | {"Київ область": "kyiv", "АР Крим": "krym"}
LEAST_STATES = 20


def _keyed(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def fixed_string(feeds: DataFrame) -> DataFrame:
    """(poll_id, region, level) of a string of one character a region: A is full, P partial, all else none; a shorter string gives no rows."""
    whole = feeds.where(F.length("raw") >= len(ORDER)).withColumn("order", F.array(*map(F.lit, ORDER)))
    flags = whole.select("poll_id", "raw", F.posexplode("order").alias("i", "region"))
    flag = F.col("raw").substr(F.col("i") + 1, F.lit(1))
    return flags.select("poll_id", "region", F.when(flag == "A", "full").when(flag == "P", "partial").otherwise("none").alias("level"))


def states(feeds: DataFrame) -> DataFrame:
    """(poll_id, name, region, level) of a JSON list of (name, alert); fewer than 20 entries, or no list, give no rows. Unknown
    names have a null region and level."""
    listed = feeds.withColumn("s", F.from_json("raw", "array<struct<name:string,alert:boolean>>")).where(F.size("s") >= LEAST_STATES)
    rows = listed.select("poll_id", F.explode("s").alias("s")).select("poll_id", F.trim("s.name").alias("name"), "s.alert")
    region = F.try_element_at(_keyed(STATE_NAMES), F.col("name"))
    level = F.when(F.coalesce("alert", F.lit(False)), "full").otherwise("none")
    return rows.select("poll_id", "name", region.alias("region"), F.when(region.isNotNull(), level).alias("level"))


def _section(title: str) -> Column:
    return F.regexp_extract("raw", rf"(?s)## {title}(.*?)(?=\n## )", 1)


def sitrep(feeds: DataFrame) -> DataFrame:
    """(poll_id, region, level, areas) of a situation report; without its section 3 no rows, else a row for each region.

    A region is full when its named districts are as many as it has, partial where an air raid alert names fewer; standing
    paragraphs and other threats don't count. Of a region's paragraphs the last one counts, as do areas of the last that names any.
    """
    shaped = feeds.where(F.col("raw").rlike(r"(?s)## 3\. CURRENT WARNING STATUS.*?\n## "))
    text = F.transform(F.split(_section(r"3\. CURRENT WARNING STATUS"), "\n"), lambda x: F.trim(x))
    text = F.filter(text, lambda x: x.startswith("**") & ~x.rlike("(?i)Nominal alerts|Cross-border launch-site"))
    named = r"\*\*[^(*]*\(([^)]+)\)\*\*\s*—\s*(.*)"
    region = lambda x: F.try_element_at(_keyed(NAMES), F.trim(F.regexp_extract(x, named, 1)))
    raid = lambda x: F.lower(F.regexp_extract(x, named, 2)).contains("air raid alert")
    lines = F.filter(F.transform(text, lambda x: F.named_struct(F.lit("region"), region(x), F.lit("line"), x)), lambda x: x["region"].isNotNull() & raid(x["line"]))
    brackets = lambda x: F.regexp_extract_all(F.regexp_extract(x, r"(?i)areas? affected:(.*)$", 1), F.lit(r"\(([^)]+)\)"), 1)
    areas = lambda x: F.array_distinct(F.transform(F.filter(brackets(x), lambda y: y.rlike(r"[\x{0400}-\x{04FF}]")), lambda y: normalise_area(F.trim(y))))
    lines = F.transform(lines, lambda x: F.named_struct(F.lit("region"), x["region"], F.lit("areas"), areas(x["line"])))
    total = lambda x: F.element_at(_keyed({k: n for k, _, n in REGIONS}), x["region"])
    districts = lambda x: F.size(F.filter(x["areas"], lambda y: y.rlike("ий$")))
    # a report is read in its own row, so nothing is shuffled or sent to the driver
    rows = shaped.select("poll_id", lines.alias("lines")).select("poll_id", "lines", F.explode(F.array(*[F.lit(k) for k, _, _ in REGIONS])).alias("region"))
    rows = rows.select("poll_id", "region", F.filter("lines", lambda x: x["region"] == F.col("region")).alias("own"))
    last = F.try_element_at("own", F.lit(-1))
    level = F.when(last.isNull(), "none").when((total(last) > 0) & (districts(last) >= total(last)), "full").otherwise("partial")
    names = F.try_element_at(F.filter("own", lambda x: F.size(x["areas"]) > 0), F.lit(-1))["areas"]
    return rows.select("poll_id", "region", level.alias("level"), F.coalesce(names, F.array().cast("array<string>")).alias("areas"))


def threats(feeds: DataFrame) -> DataFrame:
    """(poll_id, i, at, kind, place) of the bullets in section 4."""
    lines = feeds.select("poll_id", F.posexplode(F.transform(F.split(_section(r"4\. THREAT ACTIVITY"), "\n"), lambda x: F.trim(x))).alias("i", "line"))
    shape = r"^-\s*\*\*(\d{2}:\d{2})\s*—\s*([^*(]+)(?:\([^)]*\))?\*\*\s*over\s*([^—]+)"
    found = lines.where(F.col("line").rlike(shape))
    return found.select("poll_id", "i", *[F.trim(F.regexp_extract("line", shape, k)).alias(c) for k, c in ((1, "at"), (2, "kind"), (3, "place"))])


def district_states(levels: DataFrame, districts: DataFrame) -> DataFrame:
    """(poll_id, region, district, active) for every district of a region: an inactive region has none active; where nothing
    named is a district, all are.

    ``levels``: poll_id, region, level, areas; ``districts``: region, district (bounded: those of a country).
    """
    of = F.broadcast(districts.groupBy("region").agg(F.collect_list("district").alias("districts")))
    rows = levels.join(of, "region").withColumn("any_named", F.arrays_overlap("areas", "districts"))
    rows = rows.select("poll_id", "region", "level", "areas", "any_named", F.explode("districts").alias("district"))
    active = F.col("level").isin("partial", "full") & (F.array_contains("areas", F.col("district")) | ~F.col("any_named"))
    return rows.select("poll_id", "region", "district", active.alias("active"))


def subscriber_alerts(subscribers: DataFrame, changes: DataFrame) -> DataFrame:
    """(subscriber_id, kind): start or stop for the subscriber's own district; only without one, for the region.

    ``subscribers``: subscriber_id, region, district; ``changes``: region, district (null for a region's own change), kind. Starts go first.
    """
    first = F.min("kind").alias("kind")  # start sorts before stop
    near = changes.where("district is not null").groupBy("district").agg(first)
    wide = changes.where("district is null").groupBy("region").agg(first)
    own = subscribers.where("district is not null").join(near, "district").select("subscriber_id", "kind")
    return own.union(subscribers.where("district is null").join(wide, "region").select("subscriber_id", "kind"))


def desired_alerts(levels: DataFrame, districts: DataFrame) -> DataFrame:
    """(poll_id, region_id, region, level, severity, areas): a full region is one red row; of a partial one, named districts are
    red rows of their own and all else named one yellow row; naming nothing, it is yellow as a whole."""
    of = F.broadcast(districts.groupBy("region").agg(F.collect_set("district").alias("districts")))
    rows = levels.where("level <> 'none'").join(of, "region", "left").withColumn("districts", F.coalesce("districts", F.array().cast("array<string>")))
    rows = rows.withColumns({"named": F.array_distinct("areas"), "full": F.col("level") == "full"})
    rest = F.array_sort(F.array_except("named", "districts"))
    none = F.array().cast("array<string>")
    whole = F.concat(F.lit("oblast:"), "region")
    row = lambda name, level, severity, areas: F.struct(name.alias("region_id"), F.lit(level).alias("level"), F.lit(severity).alias("severity"), areas.alias("areas"))
    red = F.transform(F.array_intersect("named", "districts"), lambda d: row(F.concat(F.lit("raion:"), F.col("region"), F.lit(":"), d), "raion", "full", none))
    yellow = F.when(F.size(rest) > 0, F.array(row(whole, "hromada", "partial", rest))).when(F.size("named") == 0, F.array(row(whole, "oblast", "partial", none))).otherwise(F.array().cast("array<struct<region_id:string,level:string,severity:string,areas:array<string>>>"))
    out = F.when(F.col("full"), F.array(row(whole, "oblast", "full", none))).otherwise(F.concat(red, yellow))
    return rows.select("poll_id", "region", F.explode(out).alias("x")).select("poll_id", "x.region_id", "region", "x.level", "x.severity", "x.areas")


def region_states(alerts: DataFrame) -> DataFrame:
    """(region_id, level, n_alerts, areas) of open alerts: 2 (red) for a district or a full alert that isn't of a community, else 1; the
    most counts. Areas are distinct and sorted."""
    open_ = alerts.where("ended_at is null")
    red = F.col("region_id").startswith("raion:") | ((F.col("level") != "hromada") & (F.col("severity") == "full"))
    areas = F.array_sort(F.array_distinct(F.flatten(F.collect_list("areas"))))
    return open_.groupBy("region_id").agg(F.max(F.when(red, 2).otherwise(1)).alias("level"), F.count("*").alias("n_alerts"), areas.alias("areas"))


def coverage(named: DataFrame) -> DataFrame:
    """(poll_id, region, n_named, n_districts, whole): distinct names that end as a district's against the number of districts."""
    total = F.element_at(_keyed({k: n for k, _, n in REGIONS}), F.col("region"))
    rows = named.where(F.col("area").rlike("ий$")).groupBy("poll_id", "region").agg(F.count_distinct("area").alias("n_named"))
    return rows.select("poll_id", "region", "n_named", total.alias("n_districts"), ((total > 0) & (F.col("n_named") >= total)).alias("whole"))
