"""Reports near subscribers: a grid join, three reasons, and one line per subject."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.functions.geo import angle_diff, approach, bearing, distance_km
from watchgrid.session import cut

# Speeds in km/h by which a position is projected (other types aren't), and by which a course is judged.
SPEEDS = {"uav": 180.0, "jet_uav": 600.0, "cruise": 800.0, "recon": 150.0}
TYPICAL = {"uav": 180.0, "jet_uav": 600.0, "cruise": 800.0, "ballistic": 3000.0, "kab": 700.0, "aviation": 800.0, "recon": 150.0, "unknown": 200.0}


@dataclass(frozen=True)
class Rules:
    min_confidence: float = 0.6
    max_age_min: float = 30.0
    eta_max_min: float = 30.0
    stale_min: float = 25.0
    course_tolerance_deg: float = 30.0
    lead_min: float = 25.0


def speed_kmh(kind: Column, speeds: dict[str, float] = SPEEDS) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in speeds.items()])


def age_min(now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))) / 6e7


def known(end: str) -> Column:
    return F.col(f"{end}_lat").isNotNull() & F.col(f"{end}_lon").isNotNull()


def recent(now: str, minutes: float) -> Column:
    """Not newer than now and at most so old: two literals against the column, so that a scan can use them."""
    t = F.lit(now).cast("timestamp_ntz")
    return (F.col("observed_at") <= t) & (F.col("observed_at") >= t - F.make_dt_interval(mins=F.lit(int(minutes)), secs=F.lit(minutes % 1 * 60)))


def actionable(reports: DataFrame, now: str, rules: Rules = Rules()) -> DataFrame:
    """Reports of enough confidence, at most 30 minutes old (not newer than now), with an origin or a destination, not an area."""
    return reports.where(recent(now, rules.max_age_min) & (F.col("confidence") >= rules.min_confidence) & ~F.col("to_area") & (known("to") | known("from")))


def _cells(lat: Column, lon: Column, reach: Column, cell: float) -> tuple[Column, Column]:
    """Cells that hold every point within ``reach`` km: rows and, wrapped at 180 degrees, columns."""
    up = reach / 110.57 + 0.01
    # the row nearest to a pole has the shortest degree; near a pole all columns are within reach
    wide = F.least(reach / (111.32 * F.cos(F.radians(F.least(F.abs(lat) + up, F.lit(85.0))))) + 0.01, F.lit(180.0))
    rows = F.sequence(F.floor((lat - up) / cell), F.floor((lat + up) / cell))
    columns = F.array_distinct(F.transform(F.sequence(F.floor((lon - wide) / cell), F.floor((lon + wide) / cell)), lambda x: F.pmod(x, F.lit(int(360 / cell)))))
    return rows, columns


def _grid(rows: Column, columns: Column) -> Column:
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.struct(y.alias("cy"), x.alias("cx")))))


#: The part of a cell in which ``meet`` brings a pair together.
AT = ["cy", "cx", "_part"]


def meet(near: DataFrame, readers: DataFrame, points: list[tuple[str, Column]], cell: float = 1.0, crowd: int = 32) -> DataFrame:
    """Rows of ``near`` joined with the readers (lat, lon) that may lie within reach of one of its points.

    ``points``: the prefix of a point's columns and the reach in km. A row of ``near`` goes to every cell within reach, once;
    a reader lies in one cell. A cell of more than ``crowd`` readers is dealt over parts by their places, so that no task reads it whole,
    and a row of ``near`` goes to all of its parts; cells without readers are left out before that.
    The result is partitioned by ``AT``: groups within these columns and a reader's place need no shuffle.
    """
    spots = []
    for end, reach in points:
        rows, columns = _cells(F.col(f"{end}lat"), F.col(f"{end}lon"), reach, cell)
        spots.append(F.when(reach.isNotNull(), _grid(rows, columns)))
    every = F.array_distinct(F.concat(*[F.coalesce(s, F.array().cast("array<struct<cy:bigint,cx:bigint>>")) for s in spots]))
    dealt = near.withColumn("_at", F.explode(every)).withColumns({"cy": F.col("_at.cy"), "cx": F.col("_at.cx")}).drop("_at")
    at = readers.withColumns({"cy": F.floor(F.col("lat") / cell), "cx": F.pmod(F.floor(F.col("lon") / cell), F.lit(int(360 / cell)))})
    parts = at.groupBy("cy", "cx").agg(F.ceil(F.count("*") / crowd).alias("_parts"))
    at = at.join(parts, ["cy", "cx"]).withColumn("_part", F.pmod(F.xxhash64("lat", "lon"), F.col("_parts"))).drop("_parts")
    dealt = dealt.join(parts, ["cy", "cx"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    # little is shuffled and much comes of it: without a number of its own, Spark would put the parts into one task
    context = near.sparkSession.sparkContext
    tasks = max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * context.defaultParallelism)
    return dealt.repartition(tasks, *AT).join(at.repartition(tasks, *AT).hint("merge"), AT)


def _located(subscribers: DataFrame) -> DataFrame:
    """Readers with a place, those of one place numbered by radius from 0."""
    nth = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("radius_km", "subscriber_id")) - 1
    located = subscribers.where("is_active and lat is not null and lon is not null and radius_km is not null")
    return located.select("subscriber_id", "lat", "lon", "radius_km").withColumn("nth", nth)


def _spots(located: DataFrame, group: int, *more: Column) -> DataFrame:
    """A row for each ``group`` readers of a place, who follow one another in radius."""
    spots = located.withColumn("group", F.floor(F.col("nth") / group)).groupBy("lat", "lon", "group")
    return spots.agg(F.max("radius_km").alias("widest"), *more)


def _near_spots(reports: DataFrame, spots: DataFrame, now: str, rules: Rules) -> DataFrame:
    """Reports that give a reason to some reader of a spot (lat, lon, widest: its readers' largest radius), with all of a reason but the radius."""
    radius = spots.agg(F.max("widest").alias("reach"))  # one row
    near = actionable(reports, now, rules).select("report_id", "type", "n", "relation", "to_lat", "to_lon", "from_lat", "from_lon", "course_deg", age_min(now).alias("age"))
    near = near.withColumns({"typical": speed_kmh(F.col("type"), TYPICAL), "projected": speed_kmh(F.col("type"))}).crossJoin(F.broadcast(radius))
    moving = F.col("relation").isin("over", "past", "through") & F.col("course_deg").isNotNull() & F.col("projected").isNotNull() & (F.col("age") <= rules.stale_min)
    # a path is as long as the type flies since the report and until the last arrival that counts
    ahead = F.when(moving, F.col("projected") / 60 * (F.col("age") + rules.eta_max_min)).otherwise(0.0)
    towards = F.when(F.col("course_deg").isNotNull(), F.col("typical") * rules.lead_min / 60).otherwise(0.0)
    wide = F.col("reach") * 1.01 + 1
    pairs = meet(near, spots, [("to_", F.when(known("to"), wide + ahead)), ("from_", F.when(known("from"), wide + towards))])
    to, origin = (distance_km(F.col(f"{end}_lat"), F.col(f"{end}_lon"), F.col("lat"), F.col("lon")) for end in ("to", "from"))
    pairs = pairs.withColumns({"to_km": to, "from_km": origin})
    pairs = pairs.withColumns({"target_km": F.coalesce("from_km", "to_km"), "distance_km": F.coalesce("to_km", "from_km")})
    closest, eta = approach(F.col("to_lat"), F.col("to_lon"), F.col("course_deg"), F.col("projected"), F.col("age"), F.col("lat"), F.col("lon"))
    aimed = angle_diff(bearing(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon")), F.col("course_deg")) <= rules.course_tolerance_deg
    pairs = pairs.withColumns({"closest": closest, "eta": eta, "aimed": aimed})
    pairs = pairs.withColumn("coming", F.coalesce(moving & known("to") & (F.col("eta") <= rules.eta_max_min), F.lit(False)))
    spot = [c for c in spots.columns if c not in ("lat", "lon", "widest")]
    # a filter would be pushed below all that it is made of, and each part be computed wherever it is named
    pairs = pairs.withColumn("lead_km", F.col("typical") * rules.lead_min / 60)
    pairs = pairs.withColumn("kept", F.explode(F.when(_reason(F.col("widest")).isNotNull(), F.array(F.lit(True)))))
    return pairs.select(*AT, "lat", "lon", *spot, "report_id", "type", "n", "distance_km", "target_km", "closest", "eta", "aimed", "coming", "typical", "lead_km")


def _reason(radius: Column) -> Column:
    heading = F.col("aimed") & (F.col("target_km") <= F.col("lead_km") + radius)
    return F.when(F.least("distance_km", "target_km") <= radius, "in_radius").when(F.col("coming") & (F.col("closest") <= radius), "approaching").when(heading, "heading_towards")


def proximity(reports: DataFrame, subscribers: DataFrame, now: str, rules: Rules = Rules(), group: int = 1000, digits: int | None = None) -> DataFrame:
    """(subscriber_id, report_id, type, n, reason, distance_km, target_km, eta_min, closest_km).

    The report's position is its origin where known, else its destination; the named place is the destination where known.
    Reasons, the first that holds: in_radius, the nearer of both within the subscriber's radius; approaching, a position with
    a course, not stale and of a type that is projected, whose path passes within the radius in time; heading_towards, a known
    origin and a course that points at the subscriber, who is within what the type covers in ``lead_min`` minutes.
    distance_km is to the named place, target_km to the position; eta_min is null for in_radius.
    Subscribers of one place are looked at once, at most ``group`` of them together; only radii are compared one by one, and
    numbers are rounded to ``digits``, where given, once a place.
    """
    spots = _spots(_located(subscribers), group, F.collect_list(F.struct("subscriber_id", "radius_km")).alias("readers"))
    shown = lambda c: F.round(c, digits) if digits is not None else c
    pairs = _near_spots(reports, spots, now, rules).withColumns({
        "shown_distance": shown(F.col("distance_km")), "shown_target": shown(F.col("target_km")), "shown_closest": shown(F.col("closest")),
        "shown_eta": shown(F.col("eta")), "shown_lead": shown(F.col("target_km") / F.col("typical") * 60),
    })
    pairs = pairs.withColumn("reader", F.explode("readers")).drop("readers")
    pairs = pairs.select("*", "reader.subscriber_id", _reason(F.col("reader.radius_km")).alias("reason")).where("reason is not null")
    minutes = F.when(F.col("reason") == "approaching", F.col("shown_eta")).when(F.col("reason") == "heading_towards", F.col("shown_lead"))
    closest = F.when(F.col("reason") == "approaching", F.col("shown_closest"))
    return pairs.select("subscriber_id", "report_id", "type", "n", "reason", F.col("shown_distance").alias("distance_km"), F.col("shown_target").alias("target_km"), minutes.alias("eta_min"), closest.alias("closest_km"))


def _first(holds: Callable[[Column], Column]) -> Column:
    """How many of the ascending ``radii`` come before the first for which ``holds``, which stays true from there: a binary search by ``steps``."""
    return F.aggregate("steps", F.lit(0), lambda k, step: F.when((k + step <= F.size("radii")) & ~holds(F.get("radii", k + step - 1)), k + step).otherwise(k))


def reader_lines(reports: DataFrame, subscribers: DataFrame, now: str, rules: Rules = Rules(), group: int = 1000) -> DataFrame:
    """(subscriber_id, type, reason, n, report_id, distance_km, n_pairs): ``dedupe_lines`` of ``proximity`` and of how many pairs, without its pairs.

    By radius, the readers of a place to whom a report gives a reason follow one another. Reports of equal runs of readers become
    one; a run is put together from blocks of 1, 2, 4, ... readers, and blocks hand on what they have to their readers. So a place costs its reports
    and its readers, not their product. All of it happens where reports and places meet, up to the lines.
    """
    located = _located(subscribers)
    spots = _spots(located, group, F.sort_array(F.collect_list("radius_km")).alias("radii"))
    spots = spots.withColumn("steps", F.expr("transform(sequence(length(bin(size(radii))) - 1, 0, -1), k -> shiftleft(1, k))"))
    spots = cut(spots)  # read three times
    inside = _first(lambda r: F.least("distance_km", "target_km") <= r)
    passed = F.when(F.col("coming"), _first(lambda r: F.col("closest") <= r)).otherwise(F.size("radii"))
    led = F.when(F.col("aimed"), _first(lambda r: F.col("target_km") <= F.col("lead_km") + r)).otherwise(F.size("radii"))
    pairs = _near_spots(reports, spots, now, rules).withColumns({"inside": inside, "passed": passed, "led": led, "all": F.size("radii")})
    place = [*AT, "lat", "lon", "group"]
    pairs = pairs.select(*place, "report_id", "type", "n", "distance_km", "inside", "passed", "led", "all")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy("distance_km", "report_id")))
    best = [F.max("n").alias("n"), F.min_by("report_id", "rank").alias("report_id"), F.min("distance_km").alias("distance_km"), F.min("rank").alias("rank")]
    subject, count = [*place, "type", "reason"], F.sum("n_pairs").alias("n_pairs")
    run = lambda reason, since, until: F.struct(F.lit(reason).alias("reason"), since.alias("since"), until.alias("until"))
    three = run("in_radius", F.col("inside"), F.col("all")), run("approaching", F.col("passed"), F.col("inside")), run("heading_towards", F.col("led"), F.least("inside", "passed"))
    runs = pairs.select(*pairs.columns, F.inline(F.array(*three))).where("since < until").groupBy(*subject, "since", "until").agg(*best, F.count("*").alias("n_pairs"))
    # the blocks of a run, each of which begins at a multiple of its size
    low, high = "shiftright(since + shiftleft(1, k) - 1, k)", "shiftright(until, k)"
    block = f"CASE WHEN {low} < {high} AND {{0}} % 2 = 1 THEN struct(shiftleft({{1}}, k) AS first, shiftleft(1, k) AS size) END"
    blocks = F.expr(f"flatten(transform(sequence(0, length(bin(until - since)) - 1), k -> array({block.format(low, low)}, {block.format(high, high + ' - 1')})))")
    blocks = runs.withColumn("block", F.explode(blocks)).where("block is not null").select("*", "block.*").groupBy(*subject, "first", "size").agg(*best, count)
    each = blocks.withColumn("k", F.explode(F.expr("sequence(first, first + size - 1)"))).groupBy(*subject, "k").agg(*best, count)
    lines = each.withColumn("nth", F.col("group") * group + F.col("k")).join(located, ["lat", "lon", "nth"])
    # an id has more than one row where it has more than one place; its lines stay together, so groups of an id need no further shuffle
    near = [F.min_by("report_id", F.struct("distance_km", "report_id")).alias("report_id"), F.min("distance_km").alias("distance_km")]
    lines = lines.select("subscriber_id", "type", "reason", "n", "report_id", "distance_km", "n_pairs").repartition("subscriber_id")
    return lines.groupBy("subscriber_id", "type", "reason").agg(F.max("n").alias("n"), *near, count)


def proximity_lines(reports: DataFrame, subscribers: DataFrame, now: str, rules: Rules = Rules()) -> DataFrame:
    """``dedupe_lines`` of ``proximity``."""
    return reader_lines(reports, subscribers, now, rules).withColumn("distance_km", F.round("distance_km", 6)).drop("n_pairs")


def dedupe_lines(matches: DataFrame, place: str | None = None) -> DataFrame:
    """Per subscriber and subject (type, place where given, reason): the nearest report (of ties the smallest id) and the largest count."""
    subject = ["type", *([place] if place else []), "reason"]
    return matches.groupBy("subscriber_id", *subject).agg(
        F.min(F.struct("distance_km", "report_id")).alias("near"), F.max("n").alias("n")
    ).select("subscriber_id", *subject, "n", F.col("near.report_id").alias("report_id"), F.round("near.distance_km", 6).alias("distance_km"))


def near_me(tracks: DataFrame, viewers: DataFrame, now: str, radius_km: float = 40.0, eta_max_min: float = 60.0, rules: Rules = Rules()) -> DataFrame:
    """(viewer_id, track_id, kind, eta_min, closest_km, distance_km, place): tracks that approach a viewer, then destinations nearby.

    ``tracks``: track_id, type, last_kind, lat, lon, heading_deg, observed_at, area. Areas and stale tracks have no row, nor do
    positions of types that aren't projected. ``place`` counts each viewer's rows: approaches by time, then destinations by distance; ties by id.
    """
    age = age_min(now)
    fresh = tracks.where(recent(now, rules.stale_min) & ~F.col("area")).withColumns({"age": age, "projected": speed_kmh(F.col("type"))})
    reach = F.when(F.col("last_kind") == "destination", F.lit(radius_km)).when(
        (F.col("last_kind") == "position") & F.col("heading_deg").isNotNull(), radius_km + F.col("projected") / 60 * (F.col("age") + eta_max_min)
    )
    fresh = fresh.withColumnsRenamed({"lat": "t_lat", "lon": "t_lon"})
    located = viewers.where("lat is not null and lon is not null").select("viewer_id", "lat", "lon")
    # what viewers of one place see is found and put in order once
    pairs = meet(fresh, located.select("lat", "lon").distinct(), [("t_", reach * 1.01 + 1)])
    closest, eta = approach(F.col("t_lat"), F.col("t_lon"), F.col("heading_deg"), F.col("projected"), F.col("age"), F.col("lat"), F.col("lon"))
    away = distance_km(F.col("t_lat"), F.col("t_lon"), F.col("lat"), F.col("lon"))
    kind = F.when((F.col("last_kind") == "position") & (closest <= radius_km) & (eta <= eta_max_min), "approach").when((F.col("last_kind") == "destination") & (away <= radius_km), "destination")
    out = pairs.withColumns({"kind": kind, "eta_min": eta, "closest_km": closest, "distance_km": away}).where("kind is not null")
    only = lambda c, k: F.when(F.col("kind") == k, F.round(c, 6)).alias(c)
    out = out.select("lat", "lon", "track_id", "kind", only("eta_min", "approach"), only("closest_km", "approach"), only("distance_km", "destination"))
    # a place's rows are bounded by the tracks of the last minutes
    order = F.array_sort(F.collect_list(F.struct("kind", F.coalesce("eta_min", "distance_km").alias("by"), "track_id", "eta_min", "closest_km", "distance_km")))
    rows = out.groupBy("lat", "lon").agg(order.alias("rows")).join(located, ["lat", "lon"]).select("viewer_id", F.posexplode("rows").alias("place", "x"))
    return rows.select("viewer_id", F.col("x.track_id").alias("track_id"), F.col("x.kind").alias("kind"), "x.eta_min", "x.closest_km", "x.distance_km", (F.col("place") + 1).cast("long").alias("place"))
