"""Reports near subscribers against brute force, for all three reasons."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchgrid.operators import history, proximity

REPORTS = "report_id long, observed_at timestamp_ntz, type string, n long, relation string, to_lat double, to_lon double, from_lat double, from_lon double, course_deg double, confidence double, to_area boolean"
READERS = "subscriber_id long, is_active boolean, lat double, lon double, radius_km double"
NOW = datetime(2024, 1, 15, 12, 0)


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def brute(report, reader):
    _, at, kind, _, relation, *ends, course, confidence, area = report
    to, origin = tuple(ends[:2]), tuple(ends[2:])
    _, active, lat, lon, radius = reader
    age = (NOW - at).total_seconds() / 60
    if not active or lat is None or confidence < 0.6 or not 0 <= age <= 30 or area or (to[0] is None and origin[0] is None):
        return None
    position = origin if origin[0] is not None else to
    target = km(*position, lat, lon)
    named = km(*to, lat, lon) if to[0] is not None else target
    if min(target, named) <= radius:
        return "in_radius", named, target, None
    speed = proximity.SPEEDS.get(kind)
    if relation in ("over", "past", "through") and course is not None and speed and to[0] is not None and age <= 25:
        h = math.radians(course)
        x, y = (lon - to[1]) * 111.32 * math.cos(math.radians(lat)), (lat - to[0]) * 110.57
        along, side = x * math.sin(h) + y * math.cos(h), abs(x * math.cos(h) - y * math.sin(h))
        eta = along / speed * 60 - age
        if 0 <= eta <= 30 and side <= radius:
            return "approaching", named, target, eta
    if course is None or origin[0] is None:
        return None
    p, q, d = math.radians(origin[0]), math.radians(lat), math.radians(lon - origin[1])
    bearing = math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360
    turn = abs(bearing - course) % 360
    if min(turn, 360 - turn) > 30 or target > proximity.TYPICAL[kind] * 25 / 60 + radius:
        return None
    return "heading_towards", named, target, target / proximity.TYPICAL[kind] * 60


def test_three_reasons(spark):
    r = random.Random(11)
    spot = lambda wide, at=(48, 31): (at[0] + r.uniform(-wide, wide), at[1] + r.uniform(-wide, wide))
    reports = []
    for i in range(250):
        at = (48, 31) if i % 5 else (48, 179.5)
        to = r.choice([(None, None), spot(1, at), spot(5, at)])
        origin = r.choice([(None, None), spot(1, at), spot(5, at)])
        if at[1] > 100:
            to, origin = (tuple(x if x is None or x <= 180 else x - 360 for x in e) for e in (to, origin))
        reports.append((i, NOW - timedelta(minutes=r.uniform(-2, 33)), r.choice(list(proximity.TYPICAL)), 1 + i % 3, r.choice(["over", "past", "through", "towards", "from", "launch"]), *to, *origin, r.choice([None, float(r.randrange(360))]), r.choice([0.5, 0.6, 0.9]), i % 17 == 0))
    readers = [(k, k % 9 > 0, *(spot(3) if k % 4 else spot(1, (48, -179))), float(r.randint(5, 120))) for k in range(80)] + [(900, True, None, None, 50.0)]
    want = {(u[0], x[0]): brute(x, u) for x in reports for u in readers}
    want = {k: v for k, v in want.items() if v}
    # a flat path across the date line is no path for the rule either
    rows = proximity.proximity(spark.createDataFrame(reports, REPORTS), spark.createDataFrame(readers, READERS), "2024-01-15 12:00:00").collect()
    got = {(x.subscriber_id, x.report_id): (x.reason, x.distance_km, x.target_km, x.eta_min) for x in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    for k, (reason, *numbers) in got.items():
        assert reason == want[k][0] and all((a is None) == (b is None) and abs((a or 0) - (b or 0)) < 1e-6 for a, b in zip(numbers, want[k][1:])), k
    reasons = [v[0] for v in want.values()]
    assert min(reasons.count(x) for x in ("in_radius", "approaching", "heading_towards")) > 20
    lines = proximity.dedupe_lines(spark.createDataFrame(rows)).collect()
    assert len(lines) == len({(x.subscriber_id, x.type, x.reason) for x in rows})


def test_no_reports_or_readers(spark):
    none, nobody = spark.createDataFrame([], REPORTS), spark.createDataFrame([], READERS)
    assert proximity.proximity(none, spark.createDataFrame([(1, True, 48.0, 31.0, 9.0)], READERS), "2024-01-15 12:00:00").count() == 0
    one = spark.createDataFrame([(1, NOW, "uav", 1, "over", 48.0, 31.0, None, None, None, 0.9, False)], REPORTS)
    assert proximity.proximity(one, nobody, "2024-01-15 12:00:00").count() == 0


def test_readers_of_one_place_are_looked_at_once(spark, monkeypatch):
    now = datetime(2024, 1, 15, 12)
    schema = "report_id long, observed_at timestamp_ntz, type string, n int, relation string, to_lat double, to_lon double, from_lat double, from_lon double, course_deg double, confidence double, to_area boolean"
    reports = spark.createDataFrame([(i, now - timedelta(minutes=i), "uav", i, "over", 50.0, 30.0 + i % 2 / 10, None, None, 90.0, 0.9, False) for i in range(1, 9)], schema)
    readers = spark.createDataFrame([(i, True, 50.0, 30.01, 1.0 + i % 20) for i in range(300)] + [(300, True, 50.0, 31.0, 5.0)], "subscriber_id long, is_active boolean, lat double, lon double, radius_km double")
    sizes, meet = [], proximity.meet
    monkeypatch.setattr(proximity, "meet", lambda near, at, *more, **kw: sizes.append(at.count()) or meet(near, at, *more, **kw))
    tell = lambda d: sorted(tuple(x) for x in d.select("subscriber_id", "type", "reason", "n", "report_id", "distance_km").collect())
    every = proximity.proximity(reports, readers, "2024-01-15 12:00:00", group=100).cache()
    lines = tell(proximity.proximity_lines(reports, readers, "2024-01-15 12:00:00"))
    assert tell(proximity.dedupe_lines(every)) == lines and len({x[0] for x in lines}) > 250
    assert {x.report_id for x in every.where("subscriber_id = 19 and reason = 'in_radius'").collect()} == set(range(1, 9))
    tracks = reports.selectExpr("report_id as track_id", "type", "'position' as last_kind", "to_lat as lat", "to_lon as lon", "course_deg as heading_deg", "observed_at", "false as area")
    ahead = readers.select(F.col("subscriber_id").alias("viewer_id"), "lat", (F.col("lon") + 0.4).alias("lon"))
    near = proximity.near_me(tracks, ahead, "2024-01-15 12:00:00").groupBy("viewer_id").count().collect()
    assert len({x["count"] for x in near if x.viewer_id < 300}) == 1 and len(near) == 301
    assert sizes == [4, 2, 2]


def test_a_crowded_cell_is_dealt_over_parts(spark):
    reports = spark.createDataFrame([(1, 50.0, 30.0, 40.0), (2, 20.0, 30.0, 40.0)], "report_id long, x_lat double, x_lon double, km double")
    readers = spark.createDataFrame([(i, 50.0 + i % 50 / 1000, 30.0) for i in range(200)], "subscriber_id long, lat double, lon double")
    for crowd in (1, 7, 1000):
        got = proximity.meet(reports, readers, [("x_", F.col("km"))], crowd=crowd).select("report_id", "subscriber_id").collect()
        assert sorted(map(tuple, got)) == [(1, i) for i in range(200)]


def crowd_of_reports(spark):
    r = random.Random(5)
    end = lambda: r.choice([(None, None), (48 + r.randrange(5) / 4, 31 + r.randrange(5) / 4)])
    kind = lambda: r.choice(["uav", "cruise", "ballistic"])
    rows = [(i, NOW - timedelta(minutes=r.uniform(0, 30)), kind(), 1 + i % 4, r.choice(["over", "past", "towards"]), *end(), *end(), r.choice([None, float(r.randrange(360))]), 0.9, False) for i in range(400)]
    return spark.createDataFrame(rows, REPORTS)


def test_lines_and_counts_without_pairs(spark):
    """Ties in distance, equal radii, readers in several groups, and an id of two places, whose orders by distance aren't each other's."""
    r = random.Random(6)
    readers = [(k, True, 48.5 + k % 2, 31.5, float(r.randint(1, 150))) for k in range(90)] + [(k, True, 50.0, 33.0 + k / 100, 120.0) for k in range(0, 90, 4)] + [(500, True, 48.5, 31.5, None)]
    reports, readers = crowd_of_reports(spark), spark.createDataFrame(readers, READERS)
    pairs = proximity.proximity(reports, readers, "2024-01-15 12:00:00").cache()
    want = {(x.subscriber_id, x.type, x.reason): (x.n, x.report_id, x.distance_km) for x in proximity.dedupe_lines(pairs).collect()}
    count = {(x.subscriber_id, x.type, x.reason): x["count"] for x in pairs.groupBy("subscriber_id", "type", "reason").count().collect()}
    assert {k[2] for k in want} == {"in_radius", "approaching", "heading_towards"}
    rows = proximity.proximity_lines(reports, readers, "2024-01-15 12:00:00").collect()
    assert len(rows) == len(want) and {(x.subscriber_id, x.type, x.reason): (x.n, x.report_id, x.distance_km) for x in rows} == want
    for group in (1, 7, 16, 1000):
        rows = proximity.reader_lines(reports, readers, "2024-01-15 12:00:00", group=group).collect()
        assert {(x.subscriber_id, x.type, x.reason): (x.n, x.report_id, round(x.distance_km, 6)) for x in rows} == want
        assert len(rows) == len(count) and {(x.subscriber_id, x.type, x.reason): x.n_pairs for x in rows} == count


def test_pairs_are_spread_and_their_distances_found_once(spark):
    reports = crowd_of_reports(spark)
    readers = spark.createDataFrame([(k, True, 48.0 + k % 40 / 20, 31.0 + k % 7 / 4, 50.0) for k in range(400)], READERS)
    pairs = proximity.proximity(reports, readers, "2024-01-15 12:00:00", digits=6)
    assert pairs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("ASIN(") == 2
    whole = proximity.proximity(reports, readers, "2024-01-15 12:00:00")
    names = [F.round(c, 6).alias(c) if c.endswith(("_km", "_min")) else F.col(c) for c in whole.columns]
    assert sorted(map(repr, pairs.collect())) == sorted(map(repr, whole.select(names).collect()))


def test_bursts_order_no_reports_and_shuffle_lines_once(spark):
    r = random.Random(7)
    reports = crowd_of_reports(spark)
    readers = spark.createDataFrame([(k % 80, True, 48.5 + k % 3, 31.5, float(r.randint(1, 150))) for k in range(90)], READERS)
    told = history.bursts(proximity.proximity_lines(reports, readers, "2024-01-15 12:00:00"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(cy" not in plan and plan.count("Exchange hashpartitioning(subscriber_id") == 1
    want = {}
    for x in proximity.dedupe_lines(proximity.proximity(reports, readers, "2024-01-15 12:00:00")).collect():
        want.setdefault(x.subscriber_id, []).append((x.distance_km, x.type, x.reason, x.n))
    want = {k: (len(v), ";".join("|".join(map(str, x[1:])) for x in sorted(v)), min(v)[0]) for k, v in want.items()}
    assert len(want) > 60 and {x.subscriber_id: (x.n_lines, x.message, x.nearest_km) for x in told.collect()} == want
