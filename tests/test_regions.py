"""Regions with holes against sides counted one by one."""

import math
import random

from watchgrid.operators import regions


def inside(lat, lon, rings):
    """Parity of the sides to the right, over all rings."""
    n = 0
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b:
                n += 1
    return n % 2 == 1


def star(r, lat, lon, size, n=9):
    return [(lat + size * r.uniform(0.4, 1) * math.sin(2 * math.pi * k / n), lon + size * r.uniform(0.4, 1) * math.cos(2 * math.pi * k / n)) for k in range(n)]


def test_all_regions_with_holes(spark):
    r = random.Random(3)
    shapes = {1: [star(r, 50, 30, 1.0), star(r, 50, 30, 0.3)], 2: [star(r, 50.5, 30.5, 0.8)], 3: [[(49.0, 29.0), (49.0, 30.0), (50.0, 30.0), (50.0, 29.0)], star(r, 49.5, 29.5, 0.2), star(r, 47, 31, 0.05)], 4: [star(r, -0.02, 0.03, 0.5)]}
    rings = spark.createDataFrame([(k, [{"lat": float(a), "lon": float(b)} for a, b in ring]) for k, v in shapes.items() for ring in v], "region long, ring array<struct<lat:double,lon:double>>")
    points = [(i, r.uniform(48.8, 51.6), r.uniform(28.8, 31.6)) for i in range(1500)] + [(2000 + i, r.uniform(-0.6, 0.6), r.uniform(-0.6, 0.6)) for i in range(300)]
    points += [(3000, 49.0, 29.0), (3001, 50.0, 30.0), (3002, 49.5, 29.0), (3003, 49.0, 29.5), (3004, 47.0, 31.0)]
    want = {(i, k) for i, a, b in points for k, v in shapes.items() if inside(a, b, v)}
    assert len(want) > 300
    odd = [(9000, None, 30.0), (9001, 50.0, None), (None, 50.0, 30.0)]
    frame = spark.createDataFrame(points + odd, "point_id long, lat double, lon double")
    for cell in (0.1, 0.37):
        assert sorted((x.point_id, x.region) for x in regions.regions_of(frame, rings, cell=cell).collect()) == sorted(want)
    marked = regions.region_cells(rings).groupBy("edge").count().collect()
    assert {x.edge for x in marked} == {True, False}
    assert regions.regions_of(frame, rings.limit(0)).isEmpty() and regions.regions_of(frame.limit(0), rings).isEmpty()
