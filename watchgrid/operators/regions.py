"""Points in polygons: polygons are flattened to edges, points meet the polygons whose cells they share.

A region is all its rows: outer rings and holes alike, since a point in a hole crosses an even number of sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(rings: DataFrame) -> DataFrame:
    """(region, lat1, lon1, lat2, lon2) of each side of ``ring``, an array of (lat, lon) whose last point meets the first."""
    nth = F.posexplode("ring").alias("i", "a")
    side = rings.select("region", "ring", nth)
    b = F.element_at("ring", F.when(F.col("i") + 1 == F.size("ring"), 1).otherwise(F.col("i") + 2))
    return side.select("region", F.col("a.lat").alias("lat1"), F.col("a.lon").alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2"))


def bbox(rings: DataFrame) -> DataFrame:
    """Bounds of each ring."""
    return rings.select("region", F.explode("ring").alias("p")).groupBy("region").agg(
        F.min("p.lat").alias("south"), F.max("p.lat").alias("north"), F.min("p.lon").alias("west"), F.max("p.lon").alias("east")
    )


def point_in_region(points: DataFrame, rings: DataFrame, key: str = "point_id", cell: float = 0.5) -> DataFrame:
    """(key, region): the first region, by number, that holds the point; points outside of all are left out.

    Even-odd rule. A region goes to every cell of its bounds, a point to its one cell, so only points near a
    region meet its sides; each (point, region) pair is then a sum over sides, combined before the shuffle.
    """
    span = lambda x, y: F.sequence(F.floor(F.col(x) / cell), F.floor(F.col(y) / cell))
    cells = bbox(rings).withColumn("cy", F.explode(span("south", "north"))).withColumn("cx", F.explode(span("west", "east")))
    near = points.select(key, "lat", "lon", F.floor(F.col("lat") / cell).alias("cy"), F.floor(F.col("lon") / cell).alias("cx")).join(cells, ["cy", "cx"])
    near = near.where("lat between south and north and lon between west and east").select(key, "lat", "lon", "region")
    crossed = "(lat1 > lat) <> (lat2 > lat) and lon < (lon2 - lon1) * (lat - lat1) / nullif(lat2 - lat1, 0.0) + lon1"
    sides = near.join(edges(rings), "region").groupBy(key, "region").agg(F.sum(F.expr(f"case when {crossed} then 1 else 0 end")).alias("n"))
    return sides.where("n % 2 = 1").groupBy(key).agg(F.min("region").alias("region"))


_CROSSED = "(lat1 > lat) <> (lat2 > lat) and lon < (lon2 - lon1) * (lat - lat1) / nullif(lat2 - lat1, 0.0) + lon1"


def side_rows(rings: DataFrame, cell: float) -> DataFrame:
    """Sides of each region with the rows of cells (``cy``) that they pass, and the columns (``west`` to ``east``) that they touch there,
    one more on either side so that rounding can't hide one."""
    rows = edges(rings).withColumn("cy", F.explode(F.expr(f"sequence(floor(least(lat1, lat2) / {cell}D) - 1, floor(greatest(lat1, lat2) / {cell}D) + 1)")))
    # where the side is at the row's lower and upper end, or at its own end if that comes first
    low, high = F.col("cy") * F.lit(cell), (F.col("cy") + 1) * F.lit(cell)
    clip = lambda y: F.greatest(F.least(y, F.greatest("lat1", "lat2")), F.least("lat1", "lat2"))
    lon = lambda y: F.col("lon1") + (F.col("lon2") - F.col("lon1")) * (clip(y) - F.col("lat1")) / (F.col("lat2") - F.col("lat1"))
    flat = F.col("lat1") == F.col("lat2")
    a, b = F.when(flat, F.col("lon1")).otherwise(lon(low)), F.when(flat, F.col("lon2")).otherwise(lon(high))
    return rows.withColumns({"west": F.floor(F.least(a, b) / cell) - 1, "east": F.floor(F.greatest(a, b) / cell) + 1})


def region_cells(rings: DataFrame, cell: float = 0.1) -> DataFrame:
    """(region, cy, cx, edge): the cells that a side of the region may touch, and those that lie wholly inside it."""
    sides = side_rows(rings, cell)
    edge = sides.select("region", "cy", F.explode(F.sequence("west", "east")).alias("cx")).distinct()
    rows = sides.groupBy("region", "cy").agg(F.min("west").alias("w"), F.max("east").alias("e"))
    free = rows.select("region", "cy", F.explode(F.sequence("w", "e")).alias("cx")).join(edge, ["region", "cy", "cx"], "left_anti")
    middle = free.withColumns({"lat": (F.col("cy") + 0.5) * cell, "lon": (F.col("cx") + 0.5) * cell})
    inside = middle.join(sides, ["region", "cy"]).groupBy("region", "cy", "cx").agg(F.count_if(F.expr(_CROSSED)).alias("n")).where("n % 2 = 1")
    return edge.withColumn("edge", F.lit(True)).union(inside.select("region", "cy", "cx", F.lit(False).alias("edge")))


def regions_of(points: DataFrame, rings: DataFrame, key: str = "point_id", cell: float = 0.1) -> DataFrame:
    """(key, region): every region that holds the point, by the even-odd rule over all its rings.

    Cells are marked once; a point in a cell inside a region counts no side, one in an edge cell only the sides that pass its row
    of cells. ``key`` names distinct points; those with a null in it, lat or lon are in no region, and so with no rings. ``cell``
    changes the work, not the result.
    """
    at = points.where(F.col(key).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    at = at.select(key, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    met = at.withColumns({"cy": F.floor(F.col("lat") / cell), "cx": F.floor(F.col("lon") / cell)}).join(region_cells(rings, cell), ["cy", "cx"])
    sides = side_rows(rings, cell).select("region", "cy", "lat1", "lon1", "lat2", "lon2")
    near = met.where("edge").join(sides, ["region", "cy"]).groupBy(key, "region").agg(F.count_if(F.expr(_CROSSED)).alias("n")).where("n % 2 = 1")
    return met.where("not edge").select(key, "region").union(near.select(key, "region"))
