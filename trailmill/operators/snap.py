"""Snapping points to routable nodes by rings of grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.geo import cell, haversine
from trailmill.functions.shared import written

MAX_RING = 20
#: Rings searched at first; what they leave open is searched in the next number of rings.
STAGES = (2, 6, MAX_RING)


def snap(points: DataFrame, nodes: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(key, node_id, distance_m, status) of every point: the nearest main node up to one ring beyond the first that has one.

    Ties go to the least (distance, ring, dx, dy, node_id); a point without node in MAX_RING rings has status
    start_out_of_range, and so has one without finite coordinates.
    """
    main = nodes.filter("is_main").select("node_id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"), "cell_x", "cell_y")
    finite = F.abs(F.col(lat)) <= 90
    x, y = cell(F.when(finite, F.col(lat)), F.when(finite & ~F.isnan(F.col(lon)), F.col(lon)))
    todo = written(points.select(key, F.col(lat).alias("plat"), F.col(lon).alias("plon"), x.alias("px"), y.alias("py")), "snap-points")
    reach = lambda n: F.explode(F.sequence(F.lit(-n), F.lit(n)))
    occupied = main.select("cell_x", "cell_y").distinct()
    open_cells, best = todo.select("px", "py").dropna().distinct(), None
    for rings in STAGES:
        # which cells to look in depends on the point's cell alone: points and nodes join what is found for it
        near = open_cells.select("*", reach(rings).alias("dx")).select("*", reach(rings).alias("dy"))
        near = near.withColumns({"ring": F.greatest(F.abs("dx"), F.abs("dy")), "cell_x": F.col("px") + F.col("dx"), "cell_y": F.col("py") + F.col("dy")})
        hits = near.join(occupied, ["cell_x", "cell_y"]).withColumn("first", F.min("ring").over(W.partitionBy("px", "py")))  # (2 rings + 1)**2 rows at most
        # one ring more than the first must have been searched, or all have been
        settled = hits.filter((F.col("ring") <= F.col("first") + 1) & ((F.col("first") + 1 <= rings) | F.lit(rings == MAX_RING)))
        settled = written(settled.drop("first"), "snap-cells")
        best = settled if best is None else best.unionAll(settled)
        open_cells = open_cells.join(settled.select("px", "py"), ["px", "py"], "left_anti")
    met = todo.join(best, ["px", "py"]).join(main, ["cell_x", "cell_y"]).withColumn("d", haversine("plat", "plon", "nlat", "nlon"))
    best = met.groupBy(key).agg(F.min(F.struct("d", "ring", "dx", "dy", "node_id")).alias("b")).select(key, "b.node_id", F.col("b.d").alias("distance_m"))
    return points.select(key).join(best, key, "left").withColumn("status", F.when(F.col("node_id").isNull(), "start_out_of_range").otherwise("ok"))
