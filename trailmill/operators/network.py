"""The network build: segments of ways become directed edges with objective attributes, never costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.geo import cell, edge_cost, haversine
from trailmill.functions.shared import counted, written
from trailmill.functions.tags import classify_ways
from trailmill.operators.components import connected_components

MAX_REFS = 2048
#: A segment that a loop has used before costs so many times more.
REUSE_FACTOR = 4.0


def segments(kept: DataFrame) -> DataFrame:
    """Consecutive references of each way, paired before any join: a missing node ends both its segments."""
    pair = F.posexplode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("from_node"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("to_node")))
    s = kept.select("way_id", "way_class", "surface", "traffic", pair.alias("pos", "p"))
    return s.select("way_id", "way_class", "surface", "traffic", "pos", "p.from_node", "p.to_node").filter("from_node <> to_node")


def build_edges(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Directed edges; edge_id is a function of way, position and direction, so the reverse is edge_id xor 1."""
    at = nodes.select("node_id", "lat", "lon")
    a = at.select(F.col("node_id").alias("from_node"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = at.select(F.col("node_id").alias("to_node"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    s = segments(kept).join(a, "from_node").join(b, "to_node").withColumn("length_m", haversine("lat1", "lon1", "lat2", "lon2"))
    ends = F.array(F.struct(F.lit(0).alias("dir"), F.col("from_node").alias("f"), F.col("to_node").alias("t")), F.struct(F.lit(1).alias("dir"), F.col("to_node").alias("f"), F.col("from_node").alias("t")))
    both = s.select("way_id", "pos", "way_class", "surface", "traffic", "length_m", F.inline(ends))
    return both.select(((F.col("way_id") * MAX_REFS + F.col("pos")) * 2 + F.col("dir")).alias("edge_id"), F.col("f").alias("from_node"), F.col("t").alias("to_node"),
                       "length_m", "surface", "way_class", "traffic", "way_id", "pos")


def reused_costs(costs: DataFrame, used: DataFrame, factor: float = REUSE_FACTOR) -> DataFrame:
    """costs(edge_id, cost, ...) with the cost of used(edge_id) segments, in either direction, times `factor` (1 at least)."""
    segments_used = used.select(F.expr("edge_id div 2").alias("segment")).filter("segment is not null").distinct().withColumn("_used", F.lit(True))
    out = costs.withColumn("segment", F.expr("edge_id div 2")).join(segments_used, "segment", "left").drop("segment")
    return out.withColumn("cost", F.when(F.col("_used"), F.col("cost") * max(factor, 1.0)).otherwise(F.col("cost"))).drop("_used")


def placed_nodes(nodes: DataFrame, kept: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, lat, lon, component_id) of every known node of a kept way, as a written table; a node without edges is its own component."""
    used = kept.select(F.explode("nodes").alias("node_id")).distinct()
    own = nodes.join(used, "node_id", "left_semi")
    parts = connected_components(edges.filter("edge_id % 2 = 0"), "from_node", "to_node").withColumnRenamed("node", "node_id")
    return written(own.join(parts, "node_id", "left").withColumn("component_id", F.coalesce("component", "node_id")).drop("component"), "placed-nodes")


def network_nodes(nodes: DataFrame, kept: DataFrame, edges: DataFrame) -> DataFrame:
    """Every known node of a kept way, with its component and grid cell."""
    placed = placed_nodes(nodes, kept, edges)
    sizes = placed.groupBy("component_id").agg(F.count("*").alias("n"))
    main = sizes.orderBy(F.desc("n"), "component_id").limit(1).select(F.col("component_id").alias("main_id"))  # one row
    x, y = cell(F.col("lat"), F.col("lon"))
    return placed.join(F.broadcast(main), F.lit(True)).select("node_id", "lat", "lon", "component_id", (F.col("component_id") == F.col("main_id")).alias("is_main"), x.alias("cell_x"), y.alias("cell_y"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("from_node").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(out, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def by_class(edges: DataFrame) -> DataFrame:
    """Kilometres and unpaved share of the network for each way class."""
    once = edges.filter("edge_id % 2 = 0").groupBy("way_class").agg(
        F.count("*").alias("n_segments"), F.sum("length_m").alias("m"), F.sum(F.when(F.col("surface") != 1, F.col("length_m")).otherwise(0.0)).alias("u"))
    return once.select("way_class", "n_segments", F.round("m", 3).alias("length_m"), F.round(F.col("u") / F.col("m"), 6).alias("unpaved_share"))


def audit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, violations): endpoints exist, reverses exist and match, lengths are finite and at least the chord, costs at least the length."""
    e = edges.select("edge_id", "from_node", "to_node", "length_m", "surface", "traffic")
    dear = edge_cost(F.col("length_m"), F.col("surface"), F.col("traffic"), F.lit(6.0), F.lit(12.0))
    r = edges.select(F.col("edge_id").bitwiseXOR(1).alias("edge_id"), F.col("to_node").alias("f"), F.col("from_node").alias("t"))
    at = lambda c, k: nodes.select(F.col("node_id").alias(c), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    full = e.join(r, "edge_id", "left").join(at("from_node", 1), "from_node", "left").join(at("to_node", 2), "to_node", "left")
    bad = {"endpoint": F.col("lat1").isNull() | F.col("lat2").isNull(), "reverse": F.col("f").isNull() | (F.col("f") != F.col("from_node")) | (F.col("t") != F.col("to_node")),
           "length": F.isnan("length_m") | ~(F.col("length_m") >= haversine("lat1", "lon1", "lat2", "lon2") - 1e-6),
           "cost": F.isnan(dear) | ~((dear >= F.col("length_m")) & (dear < float("inf")))}
    counted = full.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in bad])))


def build_stats(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """One row: ways, nodes, bounds, segments and directed edges of the network of `nodes` and `ways`; the row is an error where there is no segment.

    The kept ways are written once and counted as they are; nodes and edges are each built once from them.
    """
    kept, n_ways = counted(classify_ways(ways), "kept-ways")
    used = nodes.join(kept.select(F.explode("nodes").alias("node_id")).distinct(), "node_id", "left_semi")
    n = used.agg(F.count("*").alias("nodes"), *[F.round(F.coalesce(f(c), F.lit(0.0)), 6).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")])
    e = build_edges(nodes, kept).agg(F.count("*").alias("directed_edges"))
    some = F.when(F.col("directed_edges") == 0, F.raise_error(F.lit("the network has no segments")).cast("long")).otherwise(F.expr("directed_edges div 2"))
    return n.join(e, F.lit(True)).select(F.lit(n_ways).cast("long").alias("ways"), *n.columns, some.alias("segments"), "directed_edges")  # single rows


def build_network(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(net_node, edge) of OSM node and way tables."""
    kept = classify_ways(ways)
    edges = build_edges(nodes, kept)
    return network_nodes(nodes, kept, edges), edges
