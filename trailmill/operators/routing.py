"""Cheapest paths and loops for a whole batch of requests at once, as rounds of joins and aggregates.

Trips with a reach are dealt by zones, tiles of the map, and each zone gets the arcs that its trips can reach: one shuffle
brings them together, and a zone's trips are relaxed there as arrays, all at once, until nothing gets cheaper.

Trips that may go anywhere, whose zone has too many arcs or that carry used segments go in rounds over the whole network.
Every round advances all trips by a few edges. The frontier of each trip, what got cheaper in the round before, meets the
network's edges; the cheapest arrival at each node is kept, and only what is cheaper than before is written and is the
next frontier. An arrival whose cost and straight distance to the target exceed the best path found is dropped, so a trip
explores what lies between its ends and not the network. The edges of all paths are then listed by pointer doubling
along predecessors, in rounds that grow with the logarithm of the longest path. Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from trailmill.functions.geo import DEGREE_M, EARTH_M, destination, edge_cost, haversine, loop_radius
from trailmill.functions.shared import counted, written
from trailmill.operators.network import REUSE_FACTOR
from trailmill.operators.ranking import distinct_loops, ranked_for
from trailmill.operators.requests import validated, with_defaults
from trailmill.operators.snap import snap

# The search's budget, candidates of a request, waypoints of a loop and tries of its radius; bounds of the
# detour factor, its first value, and the jitter of a bearing.
MAX_NODES = 400_000
CANDIDATES, WAYPOINTS, TRIES = 20, 3, 5
DETOUR_LO, DETOUR_HI, DETOUR, JITTER = 0.8, 2.5, 1.3, 0.3

#: Edges that a round goes on, and rounds after which what they wrote is put together.
HOPS, COMPACT = 3, 4
#: Degrees of a zone's tile, trips of a zone (a tile with more has several zones) and of a task that searches zones.
ZONE_DEG, ZONE_TRIPS, TASK_TRIPS = 0.05, 500, 2000
#: Arcs of a zone and metres of reach beyond which trips go in rounds.
ZONE_ARCS, ZONE_REACH_M = 1 << 17, 100_000.0
#: Trips times nodes and arcs of a zone that are held at once.
CELLS = 1 << 22
#: Degrees of latitude of a tile in which points meet what is near them.
TILE_DEG = 0.02
#: Metres by which rounding may blur a bound; explored nodes are counted within EXPLORED of the path's cost. An edge costs
#: PER_EDGE more than its price, so of paths that cost the same the one with the fewest edges is the cheapest, and none is free.
SLACK, EXPLORED, PER_EDGE = 1e-5, 1e-6, 1e-10
#: What a search carries along for each trip.
CARRIED = ("to_node", "w_paved", "w_traffic", "reach_m", "from_lat", "from_lon", "to_lat", "to_lon", "best")


def _tile_x(lon: Column, tile_y: Column) -> Column:
    """Column of a tile: tiles are as wide as they are high at the edge of their row towards the pole, beyond it all is one."""
    edge = F.least(F.greatest(F.abs(tile_y), F.abs(tile_y + 1)) * TILE_DEG, F.lit(90.0))
    return F.floor(lon * F.cos(F.radians(edge)) / TILE_DEG).cast("int")


def _tile_y(lat: Column) -> Column:
    return F.floor(lat / TILE_DEG).cast("int")


def _tiled(lat: str, lon: str) -> dict[str, Column]:
    return {"tile_y": _tile_y(F.col(lat)), "tile_x": _tile_x(F.col(lon), _tile_y(F.col(lat)))}


def _near(points: DataFrame, places: DataFrame, lat: str, lon: str, metres: str) -> DataFrame:
    """Pairs of points and places(near_lat, near_lon, ...) within `metres` of them, by an equi-join on the tiles that a point's circle can touch.

    A point without coordinates or reach meets none. Circles end at the date line, but hold the pole.
    """
    half, y = F.col(metres) * 1.01 / DEGREE_M, F.col("tile_y")
    # the parallel is shortest at the circle's edge towards the pole
    pole = F.abs(lat) + half
    wide = F.when(pole < 90, F.least(F.lit(360.0), half / F.cos(F.radians(pole)))).otherwise(360.0)
    fine = points.filter((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & (F.col(metres) >= 0) & (F.col(metres) < float("inf"))).withColumns({"half": half, "wide": wide})
    rows = fine.withColumn("tile_y", F.explode(F.sequence(_tile_y(F.col(lat) - F.col("half")), _tile_y(F.col(lat) + F.col("half")))))
    asked = rows.withColumn("tile_x", F.explode(F.sequence(_tile_x(F.col(lon) - F.col("wide"), y), _tile_x(F.col(lon) + F.col("wide"), y))))
    # few bytes meet in much work: as many tasks as a shuffle has, not as few as the bytes ask for
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asked.join(places.withColumns(_tiled("near_lat", "near_lon")).repartition(parts, "tile_y", "tile_x"), ["tile_y", "tile_x"])
    met = met.filter((F.abs(F.col("near_lat") - F.col(lat)) <= F.col("half")) & (F.abs(F.col("near_lon") - F.col(lon)) <= F.col("wide")))
    return met.withColumn("distance_m", haversine(lat, lon, "near_lat", "near_lon")).filter(F.col("distance_m") <= F.col(metres))


def clipped(points: DataFrame, nodes: DataFrame, key: str, lat: str, lon: str, metres: str) -> DataFrame:
    """(key, node_id, distance_m): nodes within `metres` of each point, see _near()."""
    at = nodes.select("node_id", F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"))
    return _near(points.select(key, lat, lon, metres), at, lat, lon, metres).select(key, "node_id", "distance_m")


def clipped_sizes(points: DataFrame, nodes: DataFrame, edges: DataFrame, key: str, lat: str, lon: str, metres: str) -> DataFrame:
    """(key, nodes, edges): of each point that has any, how many nodes clipped() finds and how many edges have both ends among them.

    Nodes and edges come to their tiles, both with their places, and are counted where they meet the points: neither pairs
    of points and nodes nor their joins with edges are shuffled. Points that repeat count as their joins would have them.
    """
    at = lambda c, k: nodes.select(F.col("node_id").alias(c), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    ends = edges.select("from_node", "to_node").dropna().select(F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b"))
    pairs = ends.groupBy("a", "b").agg(F.count("*").alias("n")).join(at("a", "near"), "a").join(at("b", "far"), "b")
    place = ["near_lat", "near_lon", "far_lat", "far_lon", "n"]
    single = at("node_id", "near").withColumns({"far_lat": F.lit(None).cast("double"), "far_lon": F.lit(None).cast("double"), "n": F.lit(None).cast("long")})
    once = points.groupBy(key, lat, lon, metres).agg(F.count("*").alias("copies"))
    met = _near(once, single.select(place).unionAll(pairs.select(place)), lat, lon, metres)
    inside = met.filter(F.col("n").isNull() | (haversine(lat, lon, "far_lat", "far_lon") <= F.col(metres)))
    counts = inside.groupBy(key).agg(F.sum(F.when(F.col("n").isNull(), F.col("copies"))).alias("nodes"), F.sum(F.col("n") * F.col("copies") * F.col("copies")).alias("edges"))
    return counts.select(key, "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def arcs_of(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, float]:
    """The network as a search reads it: edges with the place they lead to, and for each node an arc that stays there.

    Also the least length of an edge for a metre between its ends, 1 at most: so much of the straight distance is sure.
    """
    at = nodes.select("node_id", F.col("lat").alias("next_lat"), F.col("lon").alias("next_lon"))
    go = edges.select("edge_id", F.col("from_node").alias("node_id"), F.col("to_node").alias("next"), "length_m", F.col("surface").cast("int").alias("surface"), F.col("traffic").cast("int").alias("traffic"))
    stay = nodes.select(F.lit(None).cast("long").alias("edge_id"), "node_id", F.col("node_id").alias("next"), F.lit(0.0).alias("length_m"), F.lit(0).alias("surface"), F.lit(0).alias("traffic"))
    placed = go.unionAll(stay).join(at.withColumnRenamed("node_id", "next"), "next").join(nodes.select("node_id", "lat", "lon"), "node_id")
    chord = haversine("lat", "lon", "next_lat", "next_lon")
    sure = Observation()
    seen = placed.observe(sure, F.min(F.when(chord > 0, F.col("length_m") / chord)).alias("least"))
    arcs = written(seen.select("edge_id", "node_id", "next", "length_m", "surface", "traffic", "next_lat", "next_lon", "lat", "lon"), "trip-arcs")
    return arcs, max(0.0, min(1.0, sure.get["least"] or 0.0)) * (1 - 1e-12)


def cheapest_paths(trips: DataFrame, nodes: DataFrame, edges: DataFrame, used: DataFrame | None = None, factor: float = REUSE_FACTOR,
                   max_nodes: int = MAX_NODES, max_rounds: int = 10_000, walked: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Cheapest paths of trips(trip_id, from_node, to_node, w_paved, w_traffic, reach_m).

    Gives (trip_id, cost, explored_nodes, status) of each trip and (trip_id, seq, edge_id) of the paths found
    (None without `walked`). The search stays within reach_m of the start, or has no bound where that is null. used(trip_id, edge_id) are
    segments that cost `factor` times as much in either direction. status is ok, no_path or budget_exceeded, where over
    `max_nodes` nodes would be explored before the target: those whose cost plus straight distance to it is no more
    than the path's. From a node to itself is an empty path. Of paths that cost the same one with the fewest edges is
    kept, of those one with the least last edge_id, and so on backward. trip_id may have any type that can be joined.
    """
    return _searched(trips, nodes, *arcs_of(nodes, edges), used, factor, max_nodes, max_rounds, walked)


def _moved(here: DataFrame, arcs: DataFrame, sure: float, again: DataFrame | None) -> DataFrame:
    """Rows of `here`(trip_id, node_id, cost, CARRIED) along their arcs: (trip_id, next, came, edge_id, cost, h, CARRIED)."""
    step = edge_cost(F.col("length_m"), F.col("surface"), F.col("traffic"), F.col("w_paved"), F.col("w_traffic"))
    out = here.join(arcs, "node_id")
    if again is not None:
        out = out.withColumn("segment", F.expr("edge_id div 2")).join(again, ["trip_id", "segment"], "left")
        step = step * F.coalesce("again", F.lit(1.0))
    further = F.when(F.col("edge_id").isNull(), F.col("cost")).otherwise(F.col("cost") + (step + PER_EDGE))
    out = out.select("trip_id", "next", F.col("node_id").alias("came"), "edge_id", further.alias("cost"), haversine("next_lat", "next_lon", "to_lat", "to_lon").alias("h"), *CARRIED, "next_lat", "next_lon")
    near = F.col("reach_m").isNull() | (haversine("from_lat", "from_lon", "next_lat", "next_lon") <= F.col("reach_m"))
    return out.filter((F.col("best").isNull() | (F.col("cost") + sure * F.col("h") <= F.col("best") + SLACK)) & near).drop("next_lat", "next_lon")


def _zoned(ends: DataFrame) -> DataFrame:
    """`ends` with the tile of each trip's start, and the zone of the tile that the trip is dealt to."""
    tiled = ends.withColumns({"tile_y": F.floor(F.col("from_lat") / ZONE_DEG), "tile_x": F.floor(F.col("from_lon") / ZONE_DEG)})
    many = tiled.groupBy("tile_y", "tile_x").agg(F.ceil(F.count("*") / ZONE_TRIPS).alias("zones"))
    return tiled.join(many, ["tile_y", "tile_x"]).withColumn("zone", F.xxhash64("tile_y", "tile_x", F.pmod(F.xxhash64("trip_id"), "zones"))).drop("zones")


def _zone_tiles(ends: DataFrame) -> DataFrame:
    """(zone, high, wide, mid_y, mid_x, y, x): the tiles that each zone's trips can reach."""
    zones = ends.groupBy("zone", "tile_y", "tile_x").agg(F.max("reach_m").alias("reach"))
    high = F.col("reach") * 1.01 / DEGREE_M + 1e-9
    mid_y, mid_x = (F.col("tile_y") + 0.5) * ZONE_DEG, (F.col("tile_x") + 0.5) * ZONE_DEG
    zones = zones.select("zone", "tile_y", "tile_x", (high + ZONE_DEG / 2).alias("high"), mid_y.alias("mid_y"), mid_x.alias("mid_x"))
    # parallels are shortest towards a pole; where a zone comes near one, any meridian may be in reach
    short = F.least(*(F.abs(F.cos(F.radians(F.col("mid_y") + s * F.col("high")))) for s in (-1, 1)))
    pole = (F.abs(F.abs("mid_y") - 90) <= F.col("high")) | (short < 0.01)
    zones = zones.withColumn("wide", F.when(pole, 180.0).otherwise(F.least(F.lit(180.0), ZONE_DEG / 2 + F.col("high") / short)))
    steps = lambda mid, half: F.explode(F.sequence(F.floor((mid - half) / ZONE_DEG), F.floor((mid + half) / ZONE_DEG)))
    asked = zones.select("zone", "high", "wide", "mid_y", "mid_x", steps(F.col("mid_y"), F.col("high")).alias("y"))
    return asked.select("*", steps(F.col("mid_x"), F.col("wide")).alias("x")).withColumn("x", F.pmod("x", F.lit(int(360 / ZONE_DEG)))).distinct()


def _tiled_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.withColumns({"y": F.floor(F.col("lat") / ZONE_DEG), "x": F.pmod(F.floor(F.col("lon") / ZONE_DEG), F.lit(int(360 / ZONE_DEG)))})


def _zone_arcs(ends: DataFrame, arcs: DataFrame) -> DataFrame:
    """The arcs that start within the reach of each zone's trips; zones and arcs meet by tiles."""
    aside = F.abs(F.pmod(F.col("lon") - F.col("mid_x") + 180, F.lit(360.0)) - 180)
    inside = (F.abs(F.col("lat") - F.col("mid_y")) <= F.col("high")) & ((F.col("wide") >= 180) | (aside <= F.col("wide")))
    return _tiled_arcs(arcs).join(_zone_tiles(ends), ["y", "x"]).filter(inside).select("zone", *(c for c in arcs.columns if c not in ("lat", "lon")))


def _metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """haversine() of arrays in degrees."""
    lat1, lon1, lat2, lon2 = (np.radians(x) for x in (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def _relaxed(max_nodes: int, walked: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What searches a zone's trips on its arcs: (trip_id, total, explored_nodes, edges) of each."""

    def search(trip: dict, at: dict, arc: dict, schema: pa.Schema, trip_id: pa.ChunkedArray) -> pa.Table:
        every, n_trips = np.arange(len(trip["start"])), len(trip["start"])
        inside = np.abs(at["lat"] - trip["from_lat"][:, None]) <= trip["reach_m"][:, None] * 1.01 / DEGREE_M + 1e-9
        t, v = np.nonzero(inside)
        inside[t, v] = _metres(trip["from_lat"][t], trip["from_lon"][t], at["lat"][v], at["lon"][v]) <= trip["reach_m"][t]
        inside[every, trip["start"]] = True
        t, v = np.nonzero(inside)  # a place: a trip at one of its nodes
        place = np.full(inside.shape, -1, np.int32)
        place[t, v] = np.arange(len(t), dtype=np.int32)
        ways = arc["first"][v + 1] - arc["first"][v]
        to = np.repeat(np.arange(len(t)), ways)
        k = np.arange(len(to)) + np.repeat(arc["first"][v] - (np.cumsum(ways) - ways), ways)
        came = place[t[to], arc["src"][k]]
        step = arc["m"][k] * (1.0 + trip["w_paved"][t[to]] * arc["penalty"][k] + trip["w_traffic"][t[to]] * arc["traffic"][k] / 255.0) + PER_EDGE
        fine = (came >= 0) & np.isfinite(step)
        to, came, step, edge = to[fine], came[fine], step[fine], arc["edge_id"][k[fine]]
        group = np.flatnonzero(np.diff(to, prepend=-1))
        heads, begin = to[group], place[every, trip["start"]]
        best = np.full(len(t), np.inf)
        best[begin] = 0.0
        for _ in range(len(t) + 1 if len(to) else 0):
            arrived = np.minimum.reduceat(best[came] + step, group)
            better = arrived < best[heads]
            if not better.any():
                break
            best[heads[better]] = arrived[better]
        else:
            if len(to):
                raise RuntimeError("paths did not settle")
        goal = np.where(trip["end"] >= 0, place[every, trip["end"]], -1)
        total = np.where(goal >= 0, best[goal], np.inf)
        seen = np.isfinite(best) & (best + _metres(at["lat"][v], at["lon"][v], trip["to_lat"][t], trip["to_lon"][t]) <= total[t] + EXPLORED)
        explored = np.bincount(t[seen], minlength=n_trips)
        found = np.isfinite(total)
        who, steps = np.flatnonzero(found & (explored - 1 <= max_nodes) & walked), []
        if len(who):
            hit = np.flatnonzero(best[came] + step == best[to])[::-1]  # backward, so that the least edge_id is the last one set
            last, before = np.full(len(t), -1, np.int64), np.full(len(t), -1, np.int64)
            last[to[hit]], before[to[hit]] = edge[hit], came[hit]
            here = goal[who]
            while len(who):
                steps.append((who, last[here]))
                here = before[here]
                on = here != begin[who]
                who, here = who[on], here[on]
        owner = np.concatenate([w for w, _ in reversed(steps)]) if steps else np.zeros(0, np.int64)
        edges = np.concatenate([e for _, e in reversed(steps)]) if steps else np.zeros(0, np.int64)
        offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(np.bincount(owner, minlength=n_trips)).astype(np.int32)))
        paths = pa.ListArray.from_arrays(pa.array(offsets), pa.array(edges[np.argsort(owner, kind="stable")]))
        columns = [trip_id, pa.array(total, mask=~found), pa.array(explored.astype(np.int64)), paths]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(trips: pa.Table, arcs: pa.Table) -> pa.Table:
        schema = pa.schema([pa.field("trip_id", trips.schema.field("trip_id").type), ("total", pa.float64()), ("explored_nodes", pa.int64()), ("edges", pa.list_(pa.int64()))])
        read = lambda table, name: table.column(name).to_numpy()
        stay = arcs.filter(pc.is_null(arcs.column("edge_id")))
        go = arcs.filter(pc.is_valid(arcs.column("edge_id")))
        ids, own = np.unique(read(stay, "node_id"), return_index=True)
        at = {"lat": read(stay, "next_lat")[own], "lon": read(stay, "next_lon")[own]}
        find = lambda nodes: np.minimum(np.searchsorted(ids, nodes), len(ids) - 1)
        src, dst = find(read(go, "node_id")), find(read(go, "next"))
        # an arc to a node that isn't there leads beyond the reach of all trips of the zone
        order = np.flatnonzero((ids[src] == read(go, "node_id")) & (ids[dst] == read(go, "next")))
        order = order[np.lexsort((read(go, "edge_id")[order], dst[order]))]
        surface = read(go, "surface")[order].astype(float)
        arc = {"src": src[order], "edge_id": read(go, "edge_id")[order], "m": read(go, "length_m")[order], "traffic": read(go, "traffic")[order].astype(float),
               "penalty": np.select([surface == 1, surface == 2, surface == 3], [1.0, 0.3, 0.0], 0.5), "first": np.searchsorted(dst[order], np.arange(len(ids) + 1))}
        trip = {c: read(trips, c) for c in ("w_paved", "w_traffic", "reach_m", "from_lat", "from_lon", "to_lat", "to_lon")}
        end = find(read(trips, "to_node"))
        trip |= {"start": find(read(trips, "from_node")), "end": np.where(ids[end] == read(trips, "to_node"), end, -1)}
        most = max(1, CELLS // (len(ids) + len(order)))
        parts = [search({c: x[i:i + most] for c, x in trip.items()}, at, arc, schema, trips.column("trip_id").slice(i, most).combine_chunks()) for i in range(0, trips.num_rows, most)]
        return pa.concat_tables([schema.empty_table(), *parts])  # all trips of a zone may stay where they are

    return run


def _by_zones(ends: DataFrame, n: int, arcs: DataFrame, max_nodes: int, walked: bool) -> DataFrame:
    """(trip_id, total, explored_nodes, edges) of about `n` `ends`, whose zones have few arcs: each zone's trips and arcs meet in one shuffle."""
    out = StructType([StructField("trip_id", ends.schema["trip_id"].dataType), StructField("total", DoubleType()), StructField("explored_nodes", LongType()), StructField("edges", ArrayType(LongType()))])
    place = {c: F.when(F.col("edge_id").isNull(), F.col(c)) for c in ("next_lat", "next_lon")}  # once for each node
    mine = _zone_arcs(ends, arcs.withColumns(place)).withColumnRenamed("zone", "arc_zone")
    moving = ends.filter("from_node <> to_node").select("zone", "trip_id", "from_node", *CARRIED[:-1])
    parts = n // TASK_TRIPS + 8  # few bytes are much work
    both = moving.repartition(parts, "zone").groupBy("zone").cogroup(mine.repartition(parts, "arc_zone").groupBy("arc_zone"))
    return written(both.applyInArrow(_relaxed(max_nodes, walked), out), "trip-settled")


def _parted(ends: DataFrame, arcs: DataFrame) -> tuple[DataFrame | None, int, DataFrame | None]:
    """`ends` that can go by zones, with their zone, how many at most, and those that can't; None for none."""
    near = (F.col("reach_m") >= 0) & (F.col("reach_m") <= ZONE_REACH_M)
    for c in ("from_lat", "from_lon", "to_lat", "to_lon"):
        near &= F.abs(c) < float("inf")
    near = F.coalesce(near, F.lit(False))
    if ends.filter(near).isEmpty():
        return None, 0, ends
    zoned, n = counted(_zoned(ends.filter(near)), "trip-zones")
    sizes = _tiled_arcs(arcs).groupBy("y", "x").agg(F.count("*").alias("n"))
    large = _zone_tiles(zoned).join(sizes, ["y", "x"]).groupBy("zone").agg(F.sum("n").alias("n")).filter(F.col("n") > ZONE_ARCS).select("zone")
    far = ends.filter(~near)
    if n:
        large = written(large, "large-zones")
        far = far.unionAll(zoned.join(large, "zone", "left_semi").select(ends.columns))
    far, away = counted(far, "trip-far")
    return zoned.join(large, "zone", "left_anti") if n else None, n, far if away else None


def _searched(trips: DataFrame, nodes: DataFrame, arcs: DataFrame, sure: float, used: DataFrame | None = None, factor: float = REUSE_FACTOR,
              max_nodes: int = MAX_NODES, max_rounds: int = 10_000, walked: bool = True) -> tuple[DataFrame, DataFrame | None]:
    at = nodes.select("node_id", "lat", "lon")
    ends = trips.join(at.withColumnsRenamed({"node_id": "from_node", "lat": "from_lat", "lon": "from_lon"}), "from_node").join(
        at.withColumnsRenamed({"node_id": "to_node", "lat": "to_lat", "lon": "to_lon"}), "to_node")
    ends = written(ends.select("trip_id", "from_node", "to_node", "w_paved", "w_traffic", "reach_m", "from_lat", "from_lon", "to_lat", "to_lon"), "trip-ends")
    near, n, far = _parted(ends, arcs) if used is None else (None, 0, ends)
    seen, paths = [], []
    if near is not None:
        settled = _by_zones(near, n, arcs, max_nodes, walked)
        seen.append(settled.select("trip_id", "total", "explored_nodes"))
        paths.append(settled.select("trip_id", F.posexplode("edges").alias("seq", "edge_id"), F.size("edges").alias("n")).select("trip_id", (F.col("seq") - F.col("n") + 1).alias("seq"), "edge_id"))
    if far is not None or near is None:
        totals, path = _by_rounds(ends if far is None else far, arcs.drop("lat", "lon"), sure, used, factor, max_nodes, max_rounds, walked)
        seen.append(totals)
        paths.append(path)
    found = _judged(ends, reduce(DataFrame.unionAll, seen), max_nodes)
    result = trips.select("trip_id").join(found, "trip_id", "left").select("trip_id", "cost", F.coalesce("explored_nodes", F.lit(0)).cast("long").alias("explored_nodes"), F.coalesce("status", F.lit("no_path")).alias("status"))
    return result, reduce(DataFrame.unionAll, paths) if walked else None


def _judged(ends: DataFrame, seen: DataFrame, max_nodes: int) -> DataFrame:
    """(trip_id, cost, explored_nodes, status) of `ends`, by the total cost and the number of explored nodes of those that move."""
    n, still = F.coalesce("explored_nodes", F.lit(0)), F.col("from_node") == F.col("to_node")
    status = F.when(still, "ok").when(n - F.col("total").isNotNull().cast("int") > max_nodes, "budget_exceeded").when(F.col("total").isNull(), "no_path").otherwise("ok")
    judged = ends.select("trip_id", "from_node", "to_node").join(seen, "trip_id", "left")
    return judged.select("trip_id", F.when(status == "ok", F.when(still, 0.0).otherwise(F.col("total"))).alias("cost"), n.cast("long").alias("explored_nodes"), status.alias("status"))


def _by_rounds(ends: DataFrame, arcs: DataFrame, sure: float, used: DataFrame | None, factor: float, max_nodes: int, max_rounds: int, walked: bool) -> tuple[DataFrame, DataFrame | None]:
    """(trip_id, total, explored_nodes) of `ends` that move, and (trip_id, seq, edge_id) of their paths, over the whole network."""
    place = ["trip_id", "node_id"]
    moving = written(ends.filter("from_node <> to_node").select("trip_id", "from_node", *CARRIED[:-1]), "trip-moving")
    again = None
    if used is not None:
        segment = used.select("trip_id", F.expr("edge_id div 2").alias("segment")).distinct()
        again = written(segment.withColumn("again", F.lit(max(factor, 1.0))), "trip-again")
    kept = lambda *names: [F.any_value(c).alias(c) for c in names]
    front = moving.select("trip_id", F.col("from_node").alias("node_id"), F.lit(0.0).alias("cost"), haversine("from_lat", "from_lon", "to_lat", "to_lon").alias("h"), F.lit(False).alias("goal"))
    known = [front]
    every = lambda: reduce(DataFrame.unionAll, known)
    every_known = lambda: every().groupBy(*place).agg(F.min("cost").alias("cost"), *kept("h", "goal"))
    for k in range(max_rounds):
        best = every().filter("goal").groupBy("trip_id").agg(F.min("cost").alias("best"))
        here = front.join(moving.join(best, "trip_id", "left").select("trip_id", *CARRIED), "trip_id").filter(F.col("best").isNull() | (F.col("cost") + sure * F.col("h") <= F.col("best") + SLACK))
        for _ in range(HOPS):
            here = _moved(here, arcs, sure, again).groupBy("trip_id", F.col("next").alias("node_id")).agg(F.min("cost").alias("cost"), *kept("h", *CARRIED))
        for i, f in enumerate(known):
            here = here.join(f.select(*place, F.col("cost").alias(f"before_{i}")), place, "left")
        better = here.filter(F.col("cost") < F.least(F.lit(float("inf")), *(F.coalesce(f"before_{i}", F.lit(float("inf"))) for i in range(len(known)))))
        front, changed = counted(better.select(*place, "cost", "h", (F.col("node_id") == F.col("to_node")).alias("goal")), "trip-front")
        if not changed:
            break
        known.append(front)
        if k % COMPACT == COMPACT - 1:
            known = [written(every_known(), "trip-known")]
    else:
        raise RuntimeError("paths did not settle")
    state = written(every_known(), "trip-state")
    goal = moving.join(state.filter("goal").select("trip_id", F.col("cost").alias("total")), "trip_id", "left").select("trip_id", "total")
    seen = state.join(goal, "trip_id").groupBy("trip_id").agg(F.any_value("total").alias("total"), F.count_if(F.col("total").isNull() | (F.col("cost") + F.col("h") <= F.col("total") + EXPLORED)).alias("explored_nodes"))
    seen = written(seen, "trip-found")
    if not walked:
        return seen, None
    found = _judged(ends.filter("from_node <> to_node"), seen, max_nodes).filter("status = 'ok'").join(moving.select("trip_id", "to_node"), "trip_id")
    return seen, _walked(moving.withColumn("best", F.lit(None).cast("double")).select("trip_id", *CARRIED), found, state, arcs.filter("edge_id is not null"), sure, again)


def _walked(trips: DataFrame, found: DataFrame, state: DataFrame, arcs: DataFrame, sure: float, again: DataFrame | None) -> DataFrame:
    """The edges of each path, by pointer doubling along the predecessors of nodes that may lie on it."""
    place = ["trip_id", "node_id"]
    total = found.select("trip_id", F.col("cost").alias("total"))
    near = state.join(total, "trip_id").filter(F.col("cost") + sure * F.col("h") <= F.col("total") + SLACK).select(*place, "cost")
    came = _moved(near.join(trips, "trip_id"), arcs, sure, again).select("trip_id", F.col("next").alias("node_id"), "came", "edge_id", "cost")
    back = came.join(near, [*place, "cost"]).groupBy(*place).agg(F.min(F.struct("edge_id", "came")).alias("b"))
    back = written(back.select(*place, "b.edge_id", "b.came"), "trip-back")
    jumps, jump, some = [], back.select(*place, F.col("came").alias("to")), True
    while some:  # until none is left that goes so many edges back
        jumps.append(jump)
        half = jump.select("trip_id", F.col("node_id").alias("to"), F.col("to").alias("further"))
        jump, some = counted(jump.join(half, ["trip_id", "to"]).select(*place, F.col("further").alias("to")), "trip-jump")
    on = found.select("trip_id", F.col("to_node").alias("node_id"), F.lit(0).alias("seq"))
    for k in reversed(range(len(jumps))):  # the farthest first: after each, the known nodes of a path are twice as many
        both = F.array(F.struct("node_id", "seq"), F.struct(F.col("to").alias("node_id"), (F.col("seq") - (1 << k)).alias("seq")))
        on = on.join(jumps[k], place, "left").select("trip_id", F.inline(F.filter(both, lambda x: x["node_id"].isNotNull())))
    return written(on.join(back.drop("came"), place).select("trip_id", "seq", "edge_id"), "trip-edges")


def leg_totals(legs: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, candidate, leg, length_m, unpaved_m, traffic_exposure_m, retraced_m, n_edges) of legs(request_id, candidate, leg, edge_id).

    An edge is retraced if an earlier leg of the loop has its segment in either direction. Edges that the
    network doesn't have count for nothing.
    """
    known = legs.join(edges.select("edge_id", "length_m", "surface", "traffic"), "edge_id").withColumn("segment", F.expr("edge_id div 2"))
    first = F.min("leg").over(W.partitionBy("request_id", "candidate", "segment"))  # one shuffle serves this and the sums
    m = F.col("length_m")
    return known.repartition("request_id", "candidate").withColumn("first", first).groupBy("request_id", "candidate", "leg").agg(
        F.sum(m).alias("length_m"), F.sum(F.when(F.col("surface") != 1, m).otherwise(0.0)).alias("unpaved_m"), F.sum(m * F.col("traffic") / 255).alias("traffic_exposure_m"),
        F.sum(F.when(F.col("leg") > F.col("first"), m).otherwise(0.0)).alias("retraced_m"), F.count("*").alias("n_edges"))


def start_bearings(requests: DataFrame, count: int = CANDIDATES) -> DataFrame:
    """`requests` with candidate and bearing in radians: `count` even directions, each with a jitter that the request alone decides."""
    seed = F.format_string("%.6f|%.6f|%.1f|%.3f|%.3f|%d|%d", "start_lat", "start_lon", "distance_m", "tolerance", "avoid_paved", F.col("max_results").cast("int"), F.col("variant").cast("int"))
    out = requests.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", seed, F.col("candidate").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return out.withColumn("bearing", F.col("candidate") * (2 * math.pi / count) + draw * JITTER)


def waypoint(lat: Column, lon: Column, bearing: Column, distance: Column, detour: Column, k: int) -> tuple[Column, Column]:
    """The k-th of a loop's waypoints, 120 degrees apart around its start."""
    return destination(lat, lon, bearing + k * 2 * math.pi / WAYPOINTS, loop_radius(distance, detour))


def loop_candidates(requests: DataFrame, nodes: DataFrame, edges: DataFrame, count: int = CANDIDATES, tries: int = TRIES) -> DataFrame:
    """(request_id, candidate, leg, seq, edge_id) of the loops found for snapped requests(request_id, node_id, w_paved, w_traffic, ...).

    All candidates of all requests go together: `tries` rounds of bisection on the detour factor, in each three
    waypoints and the way home, a leg each, on which segments of earlier legs cost more. A waypoint that can't be snapped
    or is where the loop stands is passed over; a candidate without a path is dropped; so is one that never is within
    tolerance. A try without any leg has no length, so the next goes farther out. A leg may lead anywhere in the network.
    """
    at = nodes.select(F.col("node_id"), F.col("lat").alias("here_lat"), F.col("lon").alias("here_lon"))
    arcs, sure = arcs_of(nodes, edges)
    todo = start_bearings(requests, count).join(at, "node_id").withColumns({"trip_id": F.struct("request_id", "candidate"), "lo": F.lit(DETOUR_LO), "hi": F.lit(DETOUR_HI), "detour": F.lit(DETOUR)})
    todo, done = written(todo, "loop-todo"), None
    for _ in range(tries):
        turns = [waypoint(F.col("here_lat"), F.col("here_lon"), F.col("bearing"), F.col("distance_m"), F.col("detour"), k) for k in range(WAYPOINTS)]
        places = todo.select("trip_id", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), lat.alias("lat"), lon.alias("lon")) for k, (lat, lon) in enumerate(turns)])))
        snapped = snap(places.select(F.struct("trip_id", "k").alias("place"), "lat", "lon"), nodes, "place", "lat", "lon").filter("status = 'ok'")
        goals = snapped.groupBy(F.col("place.trip_id").alias("trip_id")).agg(F.map_from_entries(F.collect_list(F.struct("place.k", "node_id"))).alias("goals"))  # WAYPOINTS at most
        stops = [F.col("node_id")]
        for k in range(WAYPOINTS):
            stops.append(F.coalesce(F.try_element_at("goals", F.lit(k)), stops[-1]))
        legs = todo.join(goals, "trip_id", "left").select("trip_id", "w_paved", "w_traffic", F.array(*stops, F.col("node_id")).alias("stops"))
        legs = written(legs, "loop-legs")
        alive, walked = legs.select("trip_id"), None
        for leg in range(WAYPOINTS + 1):
            trips = legs.join(alive, "trip_id").select("trip_id", F.col("stops")[leg].alias("from_node"), F.col("stops")[leg + 1].alias("to_node"), "w_paved", "w_traffic", F.lit(None).cast("double").alias("reach_m"))
            found, path = _searched(trips, nodes, arcs, sure, walked)
            alive = written(found.filter("status = 'ok'").select("trip_id"), "loop-alive")
            path = path.withColumn("leg", F.lit(leg))
            walked = path if walked is None else walked.unionAll(path)
        length = walked.join(edges.select("edge_id", "length_m"), "edge_id").groupBy("trip_id").agg(F.sum("length_m").alias("m"))
        tried = todo.join(alive, "trip_id").join(length, "trip_id", "left").withColumn("gap", (F.coalesce("m", F.lit(0.0)) - F.col("distance_m")) / F.col("distance_m"))
        tried = written(tried, "loop-tried")
        good = tried.filter(F.abs("gap") <= F.col("tolerance")).select("trip_id", "request_id", "candidate")
        mine = walked.join(good, "trip_id").select("request_id", "candidate", "leg", "seq", "edge_id")
        done = written(mine if done is None else done.unionAll(mine), "loop-done")
        bad = tried.filter(F.abs("gap") > F.col("tolerance")).withColumns({"lo": F.when(F.col("gap") > 0, F.col("detour")).otherwise(F.col("lo")), "hi": F.when(F.col("gap") > 0, F.col("hi")).otherwise(F.col("detour"))})
        todo, left = counted(bad.withColumn("detour", (F.col("lo") + F.col("hi")) / 2).drop("m", "gap"), "loop-todo")
        if not left:
            break
    return done


def generate_loops(requests: DataFrame, nodes: DataFrame, edges: DataFrame, count: int = CANDIDATES, tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """From requests to ranked loops: (request_id, candidate, rank, figures) and (request_id, candidate, leg, seq, edge_id).

    Invalid requests and those whose start isn't near the main component have no loops.
    """
    asked = with_defaults(validated(requests))
    good = asked.filter("error is null")
    starts = snap(good, nodes, "request_id", "start_lat", "start_lon").filter("status = 'ok'").select("request_id", "node_id")
    found = loop_candidates(good.join(starts, "request_id"), nodes, edges, count, tries)
    legs = leg_totals(found, edges).groupBy("request_id", "candidate").agg(*[F.sum(c).alias(c) for c in ("length_m", "unpaved_m", "traffic_exposure_m", "retraced_m")])
    sets = found.groupBy("request_id", "candidate").agg(F.array_sort(F.collect_set("edge_id")).alias("edge_set"))
    loops = distinct_loops(written(legs.join(sets, ["request_id", "candidate"]), "loop-totals"))
    best = written(ranked_for(loops.withColumn("asked", F.col("request_id")), asked), "loop-ranked")
    return best, found.join(best.select("request_id", "candidate"), ["request_id", "candidate"], "left_semi")


CHECKS = ("unknown", "apart", "open", "tolerance", "alike")


def audited(walks: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, candidate, unknown, apart, open, tolerance, edges) of each loop, see audit_loops; `edges` names its set of directed edges."""
    place = F.struct("leg", "seq")  # a request's loops meet in one task, so all that follows needs no further shuffle of them
    full = walks.join(edges.select("edge_id", "from_node", "to_node", "length_m"), "edge_id", "left").repartition("request_id").withColumn("place", place)
    after = F.lead("from_node").over(W.partitionBy("request_id", "candidate").orderBy("leg", "seq", "edge_id"))
    loops = full.withColumn("after", after).groupBy("request_id", "candidate").agg(
        F.count_if(F.col("from_node").isNull()).alias("unknown"), F.count_if(F.col("after") != F.col("to_node")).alias("apart"),
        F.min_by("from_node", "place").alias("first"), F.max_by("to_node", "place").alias("last"), F.sum("length_m").alias("m"), F.md5(F.array_join(F.array_sort(F.collect_set("edge_id")), ",")).alias("edges"))
    off = F.abs(F.col("m") - F.col("distance_m")) > F.col("tolerance") * F.col("distance_m")
    told = loops.join(requests.select("request_id", "distance_m", "tolerance"), "request_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    return told.select("request_id", "candidate", "unknown", "apart", flag(F.col("first") != F.col("last")).alias("open"), flag(off).alias("tolerance"), "edges")


def audit_loops(walks: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(check, violations) of walks(request_id, candidate, leg, seq, edge_id) for requests(request_id, distance_m, tolerance).

    unknown: edges that the network doesn't have. apart: edges that don't start where the one before ends.
    open: loops that don't end where they start. tolerance: loops off their distance. alike: pairs of a
    request's loops with the same directed edges.
    """
    same = audited(walks, edges, requests).groupBy("request_id", "edges").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in CHECKS[:-1]))
    one = same.agg(*(F.sum(c).alias(c) for c in CHECKS[:-1]), F.sum(F.expr("n * (n - 1) div 2")).alias("alike"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(c, F.lit(0)).cast("long").alias("violations")) for c in CHECKS])))
