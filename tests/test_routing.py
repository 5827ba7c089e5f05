"""Cheapest paths, loops and their audit on small networks with known answers."""

import heapq
import math
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from trailmill.functions import geo, shared
from trailmill.operators import export, network, requests, routing
from trailmill.streaming import live

NODE, EDGE = "node_id long, lat double, lon double", "edge_id long, from_node long, to_node long, length_m double, surface int, traffic int"
TRIP = "trip_id long, from_node long, to_node long, w_paved double, w_traffic double, reach_m double"


def graph(spark, nodes, segments):
    """Segments are (a, b, length, surface, traffic); both directions, ids in the order given."""
    rows = [(2 * k + d, *((a, b) if d == 0 else (b, a)), float(m), s, t) for k, (a, b, m, s, t) in enumerate(segments) for d in (0, 1)]
    return spark.createDataFrame([(i, *x) for i, x in nodes.items()], NODE), spark.createDataFrame(rows, EDGE)


SQUARE = {0: (48.100, -1.680), 1: (48.100, -1.667), 2: (48.109, -1.667), 3: (48.109, -1.680), 9: (48.2, -1.5)}
SIDES = [(0, 1, 966, 0, 0), (1, 2, 1001, 0, 0), (2, 3, 966, 0, 0), (3, 0, 1001, 0, 0)]


def test_paths_of_the_square(spark):
    """All cases in one batch: a corner, used segments in either direction, no path, nowhere to go, an unknown node."""
    nodes, edges = graph(spark, SQUARE, SIDES)
    trips = spark.createDataFrame([(k, a, b, 0.0, 0.0, 50_000.0) for k, (a, b) in enumerate([(0, 2), (0, 1), (0, 1), (0, 9), (2, 2), (0, 77)])], TRIP)
    used = spark.createDataFrame([(1, 0), (2, 1)], "trip_id long, edge_id long")
    found, path = routing.cheapest_paths(trips, nodes, edges, used, factor=1000.0)
    got = {r.trip_id: (r.status, r.cost and round(r.cost, 3)) for r in found.collect()}
    walk = {k: [r.edge_id for r in path.filter(F.col("trip_id") == k).orderBy("seq").collect()] for k in range(6)}
    assert got[0][0] == "ok" and got[0][1] >= 1932 and len(walk[0]) == 2
    assert walk[1] == walk[2] == [7, 5, 3] and got[1] == got[2]  # round the other way
    assert got[3] == ("no_path", None) and got[4] == ("ok", 0.0) and got[5] == ("no_path", None) and not walk[3] + walk[4] + walk[5]
    few, _ = routing.cheapest_paths(trips.filter("trip_id in (0, 3)"), nodes, edges, max_nodes=1)
    assert {r.status for r in few.collect()} == {"budget_exceeded"}
    none, edge = routing.cheapest_paths(trips.limit(0), nodes, edges)
    assert none.count() == 0 and edge.count() == 0


def test_weights_choose_the_detour(spark):
    nodes = {0: (48.100, -1.680), 1: (48.100, -1.670), 2: (48.100, -1.660), 3: (48.106, -1.670)}
    nodes, edges = graph(spark, nodes, [(0, 1, 740, 1, 255), (1, 2, 740, 1, 255), (0, 3, 900, 3, 0), (3, 2, 900, 3, 0)])
    trips = spark.createDataFrame([(0, 0, 2, 0.0, 0.0, 9e3), (1, 0, 2, 6.0, 12.0, 9e3)], TRIP)
    _, path = routing.cheapest_paths(trips, nodes, edges)
    assert [(r.trip_id, r.edge_id) for r in path.orderBy("trip_id", "seq").collect()] == [(0, 0), (0, 2), (1, 4), (1, 6)]


def test_retraced_metres(spark):
    _, edges = graph(spark, {0: (0.0, 0.0)}, [(0, 1, 700, 1, 51), (1, 2, 1500, 3, 0)])
    legs = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 1), (1, 0, 1, 2), (1, 0, 2, 99)], "request_id long, candidate int, leg int, edge_id long")
    got = {r.leg: (r.length_m, r.unpaved_m, round(r.traffic_exposure_m, 6), r.retraced_m, r.n_edges) for r in routing.leg_totals(legs, edges).collect()}
    assert got == {0: (700, 0, 140, 0, 1), 1: (2200, 1500, 140, 700, 2)}


def lattice(spark, n=9, step=0.002):
    at = {i * n + j: (48.1 + i * step, -1.68 + j * step * 1.5) for i in range(n) for j in range(n)}
    pairs = [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, (i + 1) * n + j) for i in range(n - 1) for j in range(n)]
    nodes, edges = graph(spark, at, [(a, b, 225, 3, 0) for a, b in pairs])
    x, y = geo.cell(F.col("lat"), F.col("lon"))
    return nodes.withColumns({"component_id": F.lit(0), "is_main": F.lit(True), "cell_x": x, "cell_y": y}), edges


def test_generated_loops_stand_the_audit(spark):
    nodes, edges = lattice(spark)
    asked = [(1, 48.108, -1.668, 2600.0, 0.3, "", 0.0, 2, 0), (2, 43.3, 5.37, 2600.0, 0.3, "", 0.0, 2, 0), (3, 48.108, -1.668, 100.0, 0.3, "", 0.0, 2, 0)]
    asked = spark.createDataFrame(asked, "request_id long, start_lat double, start_lon double, distance_m double, tolerance double, activity string, avoid_paved double, max_results int, variant int")
    best, walks = routing.generate_loops(asked, nodes, edges, count=3, tries=1)
    rows = best.orderBy("rank").collect()
    assert {r.request_id for r in rows} == {1} and [r.rank for r in rows] == list(range(1, len(rows) + 1)) and 1 <= len(rows) <= 2
    assert all(abs(r.ecart_cible) <= 0.3 for r in rows)
    assert {r["check"]: r.violations for r in routing.audit_loops(walks, edges, asked).collect()} == dict.fromkeys(("unknown", "apart", "open", "tolerance", "alike"), 0)


def test_streamed_requests_are_answered_once(spark, tmp_path):
    """Good, bad and unreadable requests of a stream; a batch that is replayed writes nothing twice."""
    nodes, edges = lattice(spark)
    good = '{"start":{"lat":48.108,"lon":-1.668},"distance_m":2600,"tolerance":0.5,"max_results":2}'
    rows = [(1, good), (2, good.replace("2600", "100")), (3, "no json"), (4, "{}"), (5, None)]
    raw = spark.createDataFrame(rows, "request_id long, body string")
    raw.coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).json(f"{tmp_path}/in")
    query = live.answer_stream(stream, nodes, edges, f"{tmp_path}/out", f"{tmp_path}/state", count=3, tries=1)
    query.awaitTermination(300)
    assert query.exception() is None
    read = lambda kind: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/{kind}").collect())
    replies, loops = read("replies"), read("loops")
    assert [(r[0], r[1]) for r in replies] == [(1, None), (2, "distance too short"), (3, "unreadable request"), (4, "unreadable request"), (5, "unreadable request")]
    assert replies[0][2] == len(loops) >= 1
    live.answer_requests(raw, 0, nodes, edges, f"{tmp_path}/out", count=3, tries=1)
    assert (replies, loops) == (read("replies"), read("loops"))


def metres(a, b):
    (p, x), (q, y) = ((math.radians(c) for c in z) for z in (a, b))
    return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2))


def plain_snap(at, lat, lon):
    """The nearest node up to a ring of cells beyond the first that has one."""
    here = math.floor(lon / 0.005), math.floor(lat / 0.005)
    seen = []
    for n, (a, o) in at.items():
        dx, dy = math.floor(o / 0.005) - here[0], math.floor(a / 0.005) - here[1]
        seen.append((max(abs(dx), abs(dy)), dx, dy, n))
    first = min(seen)[0]
    return min((metres((lat, lon), at[n]), ring, dx, dy, n) for ring, dx, dy, n in seen if ring <= min(first + 1, 20))[-1] if first <= 20 else None


def plain_path(out, start, end, used):
    best, heap = {}, [(0.0, start, None, None)]
    while heap:
        cost, n, edge, came = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = edge, came
        if n == end:
            path = []
            while best[n][0] is not None:
                path.append(best[n][0])
                n = best[n][1]
            return path[::-1]
        for e, to, m in out.get(n, ()):
            heapq.heappush(heap, (cost + m * (4 if e // 2 in used else 1), to, e, n))
    return None


def plain_loop(at, out, length, start, bearing, distance, tolerance, tries):
    """One candidate, try after try: its legs, or None."""
    lo, hi, detour = 0.8, 2.5, 1.3
    for _ in range(tries):
        used, legs, stand, radius = set(), [], start, distance / (2 * math.pi * detour)
        for k in range(4):
            turn = bearing + k * 2 * math.pi / 3
            lat, lon = at[start]
            goal = start if k == 3 else plain_snap(at, lat + radius * math.cos(turn) / 111320, lon + radius * math.sin(turn) / (111320 * math.cos(math.radians(lat))))
            if goal is None or goal == stand:
                continue
            path = plain_path(out, stand, goal, used)
            if path is None:
                return None
            legs.append((k, path))
            used |= {e // 2 for e in path}
            stand = goal
        gap = (sum(length[e] for _, path in legs for e in path) - distance) / distance
        if abs(gap) <= tolerance:
            return legs
        lo, hi = (detour, hi) if gap > 0 else (lo, detour)
        detour = (lo + hi) / 2
    return None


@pytest.mark.parametrize(("step", "distance", "tolerance", "tries"), [(0.01, 3900.0, 0.3, 2), (0.01, 4500.0, 0.2, 4)])
def test_candidates_are_those_of_a_plain_loop(spark, step, distance, tolerance, tries):
    """Tries without any leg, too short and too long ones go on as in a plain loop; lengths are such that no two paths cost the same."""
    rng, n = random.Random(7), 9
    at = {i * n + j: (48.1 + i * step, -1.68 + j * step * 1.5) for i in range(n) for j in range(n)}
    pairs = [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, (i + 1) * n + j) for i in range(n - 1) for j in range(n)]
    sides = [(a, b, metres(at[a], at[b]) * (1 + rng.random() / 10), 3, 0) for a, b in pairs]
    nodes, edges = graph(spark, at, sides)
    x, y = geo.cell(F.col("lat"), F.col("lon"))
    nodes = nodes.withColumns({"component_id": F.lit(0), "is_main": F.lit(True), "cell_x": x, "cell_y": y})
    asked = spark.createDataFrame([(k, node, *at[node], distance, tolerance, 0.0, 5, 0, 0.0, 0.0) for k, node in ((1, 40), (2, 20))],
                                  "request_id long, node_id long, start_lat double, start_lon double, distance_m double, tolerance double, avoid_paved double, max_results int, variant int, w_paved double, w_traffic double")
    out, length = {}, {}
    for k, (a, b, m, _, _) in enumerate(sides):
        for e, p, q in ((2 * k, a, b), (2 * k + 1, b, a)):
            out.setdefault(p, []).append((e, q, m))
            length[e] = m
    want = {}
    for r in routing.start_bearings(asked, 4).collect():
        if (legs := plain_loop(at, out, length, r.node_id, r.bearing, distance, tolerance, tries)) is not None:
            want[r.request_id, r.candidate] = [(k, e) for k, path in legs for e in path]
    got = {}
    for r in routing.loop_candidates(asked, nodes, edges, count=4, tries=tries).orderBy("leg", "seq").collect():
        got.setdefault((r.request_id, r.candidate), []).append((r.leg, r.edge_id))
    assert got == want and got


def test_loop_audit_finds_what_is_broken(spark):
    _, edges = graph(spark, SQUARE, SIDES)
    ring = [0, 2, 4, 6]
    walks = [(1, 0, ring), (1, 1, ring), (2, 0, [0, 4, 6]), (3, 0, [0, 2]), (4, 0, [0, 2, 4, 6, 999])]
    walks = spark.createDataFrame([(r, c, 0, k, e) for r, c, es in walks for k, e in enumerate(es)], "request_id long, candidate int, leg int, seq int, edge_id long")
    asked = spark.createDataFrame([(r, 3934.0 if r != 3 else 100.0, 0.5) for r in (1, 2, 3, 4)], "request_id long, distance_m double, tolerance double")
    got = {r["check"]: r.violations for r in routing.audit_loops(walks, edges, asked).collect()}
    assert got == {"unknown": 1, "apart": 1, "open": 1, "tolerance": 1, "alike": 1}


@pytest.mark.parametrize("change, check", [("edge_id <> 3", "reverse"), ("from_node <> 0 or edge_id <> 0", "reverse"), ("short", "length"), ("dear", "cost"), ("lost", "endpoint")])
def test_network_audit_finds_what_is_broken(spark, change, check):
    nodes, edges = graph(spark, SQUARE, SIDES)
    if change == "short":
        edges = edges.withColumn("length_m", F.when(F.col("edge_id") == 2, 900.0).otherwise(F.col("length_m")))
    elif change == "dear":
        edges = edges.withColumn("traffic", F.when(F.col("edge_id") == 2, -90).otherwise(F.col("traffic"))).withColumn("surface", F.lit(3))
    elif change == "lost":
        nodes = nodes.filter("node_id <> 2")
    else:
        edges = edges.filter(change)
    assert {r["check"] for r in network.audit(edges, nodes).collect() if r.violations} == {check}


def test_labels_and_one_loop_with_its_request(spark):
    value = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [value(geo.percent_label(F.lit(x))) for x in (0.0, 0.004, 0.125, 1.0)] == ["0 %", "0,4 %", "13 %", "100 %"]
    assert [value(geo.gap_label(F.lit(a), F.lit(b))) for a, b in ((18000.0, 17900.0), (18000.0, 17422.0), (18499.0, 17501.0), (0.0, 5.0), (float("nan"), 5.0))] == ["", "tu en demandais 18", "tu en demandais 18", "", ""]
    assert [value(geo.whole_km_label(F.lit(x))) for x in (17500.0, float("inf"))] == ["18 km", "— km"]
    loop = spark.createDataFrame([(1, 0, "0.abc", 4000.0, 2000.0, 0.0, 0.0, 4000.0, [(48.1, -1.6)])], "request_id long, candidate int, id string, length_m double, unpaved_m double, traffic_exposure_m double, retraced_m double, distance_m double, coords array<struct<lat double, lon double>>")
    asked = spark.createDataFrame([(1, 48.135, -1.628, 4000.0, 0.15, "", 0.5, 3, 0)], "request_id long, start_lat double, start_lon double, distance_m double, tolerance double, activity string, avoid_paved double, max_results int, variant int")
    text = export.to_loop_json(loop, asked).first().json
    assert '"geometry":[[-1.6,48.1]]' in text and '"request":{"start":{"lat":48.135,"lon":-1.628},"distance_m":4000.0,"tolerance":0.15,"activity":"","preferences":{"avoid_paved":0.5},"max_results":3,"variant":0}' in text and "OpenStreetMap" in text


def test_bearings_are_the_requests_own(spark):
    one = spark.createDataFrame([(1, 48.1, -1.6, 4000.0, 0.1, 0.5, 5, 0), (2, 48.1, -1.6, 4000.0, 0.1, 0.5, 5, 1)], "request_id long, start_lat double, start_lon double, distance_m double, tolerance double, avoid_paved double, max_results int, variant int")
    got = {(r.request_id, r.candidate): r.bearing for r in routing.start_bearings(one).collect()}
    even = 6.283185307179586 / 20
    assert all(0 <= b - c * even < 0.3 for (_, c), b in got.items()) and len(got) == 40
    assert got == {(r.request_id, r.candidate): r.bearing for r in routing.start_bearings(one.repartition(3)).collect()} and got[1, 3] != got[2, 3]
    assert requests.validated(one.withColumn("activity", F.lit(""))).filter("error is null").count() == 2


def test_zones_find_what_a_search_without_them_finds(spark, monkeypatch):
    """Zones of few trips, one across a tile's edge and one near a pole, against the search without zones; the arcs of a zone are those in its reach."""
    nodes = {100 * r + c: (base + 0.004 * r, 179.99 + 0.004 * c if base < 80 else 0.01 * c) for base, rows in ((48.0, range(6)), (89.9, range(10, 14))) for r in rows for c in range(6)}
    segments = [(i, j, 700 + (7 * i + 3 * j) % 60, i % 4, j % 200) for i in nodes for j in (i + 1, i + 100) if j in nodes]
    nodes, edges = graph(spark, nodes, segments)
    trips = [(k, a, b, 1.0, 3.0, 5_000.0) for k, (a, b) in enumerate([(0, 303), (303, 1), (505, 0), (1000, 1303), (1304, 1001), (2, 2), (4, 77777)])]
    for name in ("ZONE_TRIPS", "HOPS", "COMPACT"):
        monkeypatch.setattr(routing, name, 1)
    near, path = routing.cheapest_paths(spark.createDataFrame(trips, TRIP), nodes, edges)
    free = trips + [(99, 77777, 77778, 1.0, 3.0, None)]  # a trip without a reach: no zones
    far, other = routing.cheapest_paths(spark.createDataFrame(free, TRIP), nodes, edges)
    assert sorted(map(tuple, near.collect())) == sorted(tuple(r) for r in far.filter("trip_id <> 99").collect())
    assert sorted(map(tuple, path.collect())) == sorted(map(tuple, other.collect()))
    assert {r.status for r in near.filter("trip_id < 5").collect()} == {"ok"}
    ends = spark.createDataFrame([(1, 0, 0.02, 0.02, 300.0)], "trip_id long, from_node long, from_lat double, from_lon double, reach_m double")
    arcs = spark.createDataFrame([(0, 0.02, 0.02), (1, 0.051, 0.02), (2, 0.06, 0.02), (3, 0.02, -0.002), (4, 0.02, 359.999)], "edge_id long, lat double, lon double")
    assert {r.edge_id for r in routing._zone_arcs(routing._zoned(ends), arcs).collect()} == {0, 1, 3, 4}


def test_trips_of_zones_go_without_rounds(spark, monkeypatch):
    """A batch of near trips writes no frontiers, however long its paths; cut into parts, or by rounds where zones have too many arcs, its rows are the same."""
    rng = random.Random(4)
    nodes = {100 * r + c: (48.1 + 0.0018 * r, -1.68 + 0.0027 * c) for r in range(12) for c in range(9)}
    segments = [(i, j, rng.choice([230, 230, 300]), rng.randrange(4), rng.choice([0, 0, 120])) for i in nodes for j in (i + 1, i + 100, i + 1) if j in nodes and rng.random() < 0.8]
    nodes[9999] = (48.105, -1.67)  # a node without edges
    ids = sorted(nodes)
    trips = [(k, rng.choice(ids), rng.choice(ids), rng.choice([0.0, 3.0]), 2.0, rng.choice([400.0, 1500.0, 4000.0])) for k in range(60)] + [(60, 0, 9999, 0.0, 0.0, 900.0), (61, 5, 5, 0.0, 0.0, 900.0)]
    nodes, edges = graph(spark, nodes, segments)
    trips = spark.createDataFrame(trips, TRIP)
    folder = pathlib.Path(shared.shared_dir(spark).removeprefix("file://"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    fronts = lambda: {f.name for f in folder.glob("trip-front-*")}
    before = fronts()
    found, path = routing.cheapest_paths(trips, nodes, edges, max_nodes=30)
    found, path = rows(found), rows(path)
    assert fronts() == before and {r[3] for r in found} == {"ok", "no_path", "budget_exceeded"}
    for name in ("CELLS", "ZONE_ARCS"):
        monkeypatch.setattr(routing, name, 1)
        other, edge = routing.cheapest_paths(trips, nodes, edges, max_nodes=30)
        assert (found, path) == (rows(other), rows(edge))
    assert fronts() > before


def test_leg_totals_shuffle_the_walks_once(spark):
    """First legs come from a window and not from a join of the walks with themselves; keys that are null make no row vanish."""
    _, edges = graph(spark, {0: (0.0, 0.0)}, [(0, 1, 700, 1, 51), (1, 2, 1500, 3, 0)])
    legs = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 1), (1, None, 0, 2), (1, None, 1, 3)], "request_id long, candidate int, leg int, edge_id long")
    out = routing.leg_totals(legs, edges)
    assert {(r.candidate, r.leg, r.retraced_m) for r in out.collect()} == {(0, 0, 0.0), (0, 1, 700.0), (None, 0, 0.0), (None, 1, 1500.0)}


def test_clipped_sizes_count_what_lies_within_reach(spark):
    """Against brute force: at the equator, in the middle, about the pole and across a tile's edge; points and edges that repeat, ends that are null or unknown."""
    rng = random.Random(3)
    middles = [(0.0, 0.0), (48.1, -1.68), (89.2, 10.0), (89.99, -100.0), (-89.995, 0.0), (60.0, 179.5)]
    at = {100 * k + i: (max(-90.0, min(90.3, lat + rng.uniform(-0.02, 0.02))), lon + rng.uniform(-0.03, 0.03) / max(0.001, math.cos(math.radians(lat)))) for k, (lat, lon) in enumerate(middles) for i in range(40)}
    ends = [(a, rng.choice([b for b in at if b // 100 == a // 100])) for a in at for _ in range(3)] + [(0, 777), (None, 0), (1, None)]
    ends += [(b, a) for a, b in ends] + ends[:9]
    points = [(10 * k + i, lat, lon, m) for k, (lat, lon) in enumerate(middles) for i, m in enumerate((300.0, 1500.0, 4000.0))]
    points += [points[1], (90, None, 0.0, 500.0), (91, 48.1, -1.68, None), (92, 48.1, -1.68, float("nan")), (93, 20.0, 20.0, 500.0)]
    want = {}
    for key, lat, lon, m in points[:19]:
        near = {n for n, p in at.items() if metres((lat, lon), p) <= m}
        copies = points.count((key, lat, lon, m))
        if near:
            want[key] = (copies * len(near), copies * copies * sum(a in near and b in near for a, b in ends))
    nodes = spark.createDataFrame([(n, *p) for n, p in at.items()], "node_id long, lat double, lon double")
    edges = spark.createDataFrame(ends, "from_node long, to_node long")
    asked = spark.createDataFrame(points, "id long, lat double, lon double, m double")
    got = {r.id: (r.nodes, r.edges) for r in routing.clipped_sizes(asked, nodes, edges, "id", "lat", "lon", "m").collect()}
    assert got == want and len(want) >= 15
    each = routing.clipped(asked, nodes, "id", "lat", "lon", "m").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in each} == {k: n for k, (n, _) in want.items()}


def test_loop_audit_shuffles_the_walks_by_request_alone(spark):
    """After the edges are looked up a request's loops stay where they are; no table of loops is written between, and null requests are audited too."""
    _, edges = graph(spark, SQUARE, SIDES)
    walks = [(1, 0, [0, 2]), (1, 1, [0, 2]), (1, 2, [0, 4]), (None, 0, [0, 1]), (None, 1, [0, 1]), (None, 2, [0, 1])]
    walks = spark.createDataFrame([(r, c, 0, k, e) for r, c, es in walks for k, e in enumerate(es)], "request_id long, candidate int, leg int, seq int, edge_id long")
    asked = spark.createDataFrame([(1, 10.0, 0.5)], "request_id long, distance_m double, tolerance double")
    out = routing.audit_loops(walks, edges, asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(request_id" in plan and "audited-loops" not in plan
    assert not re.search(r"hashpartitioning\(request_id#\d+L, [a-z]", plan)  # by the request and more
    assert {r["check"]: r.violations for r in out.collect()} == {"unknown": 0, "apart": 1, "open": 3, "tolerance": 3, "alike": 4}
