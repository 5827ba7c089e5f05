import math
import random

import pytest
from pyspark.sql import functions as F

from trailmill.functions import geo
from trailmill.functions.tags import classify_ways, config_hash
from trailmill.operators import network, ranking, requests, snap
from trailmill.operators import components
from trailmill.operators.components import connected_components
from trailmill.sources import derived
from trailmill.streaming.limiter import _bucket


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    d = value(spark, geo.haversine(F.lit(48.1173), F.lit(-1.6778), F.lit(48.6493), F.lit(-2.0257)))
    assert d == pytest.approx(64493.99251737792, abs=1e-6)
    for x, want in ((math.nan, 0), (math.inf, 1), (-math.inf, 0), (0.3, 0.3)):
        assert value(spark, geo.clamp01(F.lit(x))) == want
    assert [value(spark, geo.distance_label(F.lit(float(m)))) for m in (850, 1000, 17400)] == ["850 m", "1,0 km", "17,4 km"]
    assert [value(spark, geo.duration_label(F.lit(float(m)))) for m in (59, 60, 125)] == ["59 min", "1 h 00", "2 h 05"]
    assert value(spark, geo.xml_escape(F.lit("a<b>&"))) == "a&lt;b&gt;&amp;"
    assert config_hash() == "34b4ff929e2a28fb"


def test_square(spark):
    nodes = spark.createDataFrame([(0, 48.100, -1.680), (1, 48.100, -1.667), (2, 48.109, -1.667), (3, 48.109, -1.680)], "node_id long, lat double, lon double")
    ways = spark.createDataFrame([(1, [0, 1, 2, 3, 0, 9], "path", None, None), (2, [0, 2], "motorway", None, None), (3, [1, 3], "path", None, "private")],
                                 "way_id long, nodes array<long>, highway string, surface string, access string")
    placed, edges = network.build_network(nodes, ways)
    lengths = sorted({round(r.length_m, 6) for r in edges.collect()})
    assert edges.count() == 8 and lengths[0] == pytest.approx(965.20703, abs=1e-4)
    assert {r.node_id for r in placed.filter("is_main").collect()} == {0, 1, 2, 3}
    assert {r.violations for r in network.audit(edges, nodes).collect()} == {0}
    points = spark.createDataFrame([(1, 48.1089, -1.6671), (2, 43.30, 5.37), (3, math.nan, 0.0)], "k long, lat double, lon double")
    got = {r.k: (r.node_id, r.status) for r in snap.snap(points, placed, "k", "lat", "lon").collect()}
    assert got == {1: (2, "ok"), 2: (None, "start_out_of_range"), 3: (None, "start_out_of_range")}


def test_missing_node_is_not_bridged(spark):
    nodes = spark.createDataFrame([(1, 48.0, -1.0), (3, 48.0, -1.1)], "node_id long, lat double, lon double")
    ways = spark.createDataFrame([(1, [1, 2, 3], "path", "tartan", None)], "way_id long, nodes array<long>, highway string, surface string, access string")
    kept = classify_ways(ways)
    assert kept.first().surface == 3 and network.build_edges(nodes, kept).count() == 0


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_components_of_a_long_chain_and_a_hub(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)  # rounds of joins where more is left than one block holds
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(200)} == {1000} and got[5000] == 5000


def test_ranking_and_distinct_loops(spark):
    rows = [(1, 0, 10500.0, 0.2), (1, 1, 13000.0, 0.9), (1, 2, 10800.0, 0.9), (1, 3, 11000.0, 0.5)]
    loops = spark.createDataFrame([(r, c, m, u * m, 0.0, 0.0, [c, 9, 10]) for r, c, m, u in rows], "request_id long, candidate int, length_m double, unpaved_m double, traffic_exposure_m double, retraced_m double, edge_set array<int>")
    assert [r.candidate for r in ranking.ranked(loops).orderBy("rank").collect()] == [2, 3, 0, 1]
    same = loops.withColumn("edge_set", F.array(F.lit(1), F.lit(2)))
    assert [r.candidate for r in ranking.distinct_loops(same).collect()] == [0]


def test_each_request_has_as_many_loops_as_it_asks_for(spark):
    loops = spark.createDataFrame([(r + far, r, c, 1000.0 + c, 0.0, 0.0, 0.0) for r in range(1, 6) for far in (0, 1 << 40) for c in range(8)],
                                  "request_id long, asked long, candidate int, length_m double, unpaved_m double, traffic_exposure_m double, retraced_m double")
    rows = [(1, 1000.0, 0.1, 1), (2, 1000.0, 0.1, 6), (3, 1007.0, 0.001, None), (4, 1000.0, 0.1, 11), (5, 1000.0, 0.1, 0)]
    asked = spark.createDataFrame([(i, 48.0, 0.0, d, t, "", 0.0, n) for i, d, t, n in rows], "request_id long, start_lat double, start_lon double, distance_m double, tolerance double, activity string, avoid_paved double, max_results int")
    got = ranking.ranked_for(loops, requests.with_defaults(requests.validated(asked))).orderBy("rank").collect()
    by = {k: [r.candidate for r in got if r.request_id == k] for k in {r.request_id for r in got}}
    want = {1: [0], 2: [0, 1, 2, 3, 4, 5], 3: [6, 7, 5, 4, 3], 5: [0, 1, 2, 3, 4]}
    assert by == want | {k + (1 << 40): v for k, v in want.items()}


def test_used_segments_cost_more_in_either_direction(spark):
    costs = spark.createDataFrame([(i, 10.0) for i in range(8)], "edge_id long, cost double")
    used = spark.createDataFrame([(1,), (1,), (4,), (None,)], "edge_id long")
    by = lambda f: {r.edge_id: r.cost for r in network.reused_costs(costs, used, f).collect()}
    assert by(4.0) == {i: 40.0 if i in (0, 1, 4, 5) else 10.0 for i in range(8)} and set(by(0.5).values()) == {10.0} and len(by(4.0)) == 8


@pytest.mark.parametrize("row", [792, 800, 8000, 99_992, 100_000, 100_008, 120_000])
def test_columns_of_a_long_lattice_are_whole(spark, tmp_path, row):
    first, last = row - 8, row + 8  # rows of all 40 columns around the end of a piece
    part = spark.range(first * 40, last * 40 + 40).selectExpr("id as p_partkey", "1 as p_size", "'Brand#11' as p_brand", "'ECONOMY' as p_type")
    part.unionAll(part.selectExpr("p_partkey % 640 + 40", "1", "'Brand#11'", "'ECONOMY'").distinct()).write.parquet(f"file://{tmp_path}/part.parquet")
    ways = derived.osm_ways(spark, f"file://{tmp_path}").filter("way_id < 5000000 or way_id >= 1000000000000")
    own = ways.select("way_id", F.explode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("f"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("t"))).alias("p")).select("p.*").distinct()
    down = own.filter(f"t - f = 40 and f >= {first * 40}").count()
    assert down == (last - first) * 40 and own.filter(f"t - f = 1 and f >= {first * 40}").count() == (last - first + 1) * 39
    assert own.filter("abs(t - f) > 40 and greatest(f, t) < 10000000").count() == 0 and ways.count() == ways.select("way_id").distinct().count()


def test_every_order_of_a_customer_is_a_candidate(spark, tmp_path):
    spark.range(1, 46).selectExpr("id as o_orderkey", "if(id = 45, 2, 1) as o_custkey").write.parquet(f"file://{tmp_path}/orders.parquet")
    spark.range(1, 91).selectExpr("(id + 1) div 2 as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id % 2 + 1 as int) as l_linenumber", "1.0D as l_quantity").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    spark.range(1, 91).selectExpr("id as p_partkey", "1 as p_size").write.parquet(f"file://{tmp_path}/part.parquet")
    first, second, third = 1, 1 + derived.NEXT_REQUEST, 1 + 2 * derived.NEXT_REQUEST
    for table, lines in ((derived.loop_edges, 2), (derived.loop_points, 2), (derived.loop_legs, 1)):
        got = {(r.request_id, r.candidate): r["count"] for r in table(spark, f"file://{tmp_path}").groupBy("request_id", "candidate").count().collect()}
        assert got == {k: lines for k in [(r, c) for r in (first, second) for c in range(20)] + [(third, c) for c in range(4)] + [(2, 0)]}


def test_requests(spark):
    rows = [(1, 48.0, 0.0, 5000.0, math.nan, "", 3), (2, 91.0, 0.0, 5000.0, 0.1, "", 3), (3, 48.0, 0.0, 5000.0, None, "trail", -1), (4, 48.0, 0.0, 499.0, 0.1, "", 3)]
    df = spark.createDataFrame(rows, "request_id long, start_lat double, start_lon double, distance_m double, tolerance double, activity string, max_results int")
    assert [r.error for r in requests.validated(df).orderBy("request_id").collect()] == ["tolerance not finite", "latitude out of range", None, "distance too short"]


def test_bucket():
    assert _bucket(5.0, None, [0] * 6)[0] == [True] * 5 + [False]
    assert _bucket(5.0, None, [0] * 6 + [1_000_000, 1_000_001])[0][-2:] == [True, False]


def test_candidates_of_a_request_are_compared_in_its_row(spark):
    """No join of candidates by edges, whose sorts grew with the table; sets without a shared edge, empty ones and nulls are in no pair."""
    from trailmill.operators import ranking

    rows = [(1, 2, [1, 2, 3]), (1, 0, [2, 3, 4]), (1, 5, [9]), (1, 7, []), (1, 8, None), (2, 0, [1, 2, 3])]
    out = ranking.similarity(spark.createDataFrame(rows, "request_id long, candidate int, edge_set array<long>"))
    assert [tuple(r) for r in out.collect()] == [(1, 0, 2, 2, 0.5)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [64, 300])
def test_components_of_a_map_need_no_rounds(spark, monkeypatch, block):
    """Where ids follow the map, pieces of ranges of ids are linked and no round of joins is run; shuffled ids may need rounds and give the same components."""
    from trailmill.operators import components

    rows, wide = 60, 20
    at = lambda r, c: r * wide + c
    edges = [(at(r, c), at(r, c + 1)) for r in range(rows) for c in range(wide - 1) if r % 7] + [(at(r, c), at(r + 1, c)) for r in range(rows - 1) for c in range(wide) if r % 20 != 19 and c % 3]
    rng = random.Random(block)
    ids = rng.sample(range(10**12), rows * wide)
    mixed = [(ids[a], ids[b]) for a, b in rng.sample(edges, len(edges))]

    def plain(pairs):
        label = {n: n for p in pairs for n in p}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        return label

    monkeypatch.setattr(components, "BLOCK", block)
    find = lambda pairs: {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert find(mixed) == plain(mixed)
    monkeypatch.setattr(components, "_settled", lambda *_: pytest.fail("rounds of joins"))
    got = find(edges)
    assert got == plain(edges) and len(set(got.values())) == 3
