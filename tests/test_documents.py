import base64
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from trailmill.functions import points
from trailmill.functions.tags import classify_ways, config_hash
from trailmill.operators import export, network
from trailmill.sources import files
from trailmill.streaming import limiter, live

REQUEST = '{"start":{"lat":48.135,"lon":-1.628},"distance_m":4000,"tolerance":0.15,"activity":"","preferences":{"avoid_paved":0.5},"max_results":3,"variant":0}'
FIELDS = "start_lat double, start_lon double, distance_m double, tolerance double, activity string, avoid_paved double, max_results int, variant int"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_points(spark):
    lit = [F.lit(float(x)) for x in (48.0, -2.0, 49.0, -1.0)]
    for lat, lon, want in ((48.0, -1.0, True), (49.1, -1.5, False), (math.nan, -1.5, False), (None, -1.5, False)):
        assert value(spark, points.in_bbox(F.lit(lat).cast("double"), F.lit(lon), *lit)) is want
    assert [value(spark, points.valid_lat(F.lit(x))) for x in (90.0, -90.5, math.nan, math.inf)] == [True, False, False, False]
    assert value(spark, points.same_point(F.lit(1.0), F.lit(1.0), F.lit(1.000001), F.lit(1.0))) and not value(spark, points.same_point(F.lit(math.nan), F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert value(spark, points.point_label(F.lit(48.1173), F.lit(-1.6778))) == "48,1173, -1,6778"
    d, a = points.clamp_settings(F.lit(math.inf), F.lit(1.5))
    assert (value(spark, d), value(spark, a)) == (12_000, 1)
    d, a = points.clamp_settings(F.lit(10.0), F.lit(math.nan))
    assert (value(spark, d), value(spark, a)) == (2_000, 0.7)


@pytest.mark.parametrize(("peer", "forwarded", "want"), [
    ("10.0.0.1:80", "1.1.1.1, 2.2.2.2:99", "2.2.2.2"), ("10.0.0.9:80", "1.1.1.1", "10.0.0.9"), ("10.0.0.1:80", "", "10.0.0.1"), ("10.0.0.1:80", None, "10.0.0.1"), ("[::1]:80", "x", "::1"), ("::1", "x", "::1")])
def test_client_key(spark, peer, forwarded, want):
    assert value(spark, points.client_key(F.lit(peer), F.lit(forwarded).cast("string"), ["10.0.0.1"])) == want


def test_places(spark):
    doc = {"features": [{"geometry": {"coordinates": [-1.6, 48.1]}, "properties": {"name": "Rennes", "type": "municipality", "context": "35, Ille-et-Vilaine, Bretagne", "postcode": "35000"}},
                        {"geometry": {"coordinates": [2, 3]}, "properties": {"name": "Rue", "type": "street", "postcode": "35000", "city": "Rennes", "distance": 7}}]}
    got = value(spark, points.places(F.lit(json.dumps(doc))))
    assert [(p.name, p.complement, p.lat, p.distance_m) for p in got] == [("Rennes", "Commune, Ille-et-Vilaine", 48.1, None), ("Rue", "35000 Rennes", 3.0, 7.0)]
    assert value(spark, points.places(F.lit("{}"))) == [] and value(spark, points.places(F.lit(None).cast("string"))) == []


def test_ids(spark):
    r = spark.createDataFrame([(48.135, -1.628, 4000.0, 0.15, "", 0.5, 3, 0)], FIELDS)
    want = "2." + base64.urlsafe_b64encode(REQUEST.encode()).decode().rstrip("=")
    assert r.select(export.loop_id(export.request_json(r), F.lit(2)).alias("id")).first().id == want
    ids = spark.createDataFrame([(want,), ("nothing",), ("x." + want,), ("1.a",), ("1.bm8",), (None,)], "id string")
    rows = export.decoded_ids(ids).collect()
    assert (rows[0]["index"], rows[0].distance_m, rows[0].max_results, rows[0].error) == (2, 4000.0, 3, None)
    assert all(x.error for x in rows[1:])
    assert [value(spark, export.number_text(F.lit(x))) for x in (4000.0, 0.0005, -1.628, 0.0)] == ["4000", "0.0005", "-1.628", "0"]


def test_documents(spark):
    legs = spark.createDataFrame([(1, 0, 1, [2, 3, 1]), (1, 0, 0, [1, 5, 2]), (2, 0, 0, [])], "request_id long, candidate int, leg int, nodes array<long>")
    assert {x.request_id: x.nodes for x in export.stitched(legs).collect()} == {1: [1, 5, 2, 3, 1], 2: []}
    loops = spark.createDataFrame([(1, 0, 1, "0.a", 1500.0, 750.0, 0.0, 0.0, 2000.0, [(48.1, -1.6), (48.2, -1.7)]), (2, 0, 1, "0.b", 0.0, 0.0, 0.0, 0.0, 0.0, [])],
                                  "request_id long, candidate int, rank int, id string, length_m double, unpaved_m double, traffic_exposure_m double, retraced_m double, distance_m double, coords array<struct<lat:double,lon:double>>")
    gpx = export.to_gpx(loops).collect()
    assert len(gpx) == 1 and gpx[0].filename == "trailmill-2000m.gpx" and '<trkpt lat="48.1000000" lon="-1.6000000"></trkpt>' in gpx[0].gpx and "1500 m" in gpx[0].gpx
    docs = {x.request_id: json.loads(x.json) for x in export.to_loops_json(loops).collect()}
    assert docs[1]["loops"][0]["geometry"] == [[-1.6, 48.1], [-1.7, 48.2]] and docs[1]["loops"][0]["score"]["ecart_cible"] == -0.25 and docs[2]["attribution"]


def test_files(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="48.1" lon="-1.6"/><node id="2" lat="48.2" lon="-1.6"/><way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/></way></osm>')
    nodes, ways = files.read_osm_xml(spark, f"file://{tmp_path}/a.osm")
    assert nodes.count() == 2 and ways.first().nodes == [1, 2] and ways.first().highway == "path" and ways.first().access is None
    assert files.fingerprints(spark, f"file://{tmp_path}/a.osm", "osm").first().size_bytes == (tmp_path / "a.osm").stat().st_size


def test_tags(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="48.1" lon="-1.6"/><node id="2" lat="48.2" lon="-1.6"/><way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/><tag k="name" v="Rue"/>'
                                    '<tag k="name" v="Chemin"/></way><way id="8"><nd ref="2"/></way></osm>')
    nodes, ways = files.read_tagged_xml(spark, f"file://{tmp_path}/a.osm")
    files.write_osm_tables(nodes, ways, f"file://{tmp_path}/tables")
    again, stored = files.read_osm_tables(spark, f"file://{tmp_path}/tables", "name")
    assert {(r.way_id, r.highway, r.surface, r.name) for r in stored.collect()} == {(7, "path", None, "Rue"), (8, None, None, None)}
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nodes.collect()))
    direct = classify_ways(files.read_osm_xml(spark, f"file://{tmp_path}/a.osm")[1])
    assert classify_ways(stored).collect() == direct.collect() and direct.count() == 1


def lattice(spark, rows=6, columns=6):
    nodes = spark.range(rows * columns).selectExpr("id as node_id", f"48.0 + (id div {columns}) * 0.4D as lat", f"-2.0 + (id % {columns}) * 0.4D as lon", f"cast(id % {columns} as int) as cell_x", f"cast(id div {columns} as int) as cell_y")
    pairs = [(i, i + s) for i in range(rows * columns) for s in (1, columns) if (s == columns or i % columns < columns - 1) and i + s < rows * columns]
    edges = spark.createDataFrame([(2 * k + d, *(p if d == 0 else p[::-1]), 10.0) for k, p in enumerate(pairs) for d in (0, 1)], "edge_id long, from_node long, to_node long, length_m double")
    return nodes, edges


def test_written_network(spark, tmp_path):
    nodes, edges = lattice(spark)
    sources = spark.createDataFrame([("osm", "a.osm", "ab", 12)], files.PROVENANCE)
    folder = f"file://{tmp_path}/net"
    files.write_network(nodes, edges, folder, sources, tile_deg=0.5, built_at="2024-05-01T00:00:00Z")
    back = files.read_network(spark, folder)
    assert [sorted(map(tuple, x.select(*y.columns).collect())) for x, y in zip(back, (nodes, edges), strict=True)] == [sorted(map(tuple, y.collect())) for y in (nodes, edges)]
    assert [set(x.columns) for x in back] == [set(nodes.columns), set(edges.columns)]

    box = (48.3, -1.7, 49.0, -1.1)
    inside = {r.node_id for r in nodes.collect() if box[0] <= r.lat <= box[2] and box[1] <= r.lon <= box[3]}
    near, leaving = files.read_network(spark, folder, box)
    assert {r.node_id for r in near.collect()} == inside and {r.edge_id for r in leaving.collect()} == {r.edge_id for r in edges.collect() if r.from_node in inside}
    for part, whole in zip((near, leaving), back, strict=True):
        read = {r.f for r in part.select(F.input_file_name().alias("f")).collect()}
        every = {r.f for r in whole.select(F.input_file_name().alias("f")).collect()}
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert read < every and "PartitionFilters: [isnotnull(tile_y" in plan and "numFiles" not in plan
        tiles = {tuple(int(x.split("=")[1]) for x in f.split("/") if x.startswith("tile_")) for f in read}
        assert all(96 <= y <= 98 and -4 <= x <= -3 for y, x in tiles)

    doc = json.loads(files.network_regions(spark, folder).first().json)
    assert doc["bbox"] == {"min_lat": 48.0, "min_lon": -2.0, "max_lat": 50.0, "max_lon": 0.0} and doc["data"]["sources"] == [{"name": "osm", "file": "a.osm", "sha256": "ab", "size_bytes": 12}]
    assert doc["data"]["built_at"] == "2024-05-01T00:00:00Z" and doc["data"]["config_hash"] == config_hash() and "OpenStreetMap" in doc["attribution"]
    assert json.loads(export.regions(nodes, sources, "2024-05-01T00:00:00Z").first().json) == doc
    assert set(json.loads(export.regions(nodes.limit(0), sources).first().json)["bbox"].values()) == {0.0}
    m = files.read_manifest(spark, folder).first()
    assert (m.nodes, m.segments, m.directed_edges, m.tile_deg) == (36, 60, 120, 0.5)


def test_networks_that_are_refused(spark, tmp_path):
    nodes, edges = lattice(spark)
    with pytest.raises(ValueError, match="no segments"):
        files.write_network(nodes, edges.limit(0), f"file://{tmp_path}/none")
    with pytest.raises(Exception, match="(?i)path.*exist"):  # no manifest, no network
        files.read_network(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="start from no node"):
        files.write_network(nodes.filter("node_id > 0"), edges, f"file://{tmp_path}/astray")
    files.write_network(nodes, edges, f"file://{tmp_path}/net")
    later = files.read_manifest(spark, f"file://{tmp_path}/net").withColumn("format_version", F.lit(files.FORMAT_VERSION + 1)).collect()
    spark.createDataFrame(later, files.MANIFEST).write.mode("overwrite").parquet(f"file://{tmp_path}/net/manifest")
    with pytest.raises(ValueError, match="format"):
        files.read_network(spark, f"file://{tmp_path}/net")


def test_stats_of_a_network_without_segments(spark):
    nodes = spark.createDataFrame([(1, 48.0, -1.0), (2, 48.0, -1.1)], "node_id long, lat double, lon double")
    ways = lambda refs: spark.createDataFrame([(1, refs, "path", None, None)], "way_id long, nodes array<long>, highway string, surface string, access string")
    assert network.build_stats(nodes, ways([1, 2])).first().asDict() == {"ways": 1, "nodes": 2, "min_lat": 48.0, "min_lon": -1.1, "max_lat": 48.0, "max_lon": -1.0, "segments": 1, "directed_edges": 2}
    with pytest.raises(Exception, match="no segments"):
        network.build_stats(nodes, ways([1, 9])).collect()


def test_fingerprints_of_large_files(spark, tmp_path, monkeypatch):
    bodies = {"small": b"abc", "large one": bytes(range(256)) * 5000, "edge": b"x" * 1000}
    for k, v in bodies.items():
        (tmp_path / k).write_bytes(v)
    monkeypatch.setattr(files, "MAX_FINGERPRINT_BYTES", 1000)
    got = {(r.file, r.sha256, r.size_bytes) for r in files.fingerprints(spark, f"file://{tmp_path}", "f").collect()}
    assert got == {(k, hashlib.sha256(v).hexdigest(), len(v)) for k, v in bodies.items()}


def test_streams_agree_with_batch(spark, tmp_path):
    log = spark.createDataFrame([(i, f"c{i % 3}", "view" if i % 10 == 0 else "buy", float(i), i % 4 == 0, i * 100_000) for i in range(120)],
                                "event_id long, client string, path string, duration_ms double, is_error boolean, t_us long")
    log.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = lambda: spark.readStream.schema(log.schema).parquet(f"file://{tmp_path}/in")
    for name, df, mode, want in (("verdicts", live.admitted_stream(stream()), "append", limiter.admitted(log)), ("counts", live.counters_stream(stream()), "complete", limiter.counters(log))):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect()))
