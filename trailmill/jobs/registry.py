"""Queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions import geo, points
from trailmill.functions.shared import scratch_path, written
from trailmill.functions.tags import CLASS_NAMES, DEFAULT_SURFACES, SURFACES, WAY_CLASSES, classify_ways, config_hash
from trailmill.operators import export, network, ranking, requests, routing, snap
from trailmill.sources import derived, files
from trailmill.streaming import limiter


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return classify_ways(derived.osm_ways(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return network.build_edges(derived.osm_nodes(spark, d), _kept(spark, d))


def network_by_class(spark: SparkSession, d: str) -> DataFrame:
    return network.by_class(_edges(spark, d))


def classified_ways(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).select("way_id", F.size("nodes").cast("long").alias("n_refs"), F.col("way_class").cast("int").alias("way_class"), F.col("surface").cast("int").alias("surface"), F.col("traffic").cast("int").alias("traffic"))


def directed_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("edge_id", "from_node", "to_node", F.round("length_m", 3).alias("length_m"), F.col("edge_id").bitwiseXOR(1).alias("reverse_edge_id"))


def _referenced(spark: SparkSession, d: str) -> DataFrame:
    return derived.osm_nodes(spark, d).join(_kept(spark, d).select(F.explode("nodes").alias("node_id")).distinct(), "node_id", "left_semi")


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return network.degrees(_edges(spark, d), _referenced(spark, d))


def network_stats(spark: SparkSession, d: str) -> DataFrame:
    return network.build_stats(derived.osm_nodes(spark, d), derived.osm_ways(spark, d))


def _stored(spark: SparkSession, d: str) -> str:
    """The network of the tables, written with provenance."""
    folder = scratch_path(spark, "network")
    osm, kept, edges = _built(spark, d)
    files.write_network(written(network.network_nodes(osm, kept, edges), "net-nodes"), edges, folder, files.fingerprints(spark, f"{d}/part.parquet", "part"), tile_deg=0.05)
    return folder


def stored_area(spark: SparkSession, d: str) -> DataFrame:
    """Nodes in a box of the written network, and how many edges start at each."""
    nodes, edges = files.read_network(spark, _stored(spark, d), (48.12, -1.66, 48.20, -1.60))
    out = edges.groupBy(F.col("from_node").alias("node_id")).agg(F.count("*").alias("edges"), F.round(F.sum("length_m"), 3).alias("length_m"))
    return nodes.select("node_id", "component_id").join(out, "node_id", "left").select("node_id", "component_id", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), F.coalesce("length_m", F.lit(0.0)).alias("length_m"))


def coverage_document(spark: SparkSession, d: str) -> DataFrame:
    """The coverage document of the written network, read back."""
    box = ", ".join(f"{c}:double" for c in files.BOX)
    doc = F.from_json("json", f"struct<bbox:struct<{box}>,data:struct<config_hash:string,sources:array<struct<name:string,size_bytes:long>>>,attribution:string>")
    read = files.network_regions(spark, _stored(spark, d)).select(doc.alias("j"))
    return read.select(*[F.round(F.col("j.bbox")[c], 6).alias(c) for c in files.BOX], "j.data.config_hash", F.size("j.data.sources").cast("long").alias("sources"), "j.attribution")


def surface_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).groupBy(F.col("way_class").cast("int").alias("way_class")).agg(F.count("*").alias("ways"), F.count_if(~F.col("tagged")).alias("untagged"))


def _built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, kept ways, edges) of the tables, the last two written."""
    osm, ways = derived.osm_nodes(spark, d), derived.osm_ways(spark, d)
    kept = written(classify_ways(ways), "kept-ways")
    return osm, kept, written(network.build_edges(osm, kept), "edges")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return network.network_nodes(*_built(spark, d))


def node_components(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("node_id", "component_id", "is_main")


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return network.placed_nodes(*_built(spark, d)).groupBy("component_id").agg(F.count("*").alias("nodes"))


def snapped_starts(spark: SparkSession, d: str) -> DataFrame:
    good = requests.validated(derived.loop_requests(spark, d)).filter("error is null")
    out = snap.snap(good, written(_nodes(spark, d), "net-nodes"), "request_id", "start_lat", "start_lon")
    return out.select("request_id", "node_id", F.round("distance_m", 3).alias("distance_m"), "status")


def network_audit(spark: SparkSession, d: str) -> DataFrame:
    return network.audit(_edges(spark, d), derived.osm_nodes(spark, d))


def request_errors(spark: SparkSession, d: str) -> DataFrame:
    return requests.validated(derived.loop_requests(spark, d)).select("request_id", F.coalesce("error", F.lit("")).alias("error"))


def request_weights(spark: SparkSession, d: str) -> DataFrame:
    r = requests.with_defaults(requests.validated(derived.loop_requests(spark, d)).filter("error is null"))
    return r.select("request_id", F.round("tolerance", 3).alias("tolerance"), F.col("max_results").cast("int").alias("max_results"), F.round("w_paved", 6).alias("w_paved"), F.round("w_traffic", 6).alias("w_traffic"))


def edge_costs(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    out = [F.round(geo.edge_cost(F.col("length_m"), F.col("surface"), F.col("traffic"), *geo.weights(F.lit(a))), 2).alias(n) for n, a in (("cost_neutral", 0.0), ("cost_avoid", 0.8))]
    return e.select("edge_id", *out)


def reused_edge_costs(spark: SparkSession, d: str) -> DataFrame:
    """Neutral costs where a loop has used each third segment in the direction of its odd edge."""
    e = _edges(spark, d)
    costs = e.select("edge_id", geo.edge_cost(F.col("length_m"), F.col("surface"), F.col("traffic"), *geo.weights(F.lit(0.0))).alias("cost"))
    return network.reused_costs(costs, e.filter("edge_id % 6 = 1")).select("edge_id", F.round("cost", 2).alias("cost"))


def loop_totals(spark: SparkSession, d: str) -> DataFrame:
    return ranking.totals(derived.loop_edges(spark, d)).select("request_id", "candidate", *[F.round(c, 3).alias(c) for c in ranking.FIGURES], F.size("edge_set").cast("long").alias("n_edges"))


def similar_loops(spark: SparkSession, d: str) -> DataFrame:
    return ranking.similarity(ranking.totals(derived.loop_edges(spark, d))).select("request_id", "a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


def distinct_loops(spark: SparkSession, d: str) -> DataFrame:
    return ranking.distinct_loops(ranking.totals(derived.loop_edges(spark, d))).select("request_id", "candidate")


def ranked_loops(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.ranked(ranking.totals(derived.loop_edges(spark, d)))
    return out.select("request_id", "candidate", "rank", *[F.round(c, 6).alias(c) for c in ("distance_m", "part_non_bitume", "part_trafic", "part_retracee", "ecart_cible")])


def requested_loops(spark: SparkSession, d: str) -> DataFrame:
    """The best loops of each valid request, as many as it asks for; further requests of a customer ask for the same."""
    asked = requests.with_defaults(requests.validated(derived.loop_requests(spark, d)))
    loops = ranking.totals(derived.loop_edges(spark, d)).withColumn("asked", F.col("request_id") % derived.NEXT_REQUEST)
    return ranking.ranked_for(loops, asked).select("request_id", "candidate", "rank", F.round("ecart_cible", 6).alias("ecart_cible"))


def request_counters(spark: SparkSession, d: str) -> DataFrame:
    return limiter.counters(derived.request_log(spark, d))


def admitted_requests(spark: SparkSession, d: str) -> DataFrame:
    return limiter.admitted(derived.request_log(spark, d))


def loop_labels(spark: SparkSession, d: str) -> DataFrame:
    t = ranking.totals(derived.loop_edges(spark, d))
    return t.select("request_id", "candidate", geo.distance_label(F.col("length_m")).alias("distance"), geo.duration_label(geo.duration_min(F.col("length_m"), F.lit(9.0))).alias("duration"))


def requests_in_area(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = F.col("start_lat"), F.col("start_lon")
    area = [F.lit(x) for x in (48.10, -1.68, 48.20, -1.60)]
    return derived.loop_requests(spark, d).select("request_id", points.valid_coord(lat, lon).alias("valid"), points.in_bbox(lat, lon, *area).alias("inside"),
                                                  points.same_point(lat, lon, F.lit(48.10), F.lit(-1.68)).alias("at_origin"), points.point_label(lat, lon).alias("label"))


def clamped_settings(spark: SparkSession, d: str) -> DataFrame:
    r = derived.loop_requests(spark, d)
    distance, avoid = points.clamp_settings(r["distance_m"], r["avoid_paved"] + (r["tolerance"] - r["tolerance"]))  # NaN where the tolerance is
    return r.select("request_id", distance.alias("distance_m"), F.round(avoid, 6).alias("avoid_paved"))


def client_keys(spark: SparkSession, d: str) -> DataFrame:
    return derived.connections(spark, d).select("event_id", points.client_key(F.col("peer"), F.col("forwarded"), ["10.0.0.1", "10.0.0.2"]).alias("client"))


def loop_bounds(spark: SparkSession, d: str) -> DataFrame:
    return export.bounds(derived.loop_points(spark, d), "request_id").select("request_id", *[F.round(f"{k}_{c}", 6).alias(f"{k}_{c}") for k in ("min", "max") for c in ("lat", "lon")])


def stitched_loops(spark: SparkSession, d: str) -> DataFrame:
    return export.stitched(derived.loop_legs(spark, d)).select("request_id", "candidate", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


def displayed_loops(spark: SparkSession, d: str) -> DataFrame:
    return export.displayed(ranked_loops(spark, d)).select("request_id", "candidate", "place")


def decoded_requests(spark: SparkSession, d: str) -> DataFrame:
    r = requests.validated(derived.loop_requests(spark, d)).filter("error is null")
    ids = r.select("request_id", export.loop_id(export.request_json(r), F.col("variant")).alias("id"))
    return export.decoded_ids(ids).select("request_id", "index", F.round("start_lat", 6).alias("start_lat"), "distance_m", "avoid_paved", "max_results", F.coalesce("error", F.lit("")).alias("error"))


def shared_loops(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.concat_ws(".", F.col("c_custkey") % 7, "c_custkey").alias("id"), F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % 7).cast("int").alias("index"))
    return export.shared_loops(ids, ranked_loops(spark, d)).select("id", F.coalesce("candidate", F.lit(-1)).cast("int").alias("candidate"), "status")


def loop_gpx(spark: SparkSession, d: str) -> DataFrame:
    at = derived.loop_points(spark, d).groupBy("request_id", "candidate").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("coords"))  # lines of one order
    return export.to_gpx(ranking.totals(derived.loop_edges(spark, d)).join(at, ["request_id", "candidate"]).withColumn("distance_m", F.lit(10_000.0)))


def _documented(spark: SparkSession, d: str) -> DataFrame:
    """Ranked loops with the id and the places that documents show."""
    at = derived.loop_points(spark, d).groupBy("request_id", "candidate").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("coords"))  # lines of one order
    t = ranking.totals(derived.loop_edges(spark, d)).drop("edge_set").withColumn("distance_m", F.lit(10_000.0))
    best = ranking.ranked(t).select("request_id", "candidate", "rank")
    return best.join(t, ["request_id", "candidate"]).join(at, ["request_id", "candidate"], "left").withColumn("id", F.concat_ws(".", F.col("rank") - 1, "request_id"))


_LOOP_JSON = "struct<id:string,score:struct<distance_m:double,part_non_bitume:double,ecart_cible:double>,geometry:array<array<double>>>"


def _read_loop(loop: str) -> list:
    return [F.col(f"{loop}.id").alias("id"), *[F.round(f"{loop}.score.{c}", 6).alias(c) for c in ("distance_m", "part_non_bitume", "ecart_cible")], F.size(f"{loop}.geometry").cast("long").alias("points")]


def loops_documents(spark: SparkSession, d: str) -> DataFrame:
    """The loops of each request's document, read back in their order."""
    docs = export.to_loops_json(_documented(spark, d)).select("request_id", F.from_json("json", f"struct<loops:array<{_LOOP_JSON}>,attribution:string>").alias("j"))
    each = docs.select("request_id", "j.attribution", F.posexplode("j.loops").alias("place", "loop"))
    return each.select("request_id", "place", *_read_loop("loop"), "attribution")


def loop_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document for each loop of a valid request, read back with the request it answers."""
    asked = requests.validated(derived.loop_requests(spark, d)).filter("error is null")
    docs = export.to_loop_json(_documented(spark, d), asked)
    j = F.from_json("json", f"struct<loop:{_LOOP_JSON},request:struct<start:struct<lat:double>,distance_m:double,preferences:struct<avoid_paved:double>>>")
    read = docs.select("request_id", "candidate", j.alias("j"))
    return read.select("request_id", "candidate", *_read_loop("j.loop"), F.round("j.request.start.lat", 6).alias("start_lat"), F.col("j.request.distance_m").alias("asked_m"), F.col("j.request.preferences.avoid_paved").alias("avoid_paved"))


def source_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return files.fingerprints(spark, f"{d}/part.parquet", "part").unionAll(files.fingerprints(spark, f"{d}/customer.parquet", "customer"))


def _walks(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    """(request_id, candidate, leg, seq, edge_id): each line of an order goes along the first edge of its part's node and back."""
    first = edges.groupBy(F.col("from_node").alias("node_id")).agg(F.min("edge_id").alias("edge_id"))
    lines = derived.loop_lines(spark, d).join(first, "node_id")
    return lines.select("request_id", "candidate", "leg", F.posexplode(F.array("edge_id", F.col("edge_id").bitwiseXOR(1))).alias("seq", "edge_id"))


def leg_totals(spark: SparkSession, d: str) -> DataFrame:
    edges = written(_edges(spark, d), "edges")
    out = routing.leg_totals(_walks(spark, d, edges), edges)
    return out.select("request_id", "candidate", "leg", *[F.round(c, 3).alias(c) for c in ranking.FIGURES], "n_edges")


def loop_audit(spark: SparkSession, d: str) -> DataFrame:
    edges = written(_edges(spark, d), "edges")
    asked = derived.loop_ids(spark, d).select("request_id").distinct().select("request_id", F.lit(2000.0).alias("distance_m"), F.lit(0.25).alias("tolerance"))
    return routing.audit_loops(_walks(spark, d, edges), edges, asked)


def loop_waypoints(spark: SparkSession, d: str) -> DataFrame:
    """Where the first try of each valid request's candidates would turn, around the point asked for."""
    r = routing.start_bearings(requests.with_defaults(requests.validated(derived.loop_requests(spark, d)).filter("error is null")))
    turns = [routing.waypoint(F.col("start_lat"), F.col("start_lon"), F.col("bearing"), F.col("distance_m"), F.lit(routing.DETOUR), k) for k in range(routing.WAYPOINTS)]
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), lat.alias("lat"), lon.alias("lon")) for k, (lat, lon) in enumerate(turns)]))
    return r.select("request_id", "candidate", "bearing", each).select("request_id", "candidate", "k", *[F.round(c, 6).alias(c) for c in ("bearing", "lat", "lon")])


def clipped_network(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within half the distance of each valid request, which no loop can leave, and edges between them."""
    good = requests.validated(derived.loop_requests(spark, d)).filter("error is null").withColumn("reach_m", F.col("distance_m") / 2)
    osm, kept = derived.osm_nodes(spark, d), written(_kept(spark, d), "kept-ways")
    nodes = osm.join(kept.select(F.explode("nodes").alias("node_id")).distinct(), "node_id", "left_semi")
    return routing.clipped_sizes(good, nodes, network.build_edges(osm, kept), "request_id", "start_lat", "start_lon", "reach_m")


def cheapest_costs(spark: SparkSession, d: str) -> DataFrame:
    """A trip for each customer between two nodes of the lattice, within 1 km of its start."""
    nodes, edges = written(_referenced(spark, d), "net-nodes"), written(_edges(spark, d), "edges")
    return routing.cheapest_paths(derived.trips(spark, d), nodes, edges, walked=False)[0].select("trip_id", F.round("cost", 2).alias("cost"), "explored_nodes", "status")


def cheapest_routes(spark: SparkSession, d: str) -> DataFrame:
    """What the edges of each trip's path cost together, and where they are not connected: with one another, with the start or the end."""
    nodes, edges = written(_referenced(spark, d), "net-nodes"), written(_edges(spark, d), "edges")
    trips = derived.trips(spark, d)
    _, path = routing.cheapest_paths(trips, nodes, edges)
    own = trips.select("trip_id", F.col("from_node").alias("start"), F.col("to_node").alias("end"), "w_paved", "w_traffic")
    steps = path.join(edges, "edge_id").join(own, "trip_id")
    order = W.partitionBy("trip_id").orderBy("seq")
    apart = (F.coalesce(F.lag("to_node").over(order), F.col("start")) != F.col("from_node")).cast("int") + (F.lead("edge_id").over(order).isNull() & (F.col("to_node") != F.col("end"))).cast("int")
    price = geo.edge_cost(F.col("length_m"), F.col("surface"), F.col("traffic"), F.col("w_paved"), F.col("w_traffic"))
    return steps.select("trip_id", price.alias("cost"), apart.alias("breaks")).groupBy("trip_id").agg(F.round(F.sum("cost"), 2).alias("cost"), F.sum("breaks").alias("breaks"))


def loop_phrases(spark: SparkSession, d: str) -> DataFrame:
    t = ranking.totals(derived.loop_edges(spark, d))
    m = F.col("length_m")
    return t.select("request_id", "candidate", geo.percent_label(F.col("retraced_m") / m / 10).alias("retraced"), geo.gap_label(F.lit(10_000.0), m).alias("gap"), geo.whole_km_label(m).alias("km"))


QUERIES = {f.__name__: f for f in (
    leg_totals, loop_audit, loop_waypoints, clipped_network, cheapest_costs, cheapest_routes, loop_phrases,
    network_by_class, classified_ways, directed_edges, node_degrees, network_stats, surface_coverage, node_components, component_sizes, snapped_starts, network_audit,
    request_errors, request_weights, edge_costs, loop_totals, similar_loops, distinct_loops, ranked_loops, request_counters, admitted_requests, loop_labels,
    requests_in_area, clamped_settings, client_keys, loop_bounds, stitched_loops, displayed_loops, decoded_requests, shared_loops, loop_gpx, source_fingerprints,
    requested_loops, reused_edge_costs, stored_area, coverage_document, loops_documents, loop_documents)}

_names = ", ".join(f"'{h}'" for h in derived.HIGHWAYS)
_surface = " ".join(f"when surface = '{word}' then {code}" for word, code in SURFACES.items())
_values = ", ".join(f"('{k}', {c}, {t}, {DEFAULT_SURFACES[c]})" for k, (c, t) in WAY_CLASSES.items())
_MAP = f"""
osm_node as (
  select p_partkey as node_id,
    cast(48.10 as double) + (p_partkey // 40 + ((p_partkey*7919 + p_size*31) % 1000)/cast(1000 as double)*cast(0.8 as double) - cast(0.4 as double))*cast(0.0018 as double) as lat,
    cast(-1.68 as double) + (p_partkey % 40 + ((p_partkey*104729 + p_size*17) % 1000)/cast(1000 as double)*cast(0.8 as double) - cast(0.4 as double))*cast(0.0027 as double) as lon
  from part union all
  select 20000000 + 2*p_partkey + j, cast(48.10 as double) + (p_partkey // 40)*cast(0.0018 as double) + cast(0.0002 as double)*(1+j),
    cast(-1.68 as double) + (p_partkey % 40)*cast(0.0027 as double) + cast(0.0002 as double)
  from part, (select unnest([0, 1]) as j) where p_partkey % 97 = 0),
refs as (
  select case when p_partkey // 40 < 100000 then 0 else {derived.FAR_ROWS} end + (p_partkey // 40)*10 + k as way_id, p_partkey % 40 as pos, p_partkey as node_id from part, (select unnest(range(0, 5)) as k) where (p_partkey % 40) between 8*k and 8*k+8
  union all select case when k < 1000 then 1000000 + (p_partkey % 40)*1000 + k else {derived.FAR_COLUMNS} + k*40 + p_partkey % 40 end, p_partkey // 40, p_partkey
  from part, (select unnest(range(0, (select max(p_partkey) // 320 + 1 from part))) as k) where (p_partkey // 40) between 8*k and 8*k+8),
w as (
  select way_id, list(node_id order by pos) || (case when way_id % 17 = 0 then [10000000 + way_id] else [] end)
    || (case when way_id % 13 = 0 then [max_by(node_id, pos), max_by(node_id, pos)] else [] end) as nodes, min(node_id) as first_id
  from refs group by way_id having count(*) >= 2),
osm_way as (
  select way_id, nodes, [{_names}][(cast(replace(p_brand, 'Brand#', '') as int) + way_id) % 14 + 1] as highway,
    case p_type when 'ECONOMY' then 'asphalt' when 'SMALL' then 'gravel' when 'MEDIUM' then 'ground' when 'PROMO' then 'sett' when 'LARGE' then 'tartan' end as surface,
    case p_size when 50 then 'private' when 49 then 'no' when 1 then 'yes' end as access
  from w join part on p_partkey = first_id
  union all select 5000000 + p_partkey, [20000000 + 2*p_partkey, 20000000 + 2*p_partkey + 1], 'footway', null, null from part where p_partkey % 97 = 0),
known(h, c, t, s) as (values {_values}),
kept as (
  select way_id, nodes, c as way_class, t as traffic, case {_surface} else s end as surface, surface is not null as tagged
  from osm_way join known on highway = h where (access is null or access not in ('private', 'no')) and len(nodes) >= 2),
seg as (select way_id, way_class, surface, traffic, unnest(range(0, len(nodes) - 1)) as pos, nodes from kept),
pairs as (select way_id, way_class, surface, traffic, pos, nodes[pos+1] as f, nodes[pos+2] as t from seg where nodes[pos+1] <> nodes[pos+2]),
measured as (
  select p.*, 2*6371008.8::double*asin(least(1, sqrt(pow(sin(radians(b.lat-a.lat)/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2), 2)))) as m
  from pairs p join osm_node a on a.node_id = f join osm_node b on b.node_id = t),
edge as (select (way_id*2048 + pos)*2 + dir as edge_id, case when dir = 0 then f else t end as from_node, case when dir = 0 then t else f end as to_node, m as length_m, way_class, surface, traffic
  from measured, (select unnest([0, 1]) as dir)),
net as (select * from osm_node where node_id in (select unnest(nodes) from kept))"""
_PARTS = _MAP + """,
reach(node_id, c) using key (node_id) as (
  select node_id, node_id from net
  union select e.to_node, min(r.c) from reach r join edge e on e.from_node = r.node_id join recurring.reach k on k.node_id = e.to_node where r.c < k.c group by e.to_node),
sizes as (select c, count(*) as n from reach group by c),
main as (select c from sizes order by n desc, c limit 1)"""
_DEALT = f"""
o as (
  select o_orderkey, o_custkey, o_custkey + (n // 20)*{derived.NEXT_REQUEST} as request_id, cast(n % 20 as int) as candidate
  from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders))"""
_LOOPS = f"""{_DEALT},
e as (
  select request_id, candidate, l_partkey % 6 as edge_id, cast(l_quantity*100 as double) as m, case when l_partkey % 4 <> 1 then cast(l_quantity*100 as double) else 0 end as u,
    cast(l_quantity*100 as double)*(l_suppkey % 256)/cast(255 as double) as t, case when l_linenumber = 7 then cast(l_quantity*100 as double) else 0 end as r
  from o join lineitem on l_orderkey = o_orderkey),
loops as (select request_id, candidate, sum(m) as m, sum(u) as u, sum(t) as t, sum(r) as r, count(distinct edge_id) as n from e group by all),
sets as (select distinct request_id, candidate, edge_id from e),
near as (
  select a.request_id, a.candidate as a, b.candidate as b, count(*) as shared from sets a join sets b on a.request_id = b.request_id and a.edge_id = b.edge_id and a.candidate < b.candidate group by all),
sim as (select near.*, shared / cast(x.n + y.n - shared as double) as j from near join loops x on x.request_id = near.request_id and x.candidate = a join loops y on y.request_id = near.request_id and y.candidate = b)"""
_REQ = """
req as (
  select c_custkey as request_id,
    case when c_custkey % 51 = 0 then cast(991 as double) when c_custkey % 67 = 0 then cast(43.30 as double) else cast(48.10 as double) + (c_custkey*37 % r)*cast(0.0018 as double) end as lat,
    case when c_custkey % 67 = 0 then cast(5.37 as double) else cast(-1.68 as double) + (c_custkey*53 % 40)*cast(0.0027 as double) end as lon,
    c_custkey % 11 as a, case when c_custkey % 61 = 0 then 11 else c_custkey % 7 end as k,
    case when c_custkey % 53 = 0 then 'tolerance not finite' when c_custkey % 51 = 0 then 'latitude out of range' when c_custkey % 50 = 0 then 'distance too short'
      when c_custkey % 61 = 0 then 'too many results' when c_custkey % 59 = 0 then 'unknown activity' else '' end as error
  from customer, (select max(p_partkey) // 40 + 1 as r from part))"""

ORACLES = {
    "network_by_class": f"with {_MAP} select way_class, count(*) as n_segments, round(sum(length_m), 3) as length_m, round(sum(case when surface <> 1 then length_m else 0 end)/sum(length_m), 6) as unpaved_share from edge where edge_id % 2 = 0 group by way_class",
    "classified_ways": f"with {_MAP} select way_id, len(nodes) as n_refs, way_class, surface, traffic from kept",
    "directed_edges": f"with {_MAP} select edge_id, from_node, to_node, round(length_m, 3) as length_m, xor(edge_id, 1) as reverse_edge_id from edge",
    "node_degrees": f"with {_MAP} select net.node_id, count(edge_id) as degree from net left join edge on from_node = node_id group by net.node_id",
    "network_stats": f"with {_MAP} select (select count(*) from kept) as ways, count(*) as nodes, round(min(lat), 6) as min_lat, round(min(lon), 6) as min_lon, round(max(lat), 6) as max_lat, round(max(lon), 6) as max_lon, (select count(*)//2 from edge) as segments, (select count(*) from edge) as directed_edges from net",
    "surface_coverage": f"with {_MAP} select way_class, count(*) as ways, count(*) filter (where not tagged) as untagged from kept group by way_class",
    "node_components": f"with recursive {_PARTS} select node_id, c as component_id, c = (select c from main) as is_main from reach",
    "component_sizes": f"with recursive {_PARTS} select c as component_id, n as nodes from sizes",
    "network_audit": f"""with {_MAP}, x as (
      select e.*, a.node_id is null or b.node_id is null as endpoint, r.edge_id is null or r.from_node <> e.to_node or r.to_node <> e.from_node as reverse,
        2*6371008.8::double*asin(least(1, sqrt(pow(sin(radians(b.lat-a.lat)/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2), 2)))) as chord,
        e.length_m*(1 + 6*(case e.surface when 1 then 1 when 2 then cast(0.3 as double) when 3 then 0 else cast(0.5 as double) end) + 12*e.traffic/cast(255 as double)) as cost
      from edge e left join edge r on r.edge_id = xor(e.edge_id, 1) left join osm_node a on a.node_id = e.from_node left join osm_node b on b.node_id = e.to_node)
      select unnest(['endpoint', 'reverse', 'length', 'cost']) as "check", unnest([count(*) filter (where endpoint), count(*) filter (where reverse), count(*) filter (where not length_m >= chord - 1e-6), count(*) filter (where not cost >= length_m)]) as violations from x""",
    "request_errors": f"with {_REQ} select request_id, error from req",
    "request_weights": f"with {_REQ} select request_id, cast(0.15 as double) as tolerance, cast(case when k > 0 then k else 5 end as int) as max_results, round(a/cast(10 as double)*6, 6) as w_paved, round(2 + a/cast(10 as double)*10, 6) as w_traffic from req where error = ''",
    "edge_costs": f"with {_MAP} select edge_id, round(length_m*(1 + 2*traffic/cast(255 as double)), 2) as cost_neutral, round(length_m*(1 + cast(4.8 as double)*(case surface when 1 then 1 when 2 then cast(0.3 as double) else 0 end) + 10*traffic/cast(255 as double)), 2) as cost_avoid from edge",
    "loop_totals": f"with {_LOOPS} select request_id, candidate, round(m, 3) as length_m, round(u, 3) as unpaved_m, round(t, 3) as traffic_exposure_m, round(r, 3) as retraced_m, n as n_edges from loops",
    "similar_loops": f"with {_LOOPS} select request_id, a, b, shared, round(j, 6) as jaccard from sim",
    "ranked_loops": f"""with {_LOOPS}, s as (select request_id, candidate, m as distance_m, u/m as p, t/m as q, r/m as v, (m - 10000)/10000 as g from loops),
      k as (select *, row_number() over (partition by request_id order by abs(g) <= cast(0.1 as double) desc, case when abs(g) <= cast(0.1 as double) then p end desc nulls last, case when abs(g) > cast(0.1 as double) then abs(g) end asc nulls first, candidate) as rank from s)
      select request_id, candidate, cast(rank as int) as rank, round(distance_m, 6) as distance_m, round(p, 6) as part_non_bitume, round(q, 6) as part_trafic, round(v, 6) as part_retracee, round(g, 6) as ecart_cible from k where rank <= 5""",
    "request_counters": "select event_type as path, count(*) as requests, count(*) filter (where event_type = 'error') as errors, round(sum(value), 3) as total_ms from events group by event_type",
    "snapped_starts": f"""with recursive {_PARTS}, {_REQ},
      place as (select n.node_id, lat, lon, cast(floor(lon/cast(0.005 as double)) as int) as x, cast(floor(lat/cast(0.005 as double)) as int) as y from net n join reach using (node_id) where c = (select c from main)),
      near as (
        select request_id, p.node_id, p.x - cast(floor(r.lon/cast(0.005 as double)) as int) as dx, p.y - cast(floor(r.lat/cast(0.005 as double)) as int) as dy,
          2*6371008.8::double*asin(least(1, sqrt(pow(sin(radians(p.lat-r.lat)/2), 2) + cos(radians(r.lat))*cos(radians(p.lat))*pow(sin(radians(p.lon-r.lon)/2), 2)))) as d
        from req r join place p on abs(p.x - cast(floor(r.lon/cast(0.005 as double)) as int)) <= 20 and abs(p.y - cast(floor(r.lat/cast(0.005 as double)) as int)) <= 20 where error = ''),
      ring as (select *, greatest(abs(dx), abs(dy)) as ring, min(greatest(abs(dx), abs(dy))) over (partition by request_id) as first from near),
      best as (select *, row_number() over (partition by request_id order by d, ring, dx, dy, node_id) as k from ring where ring <= first + 1)
      select r.request_id, b.node_id, round(b.d, 3) as distance_m, case when b.node_id is null then 'start_out_of_range' else 'ok' end as status
      from req r left join best b on b.request_id = r.request_id and b.k = 1 where error = ''""",
}

_deg = "cast({} as double)".format
ORACLES |= {
    "requests_in_area": f"""with {_REQ} select request_id, abs(lat) <= 90 and abs(lon) <= 180 as valid, lat >= {_deg('48.10')} and lat <= {_deg('48.20')} and lon >= {_deg('-1.68')} and lon <= {_deg('-1.60')} as inside,
      abs(lat - {_deg('48.10')}) < 1e-5 and abs(lon - {_deg('-1.68')}) < 1e-5 as at_origin, replace(printf('%.4f', lat), '.', ',') || ', ' || replace(printf('%.4f', lon), '.', ',') as label from req""",
    "clamped_settings": "select c_custkey as request_id, cast(case when c_custkey % 50 = 0 then 2000 else greatest(2000, 1500 + c_custkey*613 % 2500) end as double) as distance_m, round(case when c_custkey % 53 = 0 then cast(0.7 as double) else (c_custkey % 11)/cast(10 as double) end, 6) as avoid_paved from customer",
    "client_keys": "select event_id, case when user_id % 5 in (1, 2) and event_id % 3 = 0 then '172.16.0.' || (user_id % 250) when user_id % 5 in (1, 2) and event_id % 3 = 2 then '172.17.0.' || (user_id % 9) else '10.0.0.' || (user_id % 5) end as client from events",
    "loop_bounds": f"with {_MAP}, {_LOOPS} select request_id, round(min(lat), 6) as min_lat, round(min(lon), 6) as min_lon, round(max(lat), 6) as max_lat, round(max(lon), 6) as max_lon from o join lineitem on l_orderkey = o_orderkey join osm_node on node_id = l_partkey group by request_id",
    "stitched_loops": f"""with {_LOOPS}, l as (select *, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem)
      select request_id, candidate, string_agg(case when n is null then cast(l_partkey as varchar) else l_partkey || ',' || l_suppkey end, ',' order by l_linenumber, l_partkey, l_suppkey) as nodes
      from o join l on l_orderkey = o_orderkey group by request_id, candidate having count(*) > 1""",
    "displayed_loops": f"select request_id, candidate, cast(row_number() over (partition by request_id order by part_non_bitume desc, rank) as int) as place from ({ORACLES['ranked_loops']})",
    "decoded_requests": f"with {_REQ} select request_id, cast(request_id % 3 as int) as index, round(lat, 6) as start_lat, cast(1500 + request_id*613 % 2500 as double) as distance_m, a/cast(10 as double) as avoid_paved, cast(k as int) as max_results, error from req where error = ''",
    "shared_loops": f"select (c_custkey % 7) || '.' || c_custkey as id, cast(coalesce(candidate, -1) as int) as candidate, case when candidate is null then 'not_found' else 'ok' end as status from customer left join ({ORACLES['ranked_loops']}) on request_id = c_custkey and rank - 1 = c_custkey % 7",
    "loop_labels": f"""with {_LOOPS}, t as (select request_id, candidate, m, cast(floor(m/1000/9*60 + cast(0.5 as double)) as bigint) as mins, cast(floor(m/100 + cast(0.5 as double)) as bigint) as hm from loops)
      select request_id, candidate, case when m < 1000 then cast(floor(m + cast(0.5 as double)) as bigint) || ' m' else (hm // 10) || ',' || (hm % 10) || ' km' end as distance,
        case when mins < 60 then mins || ' min' else (mins // 60) || ' h ' || lpad(cast(mins % 60 as varchar), 2, '0') end as duration from t""",
}

ORACLES |= {
    "reused_edge_costs": f"with {_MAP} select e.edge_id, round(length_m*(1 + 2*traffic/cast(255 as double))*(case when u.segment is null then 1 else 4 end), 2) as cost from edge e left join (select distinct edge_id // 2 as segment from edge where edge_id % 6 = 1) u on e.edge_id // 2 = u.segment",
    "requested_loops": f"""with {_REQ}, {_DEALT},
      l as (select o_custkey, request_id, candidate, sum(cast(l_quantity*100 as double)) as m,
        sum(case when l_partkey % 4 <> 1 then cast(l_quantity*100 as double) else 0 end) as u from o join lineitem on l_orderkey = o_orderkey group by all),
      s as (select l.request_id, candidate, case when m > 0 then u/m else 0 end as p, (m - t)/t as g, case when k > 0 then k else 5 end as most
        from l join (select *, cast(1500 + request_id*613 % 2500 as double) as t from req where error = '') q on q.request_id = o_custkey),
      r as (select *, row_number() over (partition by request_id order by abs(g) <= cast(0.15 as double) desc, case when abs(g) <= cast(0.15 as double) then p end desc nulls last, case when abs(g) > cast(0.15 as double) then abs(g) end asc nulls first, candidate) as rank from s)
      select request_id, candidate, cast(rank as int) as rank, round(g, 6) as ecart_cible from r where rank <= most""",
}

_WALKS = f"""{_MAP}, {_DEALT},
  line as (select request_id, candidate, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as leg, l_partkey as node_id from o join lineitem on l_orderkey = o_orderkey),
  out as (select from_node as node_id, min(edge_id) as edge_id from edge group by from_node),
  walk as (select request_id, candidate, leg, seq, case when seq = 0 then edge_id else xor(edge_id, 1) end as edge_id from line join out using (node_id), (select unnest([0, 1]) as seq)),
  step as (select w.*, e.from_node, e.to_node, e.length_m, e.surface, e.traffic, e.edge_id // 2 as segment from walk w join edge e using (edge_id))"""
_HAV = "2*6371008.8::double*asin(least(1, sqrt(pow(sin(radians({b}.lat-{a}.lat)/2), 2) + cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2), 2))))".format
ORACLES |= {
    "leg_totals": f"""with {_WALKS}, first as (select request_id, candidate, segment, min(leg) as first from step group by all)
      select request_id, candidate, leg, round(sum(length_m), 3) as length_m, round(sum(case when surface <> 1 then length_m else 0 end), 3) as unpaved_m, round(sum(length_m*traffic/cast(255 as double)), 3) as traffic_exposure_m,
        round(sum(case when leg > first then length_m else 0 end), 3) as retraced_m, count(*) as n_edges from step join first using (request_id, candidate, segment) group by request_id, candidate, leg""",
    "loop_audit": f"""with {_WALKS}, nxt as (select *, lead(from_node) over (partition by request_id, candidate order by leg, seq) as after from step),
      l as (select request_id, candidate, count(*) filter (where after <> to_node) as apart, first(from_node order by leg, seq) as a, last(to_node order by leg, seq) as b, sum(length_m) as m, list_sort(list(distinct edge_id)) as es from nxt group by all),
      d as (select count(*) as n from l group by request_id, es)
      select unnest(['unknown', 'apart', 'open', 'tolerance', 'alike']) as "check",
        unnest([cast(0 as bigint), cast(sum(apart) as bigint), count(*) filter (where a <> b), count(*) filter (where abs(m - 2000) > 500), (select cast(sum(n*(n - 1)//2) as bigint) from d)]) as violations from l""",
    "loop_waypoints": f"""with {_REQ}, v as (select *, 1500 + request_id*613 % 2500 as m, case when k > 0 then k else 5 end as most, unnest(range(0, 20)) as candidate from req where error = ''),
      b as (select *, candidate*(2*pi()/20) + cast(('0x' || substr(md5(printf('%.6f|%.6f|%.1f|%.3f|%.3f|%d|%d', lat, lon, cast(m as double), cast(0.15 as double), a/cast(10 as double), most, request_id % 3) || '|' || candidate), 1, 8)) as bigint)/cast(4294967296 as double)*cast(0.3 as double) as bearing from v),
      t as (select *, unnest([0, 1, 2]) as turn, m/(2*pi()*cast(1.3 as double)) as radius from b)
      select request_id, cast(candidate as int) as candidate, cast(turn as int) as k, round(bearing, 6) as bearing, round(lat + radius*cos(bearing + turn*2*pi()/3)/111320, 6) as lat, round(lon + radius*sin(bearing + turn*2*pi()/3)/(111320*cos(radians(lat))), 6) as lon from t""",
    "clipped_network": f"""with {_MAP}, {_REQ}, v as (select *, (1500 + request_id*613 % 2500)/cast(2 as double) as reach from req where error = ''),
      near as (select request_id, n.node_id from v join net n on abs(n.lat - v.lat) <= reach/110000 and {_HAV(a='v', b='n')} <= reach),
      inside as (select x.request_id, count(*) as edges from edge e join near x on x.node_id = e.from_node join near y on y.node_id = e.to_node and y.request_id = x.request_id group by x.request_id)
      select request_id, count(*) as nodes, coalesce(any_value(edges), 0) as edges from near left join inside using (request_id) group by request_id""",
    "cheapest_costs": f"""with recursive {_MAP},
      trip as (select c_custkey as trip_id, 1 + c_custkey*37 % p as f, least(p, 1 + c_custkey*37 % p + 41*(1 + c_custkey % 3)) as t, (c_custkey % 11)/cast(10 as double) as a from customer, (select max(p_partkey) as p from part)),
      clip as (select trip_id, f, t, a, n.node_id, {_HAV(a='n', b='g')} as h from trip join net s on s.node_id = f join net g on g.node_id = t join net n on abs(n.lat - s.lat) <= cast(0.01 as double) and {_HAV(a='s', b='n')} <= 1000 where f <> t),
      te as (select x.trip_id, e.from_node, e.to_node, e.length_m*(1 + 6*x.a*(case surface when 1 then 1 when 2 then cast(0.3 as double) when 3 then 0 else cast(0.5 as double) end) + (2 + 10*x.a)*traffic/cast(255 as double)) as cost
        from clip x join edge e on e.from_node = x.node_id join clip y on y.trip_id = x.trip_id and y.node_id = e.to_node),
      gone(trip_id, node_id, g) using key (trip_id, node_id) as (
        select trip_id, node_id, case when node_id = f then cast(0 as double) else cast(1e18 as double) end from clip
        union select r.trip_id, te.to_node, min(r.g + te.cost) from gone r join te on te.trip_id = r.trip_id and te.from_node = r.node_id join recurring.gone k on k.trip_id = te.trip_id and k.node_id = te.to_node
        where r.g < 1e17 and r.g + te.cost < k.g group by te.trip_id, te.to_node, r.trip_id),
      goal as (select c.trip_id, g as total from clip c join gone using (trip_id, node_id) where c.node_id = t and g < 1e17),
      seen as (select c.trip_id, count(*) filter (where g < 1e17 and (total is null or g + h <= total + 1e-6)) as n from clip c join gone using (trip_id, node_id) left join goal on goal.trip_id = c.trip_id group by c.trip_id)
      select trip.trip_id, round(case when f = t and s.node_id is not null then 0 else total end, 2) as cost, coalesce(n, 0) as explored_nodes, case when f = t and s.node_id is not null or total is not null then 'ok' else 'no_path' end as status
      from trip left join goal on goal.trip_id = trip.trip_id left join seen on seen.trip_id = trip.trip_id left join net s on s.node_id = f""",
    "loop_phrases": f"""with {_LOOPS},
      x as (select request_id, candidate, m, r/m/10*100 as p, cast(floor(m/1000 + cast(0.5 as double)) as bigint) as km from loops)
      select request_id, candidate, case when p > 0 and p < 1 then replace(printf('%.1f', round(p*10)/10), '.', ',') || ' %' else cast(floor(p + cast(0.5 as double)) as bigint) || ' %' end as retraced,
        case when km = 10 and abs(10000 - m) < 500 then '' else 'tu en demandais 10' end as gap, km || ' km' as km from x""",
}

ORACLES |= {
    "cheapest_routes": f"select trip_id, cost, 0 as breaks from ({ORACLES['cheapest_costs']}) where cost > 0",
}

_best = ORACLES["ranked_loops"]
_points = f"{_DEALT} select request_id, candidate, count(*) as points from o join lineitem on l_orderkey = o_orderkey join osm_node on node_id = l_partkey group by all"
ORACLES |= {
    "stored_area": f"""with recursive {_PARTS}, inside as (select * from net where lat between {_deg('48.12')} and {_deg('48.20')} and lon between {_deg('-1.66')} and {_deg('-1.60')})
      select node_id, any_value(c) as component_id, count(edge_id) as edges, coalesce(round(sum(length_m), 3), 0) as length_m from inside join reach using (node_id) left join edge on from_node = node_id group by node_id""",
    "coverage_document": f"with {_MAP} select {', '.join(f'round({k}({c}), 6) as {k}_{c}' for k in ('min', 'max') for c in ('lat', 'lon'))}, '{config_hash()}' as config_hash, cast(1 as bigint) as sources, '{export.ATTRIBUTION}' as attribution from net",
    "loops_documents": f"""with n as (with {_MAP}, {_points})
      select request_id, cast(rank - 1 as int) as place, (rank - 1) || '.' || request_id as id, distance_m, part_non_bitume, ecart_cible, points, '{export.ATTRIBUTION}' as attribution from ({_best}) join n using (request_id, candidate)""",
    "loop_documents": f"""with n as (with {_MAP}, {_points}), q as (with {_REQ} select * from req where error = '')
      select request_id, candidate, (rank - 1) || '.' || request_id as id, distance_m, part_non_bitume, ecart_cible, points, round(lat, 6) as start_lat, cast(1500 + request_id*613 % 2500 as double) as asked_m, a/cast(10 as double) as avoid_paved
      from ({_best}) join n using (request_id, candidate) join q using (request_id)""",
}

ORACLES |= {
    "distinct_loops": f"""with recursive {_LOOPS},
      c as (select request_id, candidate, row_number() over (partition by request_id order by candidate) as n from loops),
      alike as (select request_id, b as candidate, list(a) as before from sim where j >= cast(0.7 as double) group by all),
      walk(request_id, n, kept) as (
        select distinct request_id, cast(0 as bigint), cast([] as int[]) from c
        union all select w.request_id, c.n, case when list_has_any(kept, coalesce(before, cast([] as int[]))) then kept else list_append(kept, c.candidate) end
        from walk w join c on c.request_id = w.request_id and c.n = w.n + 1 left join alike a on a.request_id = c.request_id and a.candidate = c.candidate)
      select request_id, unnest(max_by(kept, n)) as candidate from walk group by request_id""",
}
