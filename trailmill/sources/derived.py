"""Map, request, loop and log tables derived from the given tables with exact arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: From here on are the ids of ways that would meet others': column ways from piece 1,000 on, row ways from row 100,000 on.
FAR_COLUMNS, FAR_ROWS = 10**12, 2 * 10**12
#: Requests of a customer lie so far apart.
NEXT_REQUEST = 1 << 40
#: Every order is a candidate: a customer's first 20 are those of request o_custkey, each 20 more those of a further request.
_DEALT = f"""o as (
          select o_orderkey, o_custkey + (n div 20) * {NEXT_REQUEST} as request_id, cast(n % 20 as int) as candidate
          from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from {{orders}}))"""
HIGHWAYS = "path bridleway track footway pedestrian cycleway living_street service residential unclassified tertiary secondary motorway steps".split()


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def osm_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, """
        select p_partkey as node_id,
          48.10D + (p_partkey div 40 + ((p_partkey*7919 + p_size*31) % 1000)/1000.0D*0.8D - 0.4D)*0.0018D as lat,
          -1.68D + (p_partkey % 40 + ((p_partkey*104729 + p_size*17) % 1000)/1000.0D*0.8D - 0.4D)*0.0027D as lon from {part}
        union all
        select 20000000 + 2*p_partkey + j, 48.10D + (p_partkey div 40)*0.0018D + 0.0002D*(1+j), -1.68D + (p_partkey % 40)*0.0027D + 0.0002D
        from {part} lateral view explode(array(0, 1)) as j where p_partkey % 97 = 0""", "part")


def osm_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, nodes, highway, surface, access). Ways are pieces of rows, of columns, or lie apart; no two share an id."""
    names = ", ".join(f"'{h}'" for h in HIGHWAYS)
    return _sql(spark, sf_dir, f"""
        with refs as (
          select if(p_partkey div 40 < 100000, 0, {FAR_ROWS}) + (p_partkey div 40)*10 + k as way_id, p_partkey % 40 as pos, p_partkey as node_id
          from {{part}} lateral view explode(sequence(0, 4)) as k where (p_partkey % 40) between 8*k and 8*k+8
          union all
          select if(k < 1000, 1000000 + (p_partkey % 40)*1000 + k, {FAR_COLUMNS} + k*40 + p_partkey % 40), p_partkey div 40, p_partkey
          from {{part}} lateral view explode(sequence(greatest((p_partkey div 40 - 1) div 8, 0), (p_partkey div 40) div 8)) as k
          where (p_partkey div 40) between 8*k and 8*k+8),
        w as (
          select way_id, transform(array_sort(collect_list(struct(pos, node_id))), s -> s.node_id) as own, max_by(node_id, pos) as last_id, min(node_id) as first_id
          from refs group by way_id having count(*) >= 2)
        select way_id, concat(own, if(way_id % 17 = 0, array(10000000 + way_id), cast(array() as array<bigint>)), if(way_id % 13 = 0, array(last_id, last_id), cast(array() as array<bigint>))) as nodes,
          element_at(array({names}), cast((cast(replace(p_brand, 'Brand#', '') as int) + way_id) % 14 + 1 as int)) as highway,
          case p_type when 'ECONOMY' then 'asphalt' when 'SMALL' then 'gravel' when 'MEDIUM' then 'ground' when 'PROMO' then 'sett' when 'LARGE' then 'tartan' end as surface,
          case p_size when 50 then 'private' when 49 then 'no' when 1 then 'yes' end as access
        from w join {{part}} on p_partkey = first_id
        union all
        select 5000000 + p_partkey, array(20000000 + 2*p_partkey, 20000000 + 2*p_partkey + 1), 'footway', null, null from {{part}} where p_partkey % 97 = 0""", "part")


def loop_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, """
        select c_custkey as request_id,
          case when c_custkey % 51 = 0 then 991D when c_custkey % 67 = 0 then 43.30D else 48.10D + (c_custkey*37 % r)*0.0018D end as start_lat,
          case when c_custkey % 67 = 0 then 5.37D else -1.68D + (c_custkey*53 % 40)*0.0027D end as start_lon,
          case when c_custkey % 50 = 0 then 100D else cast(1500 + c_custkey*613 % 2500 as double) end as distance_m,
          case when c_custkey % 53 = 0 then cast('NaN' as double) else 0.15D end as tolerance,
          case when c_custkey % 59 = 0 then 'bike' else '' end as activity, (c_custkey % 11)/10.0D as avoid_paved,
          cast(case when c_custkey % 61 = 0 then 11 else c_custkey % 7 end as int) as max_results, cast(c_custkey % 3 as int) as variant
        from {customer}, (select max(p_partkey) div 40 + 1 as r from {part})""", "customer", "part")


def loop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, candidate, edge_id, length_m, unpaved_m, traffic_exposure_m, retraced_m): lines of every order, dealt as in _DEALT."""
    return _sql(spark, sf_dir, f"with {_DEALT}" """
        select request_id, candidate, l_partkey % 6 as edge_id, cast(l_quantity*100 as double) as length_m,
          case when l_partkey % 4 <> 1 then cast(l_quantity*100 as double) else 0D end as unpaved_m,
          cast(l_quantity*100 as double) * (l_suppkey % 256) / 255D as traffic_exposure_m,
          case when l_linenumber = 7 then cast(l_quantity*100 as double) else 0D end as retraced_m
        from o join {lineitem} on l_orderkey = o_orderkey""", "orders", "lineitem")


def loop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, candidate, leg, node_id): the lines of every order in their order, each with the node that its part is."""
    return _sql(spark, sf_dir, f"with {_DEALT}" """
        select request_id, candidate, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as leg, l_partkey as node_id
        from o join {lineitem} on l_orderkey = o_orderkey""", "orders", "lineitem")


def loop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, candidate) of every order, dealt as in _DEALT."""
    return _sql(spark, sf_dir, f"with {_DEALT} select request_id, candidate from o", "orders")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip_id, from_node, to_node, w_paved, w_traffic, reach_m): for each customer, from a node to one up to three rows and columns on."""
    return _sql(spark, sf_dir, """
        select c_custkey as trip_id, 1 + c_custkey*37 % p as from_node, least(p, 1 + c_custkey*37 % p + 41*(1 + c_custkey % 3)) as to_node,
          6D*((c_custkey % 11)/10.0D) as w_paved, 2D + 10D*((c_custkey % 11)/10.0D) as w_traffic, 1000D as reach_m
        from {customer}, (select max(p_partkey) as p from {part})""", "customer", "part")


def loop_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, candidate, seq, lat, lon): the nodes that the lines of loop_edges() stand for."""
    return spark.sql(f"with {_DEALT}" """
        select request_id, candidate, l_linenumber as seq, lat, lon
        from o join {lineitem} on l_orderkey = o_orderkey join {nodes} on node_id = l_partkey""",
        nodes=osm_nodes(spark, sf_dir), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem")})


def loop_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, candidate, leg, nodes): a leg from each line of an order to its next."""
    return _sql(spark, sf_dir, f"with {_DEALT}," """
        l as (select l_orderkey, row_number() over w as leg, l_partkey, l_suppkey, lead(l_partkey) over w as next from {lineitem} window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))
        select request_id, candidate, leg, array(l_partkey, l_suppkey, next) as nodes
        from o join l on l_orderkey = o_orderkey where next is not null""", "orders", "lineitem")


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, peer, forwarded): who asked, and the header that came along."""
    return _sql(spark, sf_dir, """
        select event_id, concat('10.0.0.', user_id % 5, ':', 4000 + event_id % 100) as peer,
          case event_id % 3 when 0 then concat('9.9.9.9, 172.16.0.', user_id % 250, ':80') when 2 then concat('172.17.0.', user_id % 9) end as forwarded from {events}""", "events")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, """
        select event_id, concat('c', user_id) as client, event_type as path, value as duration_ms, event_type = 'error' as is_error,
          (unix_micros(cast(ts as timestamp)) - 1704067200000000) div 60000 as t_us from {events}""", "events")
