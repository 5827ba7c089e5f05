"""Loops of a request: totals, near-duplicates, score and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.geo import score

SIMILAR = 0.7
FIGURES = ("length_m", "unpaved_m", "traffic_exposure_m", "retraced_m")


def totals(edges: DataFrame) -> DataFrame:
    return edges.groupBy("request_id", "candidate").agg(*[F.sum(c).alias(c) for c in FIGURES], F.array_sort(F.collect_set("edge_id")).alias("edge_set"))


def similarity(loops: DataFrame) -> DataFrame:
    """(request_id, a, b, shared, jaccard) of candidates of a request that share edges; at most 20 candidates each."""
    grouped = loops.select("request_id", F.struct("candidate", "edge_set").alias("x")).groupBy("request_id").agg(F.collect_list("x").alias("all"))
    one = grouped.select("request_id", "all", F.explode("all").alias("x"))
    pairs = one.select("request_id", "x", F.explode(F.filter("all", lambda y: y["candidate"] > F.col("x.candidate"))).alias("y"))
    both = F.size(F.array_intersect("x.edge_set", "y.edge_set")).cast("long")
    shared = pairs.select("request_id", F.col("x.candidate").alias("a"), F.col("y.candidate").alias("b"), F.size("x.edge_set").alias("na"), F.size("y.edge_set").alias("nb"), both.alias("shared")).filter("shared > 0")
    return shared.select("request_id", "a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def distinct_loops(loops: DataFrame) -> DataFrame:
    """Candidates in order, without those similar to a kept one. Empty sets are like nothing."""
    all_of = loops.groupBy("request_id").agg(F.array_sort(F.collect_list("candidate")).alias("c"))
    near = similarity(loops).filter(F.col("jaccard") >= SIMILAR).groupBy("request_id").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    none = F.array().cast("array<int>")
    kept = F.aggregate(F.col("c").cast("array<int>"), none, lambda k, x: F.when(
        F.exists("pairs", lambda p: (p["b"] == x) & F.array_contains(k, p["a"].cast("int"))), k).otherwise(F.concat(k, F.array(x))))
    chosen = all_of.join(near, "request_id", "left").withColumn("pairs", F.coalesce("pairs", F.filter(F.array(F.struct(F.lit(0).cast("int").alias("a"), F.lit(0).cast("int").alias("b"))), lambda p: F.lit(False))))
    return loops.join(chosen.select("request_id", F.explode(kept).alias("candidate")), ["request_id", "candidate"], "left_semi")


def ranked(loops: DataFrame, target: Column | float = 10_000.0, tolerance: Column | float = 0.10, max_results: Column | int = 5) -> DataFrame:
    """Best loops first: inside the tolerance by unpaved share, then outside by gap; ties by candidate. The figures may be columns of `loops`."""
    s = score(F.col("length_m"), F.col("unpaved_m"), F.col("traffic_exposure_m"), F.col("retraced_m"), F.lit(target))
    scored = loops.select("request_id", "candidate", *[v.alias(k) for k, v in s.items()], F.lit(tolerance).alias("_tolerance"), F.lit(max_results).alias("_max_results"))
    gap = F.abs("ecart_cible")
    inside = gap <= F.col("_tolerance")
    order = W.partitionBy("request_id").orderBy(inside.desc(), F.when(inside, F.col("part_non_bitume")).desc(), F.when(~inside, gap).asc(), "candidate")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("_max_results")).drop("_tolerance", "_max_results")


def ranked_for(loops: DataFrame, requests: DataFrame) -> DataFrame:
    """ranked() by each request's own distance_m, tolerance and max_results; loops without a valid request are left out.

    `requests` has gone through validated() and with_defaults(); `loops` names the request it is for in `asked`.
    """
    good = requests.filter("error is null").select(F.col("request_id").alias("asked"), F.col("distance_m").alias("_target"), "tolerance", "max_results")
    return ranked(loops.join(good, "asked"), F.col("_target"), F.col("tolerance"), F.col("max_results"))
