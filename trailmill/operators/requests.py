"""Loop requests: validation, defaults and preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.geo import weights

MIN_DISTANCE, MAX_DISTANCE, MAX_TOLERANCE, MAX_RESULTS = 500, 50_000, 0.5, 10


def validated(requests: DataFrame) -> DataFrame:
    """Adds `error`, null for a valid request. A field left out counts as zero or empty."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    error = F.lit(None).cast("string")
    rules = [(f"{c} not finite", F.isnan(number(c)) | (F.abs(number(c)) == float("inf"))) for c in ("start_lat", "start_lon", "distance_m", "tolerance")]
    rules += [("latitude out of range", F.abs(number("start_lat")) > 90), ("longitude out of range", F.abs(number("start_lon")) > 180),
              ("distance too short", number("distance_m") < MIN_DISTANCE), ("distance too long", number("distance_m") > MAX_DISTANCE),
              ("tolerance out of range", (number("tolerance") < 0) | (number("tolerance") > MAX_TOLERANCE)),
              ("too many results", F.coalesce("max_results", F.lit(0)) > MAX_RESULTS), ("unknown activity", ~F.coalesce("activity", F.lit("")).isin("", "trail"))]
    for text, bad in reversed(rules):
        error = F.when(bad, text).otherwise(error)
    return requests.withColumn("error", error)


def with_defaults(requests: DataFrame) -> DataFrame:
    paved, traffic = weights(F.col("avoid_paved"))
    return requests.withColumns({"tolerance": F.when(F.col("tolerance") > 0, F.col("tolerance")).otherwise(0.10),
                                 "max_results": F.when(F.col("max_results") > 0, F.col("max_results")).otherwise(5), "w_paved": paved, "w_traffic": traffic})
