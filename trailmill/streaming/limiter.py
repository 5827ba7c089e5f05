"""Admission of requests by a token bucket for each client."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, BURST, EXEMPT = 1.0, 5.0, "view"


def _bucket(tokens: float, last: int | None, times: list[int]) -> tuple[list[bool], float, int | None]:
    out = []
    for t in times:
        if last is not None:
            tokens = min(BURST, tokens + max(t - last, 0) / 1e6 * RATE)
        last = t if last is None else max(t, last)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def admitted(log: DataFrame) -> DataFrame:
    """(event_id, admitted) of a log (event_id, client, path, t_us); each client's events in time order. Health paths pass and cost nothing."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tokens, last = None, BURST, None  # a client's events may span batches; only its state is kept
        for part in parts:
            verdicts: list[bool] = []
            for name, own in part.groupby("client", sort=False):
                if name != client:
                    client, tokens, last = name, BURST, None
                ok, tokens, last = _bucket(tokens, last, own["t_us"].tolist())
                verdicts += ok
            yield pd.DataFrame({"event_id": part["event_id"], "admitted": verdicts})

    limited = log.filter(F.col("path") != EXEMPT).select("client", "event_id", "t_us")
    ordered = limited.repartition("client").sortWithinPartitions("client", "t_us", "event_id")
    free = log.filter(F.col("path") == EXEMPT).select("event_id", F.lit(True).alias("admitted"))
    return ordered.mapInPandas(run, "event_id long, admitted boolean").unionAll(free)


def counters(log: DataFrame) -> DataFrame:
    """Requests, errors and milliseconds of each path; the same plan serves a stream in complete mode."""
    return log.groupBy("path").agg(F.count("*").alias("requests"), F.count_if("is_error").alias("errors"), F.round(F.sum("duration_ms"), 3).alias("total_ms"))
