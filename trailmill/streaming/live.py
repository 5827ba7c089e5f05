"""Running streams: admission by token bucket, counters, requests answered with loops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailmill.functions.shared import written
from trailmill.operators.export import REQUEST
from trailmill.operators.requests import validated
from trailmill.operators.routing import CANDIDATES, TRIES, generate_loops
from trailmill.streaming.limiter import BURST, EXEMPT, _bucket, counters

#: A bucket is full again after 5 s; a client idle for this long needs no state.
IDLE_MS = 600_000


def admitted_stream(log: DataFrame) -> DataFrame:
    """(event_id, admitted) of a stream (event_id, client, path, t_us) in append mode; exempt paths pass and cost nothing.

    Within a batch a client's events are taken in time order. A later batch may bring earlier events: they
    add no tokens and are judged by what the bucket holds. Clients idle for IDLE_MS are forgotten, for which
    the stream keeps running batches without data: with trigger availableNow, turn these off
    (spark.sql.streaming.noDataMicroBatches.enabled).
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (BURST, None)
        own = pd.concat(parts).sort_values(["t_us", "event_id"])  # one client's events of one batch
        ok, tokens, last = _bucket(tokens, last, own["t_us"].tolist())
        state.update((float(tokens), last))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame({"event_id": own["event_id"], "admitted": ok})

    limited = log.filter(F.col("path") != EXEMPT).select("client", "event_id", "t_us").groupBy("client").applyInPandasWithState(
        run, "event_id long, admitted boolean", "tokens double, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return limited.unionAll(log.filter(F.col("path") == EXEMPT).select("event_id", F.lit(True).alias("admitted")))


def counters_stream(log: DataFrame) -> DataFrame:
    """Requests, errors and milliseconds of each path so far; for complete or update mode."""
    return counters(log)


def read_requests(raw: DataFrame) -> DataFrame:
    """Loop requests of raw(request_id, body), whose body is a request as JSON; `error` says why one can't be answered.

    A body that isn't JSON is an unreadable request, a field left out counts as zero or empty.
    """
    told = raw.select("request_id", F.from_json("body", REQUEST).alias("r"))
    zero = {"start_lat": "r.start.lat", "start_lon": "r.start.lon", "distance_m": "r.distance_m", "tolerance": "r.tolerance", "avoid_paved": "r.preferences.avoid_paved"}
    fields = told.select("request_id", F.to_json("r").alias("given"), *(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in zero.items()), F.coalesce("r.activity", F.lit("")).alias("activity"), *(F.coalesce(f"r.{c}", F.lit(0)).cast("int").alias(c) for c in ("max_results", "variant")))
    blank = F.col("given").isNull() | (F.col("given") == "{}")
    return validated(fields).withColumn("error", F.when(blank, "unreadable request").otherwise(F.col("error"))).drop("given")


def answer_requests(raw: DataFrame, batch_id: int, nodes: DataFrame, edges: DataFrame, out: str, count: int = CANDIDATES, tries: int = TRIES) -> None:
    """Writes replies(request_id, error, loops) and loops of one batch below `out`, by batch_id: a batch that comes again replaces what it wrote."""
    asked = written(read_requests(raw), "asked")
    good = asked.filter("error is null").drop("error")
    best, _ = generate_loops(good, nodes, edges, count, tries)
    best.write.mode("overwrite").parquet(f"{out}/loops/batch={batch_id}")
    found = best.groupBy("request_id").agg(F.count("*").alias("loops"))
    replies = asked.select("request_id", "error").join(found, "request_id", "left").select("request_id", "error", F.coalesce("loops", F.lit(0)).cast("long").alias("loops"))
    replies.write.mode("overwrite").parquet(f"{out}/replies/batch={batch_id}")  # last: with it a batch is answered


def answer_stream(raw: DataFrame, nodes: DataFrame, edges: DataFrame, out: str, checkpoint: str, count: int = CANDIDATES, tries: int = TRIES) -> StreamingQuery:
    """A stream raw(request_id, body) answered batch after batch, each request against the whole network; see answer_requests."""
    return raw.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda df, batch_id: answer_requests(df, batch_id, nodes, edges, out, count, tries)).start()
