"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trailmill.functions.shared import written


#: Edges that a task contracts at once; its memory follows this, not the partition.
BLOCK = 1 << 18


def _contracted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges, and the least node that they connect it to."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), a block of a partition at a time, as edges to the least node of each connected piece.

    It does before the first shuffle what partial aggregation does: no node and no connection is lost, and a block
    has an edge for each of its nodes at most.
    """

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = _contracted(*(np.concatenate([h.column(k).to_numpy() for h in held]) for k in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction of pairs(a, b) with a > b: every neighbour moves to the least one of its centre.

    Least neighbours are partial aggregates, so a hub costs a row for each task, not for each edge.
    """
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over undirected `edges`; self-loops give singletons.

    Rows with a null end are ignored, repeated edges count once, an empty table gives an empty table.
    Blocks of edges are contracted where they are read. If all that is left of them fits in one block, contracting
    that ends the search. Else blocks of neighbouring ids are, and only the pieces that share a node are linked in turn; on a
    map these are few. Where ids say nothing of what is near, so that more than half would be left, rounds of joins follow, which
    grow with the logarithm of a component's size, not with its diameter.
    """
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).dropna()
    ends, left = _counted(ends.mapInArrow(_forest, "a long, b long"), "cc-ends")
    return _linked(ends, left[0], max_rounds)


def _linked(ends: DataFrame, rows: int, max_rounds: int) -> DataFrame:
    """connected_components() of a written table of so many `rows`."""
    if rows < BLOCK:
        last = written(ends.coalesce(1).mapInArrow(_forest, "a long, b long"), "cc-last")
        return last.select(F.col("a").alias("node"), F.col("b").alias("component"))
    pieces = written(ends.repartitionByRange("a").sortWithinPartitions("a").mapInArrow(_forest, "a long, b long"), "cc-pieces")
    least = pieces.groupBy("a").agg(F.min("b").alias("m"))
    shared = pieces.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    links, left = _counted(shared, "cc-links")
    if left[0] > rows // 2:
        return _settled(ends, max_rounds)
    above = _linked(links, left[0], max_rounds).withColumnRenamed("node", "m")
    return least.join(above, "m", "left").select(F.col("a").alias("node"), F.coalesce("component", "m").alias("component"))


def _settled(ends: DataFrame, max_rounds: int) -> DataFrame:
    """connected_components() of a written table, by rounds of joins."""
    pairs, before = ends.filter("a <> b"), None
    for _ in range(max_rounds):
        pairs, after = _counted(_star(_star(pairs, large=True), large=False), "cc-round")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = ends.select(F.col("a").alias("node")).unionAll(ends.select(F.col("b").alias("node"))).distinct()
    return nodes.join(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _counted(pairs: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """`pairs` as a written table, and its rows and a sum of their hashes, seen as it is written."""
    seen = Observation()
    out = written(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), name)
    return out, (seen.get["n"], seen.get["h"])
