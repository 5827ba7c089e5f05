"""Histogram sort: shards of nearly equal bytes in the order of a content key.

Documents are ordered by a 128-bit key of their text, so that equal texts are neighbours. The splitters
between shards are found by probing: each round counts, exactly and over all partitions at once, the
bytes and rows below every candidate boundary, and only the cells that hold a splitter are probed more
finely. When each splitter is known to the row, rows are exchanged once, to cells of the known histogram;
a row's place in its shard is its place in its cell plus the rows counted before it.

Texts whose rows weigh much are given a shard first, and the splitters then fill what room they leave, so
that both groups stay whole and sizes stay near equal.
"""

from __future__ import annotations

import heapq
import os
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.shared import written

#: Hex digits that a probing round adds: so many cells for each cell it refines.
DIGITS = 2
#: Cells of the last exchange for each shard.
CELLS = 16
#: A group of equal texts over this share of a shard is given a shard before the others.
GROUP_SHARE = 0.01


def shard_by_bytes(docs: DataFrame, shards: int = 16, group_share: float = GROUP_SHARE) -> DataFrame:
    """docs(doc_id, text) with size, text_crc32, law 'bytes', shard, slot, grown_shard (null).

    size is the UTF-8 length plus 1 (a null text has length 0). All rows of one text go to one shard, and
    shards differ from the mean by about `group_share` of it. Only a text whose rows fit in no shard beside
    the larger groups is cut by rows, as then sizes come first. Rows equal in text and doc_id are
    interchangeable. Null and repeated doc_ids are kept; further columns are dropped. An empty table gives
    an empty table.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.md5(F.encode(body, "UTF-8")).alias("k"),
        # rows of one text by doc_id; those of one doc_id are interchangeable and fall in any order
        F.concat(*(F.substring(F.md5(c), 1, 16) for c in (F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.rand().cast("string")))).alias("d"))
    rows = written(rows, "shard-rows")
    total, = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    # fewer than shards / group_share texts have so many bytes
    heavy = rows.groupBy("k").agg(F.sum("size").alias("b")).filter(F.col("b") > group_share * total / shards).collect()
    homes, room = _homes([(k, b) for k, b in heavy], total, shards)
    table = docs.sparkSession.createDataFrame([(k, "00" if home is None else f"01{home:04x}") for k, home in homes.items()], "k string, head string")
    zeros = F.repeat(F.lit("0"), F.lit(32))
    keyed = rows.join(F.broadcast(table), "k", "left").withColumn(
        "key", F.concat(F.coalesce("head", F.lit("00")), "k", F.when(F.col("head").isNull(), zeros).otherwise(F.col("d")))).drop("k", "d", "head")
    # keys begin with the light texts, shard after shard, and end with the heavy ones, shard after shard
    ends = list(accumulate([*room, *(total / shards - r for r in room)]))
    shard_at = lambda twice: min(bisect_right(ends, twice / 2), 2 * shards - 1)  # noqa: E731  of twice the bytes before
    cells: dict[str, int] = {"": 0}  # prefix of the keys in a cell: bytes before it
    leaves: dict[str, tuple[int, int, int]] = {}  # prefix: bytes before, bytes, rows
    while cells:
        name = None  # a cell's rows are told apart by the next digits after what all its keys have in common
        for width in sorted({len(c) for c in cells}):
            inside = F.substring("key", 1, width).isin([c for c in cells if len(c) == width])
            part = F.substring("key", 1, width + DIGITS)
            name = F.when(inside, part) if name is None else name.when(inside, part)
        counted = keyed.withColumn("cell", name).filter("cell is not null").groupBy("cell").agg(
            F.sum("size"), F.count("*"), F.min("key"), F.max("key")).collect()  # at most 256 for each refined cell
        refined: dict[str, int] = {}
        for cell, size, n, low, high in sorted(counted, key=lambda r: r[0]):
            parent = cell[:-DIGITS]
            start, cells[parent] = cells[parent], cells[parent] + size
            # a cell with a splitter is probed on; so is one with far more bytes than its share, for the exchange
            if low != high and (shard_at(2 * start) != shard_at(2 * (start + size)) or size > total / (shards * CELLS)):
                common = os.path.commonprefix([low, high])
                refined[common[: len(common) // DIGITS * DIGITS]] = start
            else:
                leaves[cell] = (start, size, n)
        cells = refined
    return _exchange(keyed, leaves, shard_at, shards)


def _homes(heavy: list[tuple[str, int]], total: int, shards: int) -> tuple[dict[str, int | None], list[int]]:
    """A shard for each heavy text, the largest first to the emptiest (None: fits in none), and the room left."""
    free = [(-total / shards, shard) for shard in range(shards)]
    homes: dict[str, int | None] = {}
    for k, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        room, shard = free[0]
        fits = size <= -room
        homes[k] = shard if fits else None
        if fits:
            heapq.heapreplace(free, (room + size, shard))
    return homes, [-room for room, _ in sorted(free, key=lambda x: x[1])]


def _exchange(keyed: DataFrame, leaves: dict[str, tuple[int, int, int]], shard_at: Callable[[float], int], shards: int) -> DataFrame:
    ordered, done = [], dict.fromkeys(range(shards), 0)
    for cell, (start, size, n) in sorted(leaves.items(), key=lambda x: x[1][0]):
        shard = shard_at(2 * start + size) % shards
        ordered.append((cell, shard, done[shard]))
        done[shard] += n
    spark = keyed.sparkSession
    table = spark.createDataFrame(ordered, "cell string, shard int, base long")
    widths = sorted({len(c) for c, _, _ in ordered})
    # the cells don't overlap: of a row's prefixes exactly one is a cell
    found = keyed.withColumn("cell", F.explode(F.array(*[F.substring("key", 1, w) for w in widths] or [F.lit("")]))).join(F.broadcast(table), "cell")
    place = F.row_number().over(W.partitionBy("cell").orderBy("key", F.col("doc_id").asc_nulls_first()))
    return found.select("*", (F.col("base") + place - 1).alias("slot")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
