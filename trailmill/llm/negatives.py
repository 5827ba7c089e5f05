"""Hard negatives by bit-sliced integer products.

Components are integers in two's complement, cut into planes of one bit each. A row's product with an anchor is
built from its most significant plane down; what the planes left can still add lies between two sums of the anchor's
components, so the score has an interval that halves with each plane. A pair of anchor and row is dropped as soon as
its interval can't reach what the anchor still looks for, and after the last plane the scores of the others are exact.

Anchors are a stated share of the rows. Blocks of them meet blocks of rows, both dealt out by hash, so no label, copy
or source makes a block larger than another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.shared import written
from trailmill.llm import vectors

SCALE, ANCHOR_EVERY, FLIP_EVERY, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these percentages of the positive's.
LEAST, MOST = 30, 90
#: Anchors and rows of a block, and rows and pairs that are worked on at once.
ANCHORS, ROWS, CHUNK = 2048, 16384, 2048
#: Below this share of pairs left, the next planes are read pair by pair.
SPARSE = 1 / 16
PAIRS = 1 << 16


def usable(rows: DataFrame, every: int = FLIP_EVERY) -> DataFrame:
    """(vec_id, label, vec) of embeddings(vec_id, embedding, label): integers, and labels moved where vec_id is divisible by `every`.

    Rows with a null vec_id, label or vector, or with a component that is null or not finite, are left out; so are
    those whose products wouldn't fit in 62 bits. Of rows with one vec_id the least label, then vector, stands.
    """
    x = F.col("embedding").cast("array<double>")
    largest = F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0)) * SCALE + 1
    good = rows.filter("vec_id is not null and label is not null").filter(vectors.finite("embedding")).filter(largest * largest * F.size(x) < float(1 << 62))
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    told = good.select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("int").alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("vec"))
    return told.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def planes(rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(weight, largest sum of the planes below, bits) of each plane of integers, the most significant first."""
    bits = 1
    while (rows < -(1 << (bits - 1))).any() or (rows >= 1 << (bits - 1)).any():
        bits += 1
    for k in range(bits - 1, -1, -1):
        yield (-1 if k == bits - 1 else 1) << k, (1 << k) - 1, (rows >> k) & 1


def sliced(anchors: np.ndarray, rows: np.ndarray, eligible: np.ndarray, floor: np.ndarray, ceiling: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the eligible pairs whose score is from floor[anchor] to ceiling[anchor], exactly.

    With `most`, pairs that `most` others of their anchor beat are dropped, too: the most-th highest lower bound
    raises the floor.
    """
    low, high = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
    exact = np.float64 if float(np.abs(anchors).sum(1).max(initial=0)) * float(np.abs(rows).max(initial=0) + 1) < 1 << 52 else np.int64
    narrow = np.float32 if np.abs(anchors).sum(1).max(initial=0) < 1 << 23 else np.float64
    left, floor = anchors.astype(narrow), floor.astype(exact)
    alive, total = eligible.copy(), np.zeros((len(anchors), len(rows)), exact)
    at = np.arange(len(rows))  # rows that some anchor still looks at
    pairs = None
    for weight, rest, bits in planes(rows):
        if pairs is None:
            total += ((left @ bits[at].T.astype(narrow)).astype(exact)) * exact(weight)
            if most and total.shape[1] >= most and rest * int(np.max(high - low, initial=0)) < 1 << 62:
                lower = np.where(alive, total + (rest * low)[:, None].astype(exact), np.iinfo(np.int64).min // 2)
                floor = np.maximum(floor, np.partition(lower, -most, axis=1)[:, -most])
            alive &= total + (rest * high)[:, None].astype(exact) >= floor[:, None]
            if ceiling is not None:
                alive &= total + (rest * low)[:, None].astype(exact) <= ceiling.astype(exact)[:, None]
            if alive.mean() < SPARSE if alive.size else True:
                a, r = np.nonzero(alive)
                pairs = [a, at[r], total[a, r]]
            elif not (some := alive.any(0)).all():
                at, alive, total = at[some], alive[:, some], total[:, some]
        else:
            a, r, sums = pairs
            add = np.concatenate([np.zeros(0, exact), *(np.where(bits[r[k : k + PAIRS]] > 0, anchors[a[k : k + PAIRS]], 0).sum(1).astype(exact) for k in range(0, len(a), PAIRS))])
            sums = sums + add * exact(weight)
            keep = sums + (rest * high)[a].astype(exact) >= floor[a]
            if ceiling is not None:
                keep &= sums + (rest * low)[a].astype(exact) <= ceiling.astype(exact)[a]
            pairs = [a[keep], r[keep], sums[keep]]
    if pairs is None:
        a, r = np.nonzero(alive)
        pairs = [a, at[r], total[a, r]]
    return pairs[0], pairs[1], pairs[2].astype(np.int64)


def _held(table: pa.Table, name: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return table.column(name + "vec_id").to_numpy(), table.column(name + "label").to_numpy(), vectors.matrix(table.column(name + "vec"), np.int64)


def _positives(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best rows of a block for each anchor of a block, of its label."""
    (ids, labels, x), (names, marks, y) = _held(left), _held(right, "row_")
    x, y = vectors.same_width(x, y)
    out = [[np.zeros(0, np.int64)] * 3]
    for label in np.unique(labels):
        own, theirs = np.flatnonzero(labels == label), np.flatnonzero(marks == label)
        found = [np.zeros(0, np.int64)] * 3  # anchor's place in `own`, name, score
        floor = np.full(len(own), np.iinfo(np.int64).min // 2)
        for k in range(0, len(theirs), CHUNK):
            part = theirs[k : k + CHUNK]
            a, r, score = sliced(x[own], y[part], ids[own][:, None] != names[part][None, :], floor, most=POSITIVES)
            found = [np.concatenate(z) for z in zip(found, (a, names[part[r]], score), strict=True)]
            found = [z[vectors.best(found[0], found[2], found[1], POSITIVES)] for z in found]
            full = np.bincount(found[0], minlength=len(own)) >= POSITIVES
            worst = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(worst, found[0], found[2])
            floor[full] = worst[full]
        out.append([ids[own[found[0]]], found[1], found[2]])
    return pa.table([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], names=["anchor_id", "positive_id", "positive_score"])


def _negatives(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best rows of a block for each anchor and positive of a block, of other labels and within bounds."""
    (ids, labels, x), (names, marks, y) = _held(left), _held(right, "row_")
    x, y = vectors.same_width(x, y)
    wins = left.column("wins").combine_chunks()
    score = vectors.matrix(wins.__class__.from_arrays(wins.offsets, wins.values.field("positive_score")), np.int64)
    goal = vectors.matrix(wins.__class__.from_arrays(wins.offsets, wins.values.field("positive_id")), np.int64)
    here = np.arange(score.shape[1])[None, :] < wins.value_lengths().to_numpy()[:, None]
    bottom, top = -((-LEAST * score) // 100), MOST * score // 100
    here &= bottom <= top
    span = np.iinfo(np.int64).max // 2
    found = [np.zeros(0, np.int64)] * 3  # anchor and positive as one number, name, score
    slots, need = score.shape[1], np.where(here, bottom, span)
    ceiling = np.where(here, top, -span).max(1, initial=-span)
    asked = np.flatnonzero(here.any(1))
    for k in range(0, len(y), CHUNK):
        part = slice(k, k + CHUNK)
        a, r, s = sliced(x[asked], y[part], labels[asked][:, None] != marks[part][None, :], need[asked].min(1, initial=span), ceiling[asked])
        a = asked[a]
        fits = here[a] & (s[:, None] >= need[a]) & (s[:, None] <= top[a])
        pair, slot = np.nonzero(fits)
        found = [np.concatenate(z) for z in zip(found, (a[pair] * slots + slot, names[part][r[pair]], s[pair]), strict=True)]
        found = [z[vectors.best(found[0], found[2], found[1], NEGATIVES)] for z in found]
        full = np.flatnonzero(np.bincount(found[0], minlength=need.size) >= NEGATIVES)
        worst = np.full(need.size, span)
        np.minimum.at(worst, found[0], found[2])
        need.flat[full] = worst[full]
    a, slot = found[0] // max(slots, 1), found[0] % max(slots, 1)
    return pa.table([pa.array(z) for z in (ids[a], goal[a, slot], score[a, slot], found[1], found[2])], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _met(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int], run: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """`run` of each block of anchors and each block of rows."""
    a, r = max(1, -(-counts[0] // ANCHORS)), max(1, -(-counts[1] // ROWS))
    left, right = vectors.dealt(anchors, "vec_id", "a_block", a, "r_block", r), vectors.dealt(rows.select(*(F.col(c).alias("row_" + c) for c in rows.columns)), "row_vec_id", "r_block", r, "a_block", a)
    return left.groupBy("a_block", "r_block").cogroup(right.groupBy("a_block", "r_block")).applyInArrow(run, ddl)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of embeddings(vec_id, embedding, label).

    Anchors are rows whose vec_id is divisible by 100, their positives the first 5 other rows of their label by score,
    ties by vec_id. For each positive come the first 10 rows of other labels whose score is from 30 to 90 percent of
    the positive's; for a negative positive_score there are none. Which rows take part is said in `usable`. Shorter
    vectors count as filled up with zeros; copies under other ids are rows like others; an anchor without another row
    of its label or without a fitting negative has no row. Other columns are ignored; an empty table gives an empty
    table.
    """
    rows = written(usable(embeddings), "negatives-rows")
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0)
    counts = tuple(rows.agg(F.count_if(F.col("vec_id") % ANCHOR_EVERY == 0), F.count("*")).first())
    some = _met(anchors, rows, counts, _positives, "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    won = some.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= POSITIVES)
    # at most 5 of an anchor are left
    wins = written(won.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("wins")), "negatives-positives")
    near = _met(anchors.join(wins, "vec_id"), rows, counts, _negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256*cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as alike, cast(list_inner_product(a.v, r.v) as bigint) as score
  from good a join good r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id),
positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from pair where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
from positive join pair using (anchor_id) where not alike and 30*positive_score <= 100*score and 100*score <= 90*positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10"""
