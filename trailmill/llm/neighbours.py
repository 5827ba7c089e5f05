"""Approximate nearest neighbours by largest inner product, with an adaptive scan over dimensions.

Each vector gets one more component, so that all are equally long: the largest inner product is then the least
distance to the query, whose own further component is zero. Rows lie in lists around centres that are fitted on a
bounded sample; every row is in a list. All vectors are turned by one random rotation and held in blocks of columns.
A query scans its nearest lists block after block: what it has seen of a distance estimates the whole, and a
candidate is given up as soon as a test says that it is farther than the best found so far. Scores of those that
stay are inner products of the original vectors.

How many lists are probed is measured on the sample. Lists are packed into groups of bounded size, larger lists cut by
hash, so that copies of one vector don't make a task larger than another, and a query's vector goes once to a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.shared import written
from trailmill.llm import textkit as tk
from trailmill.llm import vectors

EVERY, NEAREST = 20, 20
#: Rows and bytes of the sample that centres are fitted on and probes are measured on, rows for a query's first bound.
SAMPLE, SAMPLE_BYTES, PILOT = 16_384, 32 << 20, 2048
LISTS, ROUNDS = 1024, 8
#: Share of the sample's neighbours that the probed lists must hold, of so many of its queries.
AIM, TRIED = 0.95, 256
#: Rows and queries of a group, columns of a block, and how sure the test is.
ROWS, QUERIES, COLUMNS, SURE = 16_384, 2048, 16, 2.1
#: Below this share of pairs left, the next columns are read pair by pair.
SPARSE = 1 / 8
SEED = 20240229


class Space:
    """The turned space: what scales, lengthens and rotates vectors."""

    def __init__(self, wide: int, top: float, longest: float) -> None:
        self.wide, self.top, self.longest = wide, top, longest
        turn, upper = np.linalg.qr(np.random.default_rng(SEED).normal(size=(wide + 1, wide + 1)))
        self.turn = (turn * np.sign(np.diag(upper))).astype(np.float32)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.wide - x.shape[1]))) if x.shape[1] < self.wide else x

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = self.padded(x) / self.top
        return np.hstack((x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))[:, None])).astype(np.float32) @ self.turn

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack((self.padded(x) / self.top, np.zeros((len(x), 1)))).astype(np.float32) @ self.turn

    def distance(self, queries: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distances of the turned space from inner products of the original vectors."""
        return ((self.padded(queries) / self.top) ** 2).sum(1) + self.longest - 2 * (score / self.top / self.top)


def fitted(x: np.ndarray, lists: int) -> np.ndarray:
    """Centres of `lists` lists of turned rows."""
    centres = x[np.random.default_rng(SEED).permutation(len(x))[:lists]].astype(np.float64)
    for _ in range(ROUNDS):
        own = nearest(x, centres, 1)[:, 0]
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres.astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The `most` nearest centres of each vector, nearest first, ties to the first."""
    out = np.zeros((len(x), most), np.int64)
    for k in range(0, len(x), 4096):
        far = (centres * centres).sum(1) - 2 * (x[k : k + 4096] @ centres.T)
        out[k : k + 4096] = far.argmin(1)[:, None] if most == 1 else np.argsort(far, 1, kind="stable")[:, :most]
    return out


def probes_for(x: np.ndarray, queries: np.ndarray, own: np.ndarray, centres: np.ndarray) -> int:
    """How many nearest lists hold AIM of the sample's nearest rows of its first queries (at places 0, 1, ...)."""
    far = (x * x).sum(1) - 2 * (queries @ x.T)
    far[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    best = np.argpartition(far, min(NEAREST, len(x) - 1), 1)[:, :NEAREST]
    order = nearest(queries, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(order), 0), 1)
    needed = np.sort(np.take_along_axis(place, own[best], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(AIM * len(needed)))]) + 1


def scanned(queries: np.ndarray, blocks: list[np.ndarray], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs whose squared distance may be within the query's `limit`; others are given up on the way.

    After d of D columns a pair is given up where its distance so far, times D / d, is over the limit times
    (1 + SURE / sqrt(d))**2, as a rotated difference is spread over the columns evenly.
    """
    wide, seen, sums, pairs = queries.shape[1], 0, None, None
    for x in blocks:
        q = queries[:, seen : seen + x.shape[1]]
        seen += x.shape[1]
        slack = (1 + SURE / math.sqrt(seen)) ** 2 * seen / wide if seen < wide else 1.0
        bound = (limit * slack * (1 + 1e-5) + 1e-6).astype(np.float32)
        if pairs is None:
            part = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
            sums = part if sums is None else sums + part
            alive = sums <= bound[:, None]
            if seen == wide or np.count_nonzero(alive) < SPARSE * alive.size:
                a, r = np.nonzero(alive)
                pairs = a, r, sums[a, r]
        else:
            a, r, so_far = pairs
            so_far = so_far + ((q[a] - x[r]) ** 2).sum(1)
            keep = so_far <= bound[a]
            pairs = a[keep], r[keep], so_far[keep]
    return pairs[0], pairs[1]


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows and rows, each summed alone, so that equal vectors have equal scores."""
    return np.concatenate([np.zeros(0), *((x[k : k + 8192] * y[k : k + 8192]).sum(1) for k in range(0, len(x), 8192))])


def _search(space: Space):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        x, y = (space.padded(vectors.matrix(t.column(c), np.float64)) for t, c in ((left, "query"), (right, "vec")))
        limit, own = left.column("bound").to_numpy().copy(), right.column("list").to_numpy()
        asked = left.column("lists").combine_chunks()
        who, where = np.repeat(np.arange(len(ids)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()
        turned, rows = space.queries(x), space.rows(y)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query's place, name, score
        for one in np.unique(where):
            q, at = who[where == one], np.flatnonzero(own == one)
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                blocks = [np.ascontiguousarray(rows[part, c : c + COLUMNS]) for c in range(0, rows.shape[1], COLUMNS)]
                for j in range(0, len(q), 512):
                    some = q[j : j + 512]
                    a, r = scanned(turned[some], blocks, limit[some])
                    a, r = some[a], part[r]
                    other = ids[a] != names[r]
                    a, r = a[other], r[other]
                    found = [np.concatenate(z) for z in zip(found, (a, names[r], _products(x[a], y[r])), strict=True)]
            found = [z[vectors.best(found[0], found[2], found[1], NEAREST)] for z in found]
            full = np.flatnonzero(np.bincount(found[0], minlength=len(ids)) >= NEAREST)
            worst = np.full(len(ids), np.inf)
            np.minimum.at(worst, found[0], found[2])
            limit[full] = np.minimum(limit[full], space.distance(x[full], worst[full]))
        return pa.table([pa.array(z) for z in (ids[found[0]], found[1], found[2])], names=["query_id", "vec_id", "score"])

    return run


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vec) of embeddings(vec_id, embedding): vectors that are not null or zero and have finite components only.

    A null vec_id takes no part; of rows with one vec_id the least vector stands.
    """
    x = F.col("embedding").cast("array<double>")
    good = rows.filter("vec_id is not null").filter(vectors.finite("embedding")).filter(F.exists(x, lambda v: v != 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _packed(sizes: dict[int, int]) -> tuple[dict[int, range], int]:
    """The groups that each list's rows are dealt out to, and how many groups there are."""
    out, group, room = {}, -1, 0
    for one, n in sorted(sizes.items()):
        blocks = -(-n // ROWS)
        if blocks > 1:
            out[one], group, room = range(group + 1, group + 1 + blocks), group + blocks, 0
            continue
        if n > room:
            group, room = group + 1, ROWS
        out[one], room = range(group, group + 1), room - n
    return out, group + 1


def nearest_neighbours(embeddings: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score) of embeddings(vec_id, embedding): the NEAREST rows found for each query.

    Queries are the rows whose vec_id is divisible by EVERY; all other rows and queries are their candidates. Nearest is
    the largest inner product in double precision, nearest first, ties to the smaller vec_id; a query has fewer rows only
    where the table has no more. Which rows take part is said in `usable`; shorter vectors count as filled up with zeros;
    copies under other ids are rows like others. Other columns are ignored; an empty table gives an empty table.
    """
    spark, schema = embeddings.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = written(usable(embeddings), "neighbours-rows")
    count, wide, top = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda v: F.abs(v))))).first()
    if not count:
        return spark.createDataFrame([], schema)
    longest = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + (v / F.lit(top)) * (v / F.lit(top))))).first()[0]
    space = Space(wide, top, longest)
    # rows below a bound on their hash: about as many as wanted, whatever the partitions, and never over twice that
    want = min(SAMPLE, SAMPLE_BYTES // (8 * wide))
    lot = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    held = rows.filter(lot < math.ceil((1 << 40) * min(1.0, want / count))).limit(2 * want).toArrow().sort_by("vec_id") if want < count else rows.toArrow().sort_by("vec_id")
    names, known = held.column("vec_id").to_numpy(), space.padded(vectors.matrix(held.column("vec"), np.float64))
    turned = space.rows(known)
    centres = fitted(turned, max(1, min(LISTS, math.isqrt(count), len(turned))))
    probes = probes_for(turned, space.queries(known[:TRIED]), nearest(turned, centres, 1)[:, 0], centres)
    pilot_names, pilot = names[:PILOT], known[:PILOT]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = nearest(space.rows(vectors.matrix(batch.column("vec"), np.float64)), centres, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(own.astype(np.int32))], ["vec_id", "vec", "list"])

    index = written(rows.mapInArrow(tk.lean(listed), "vec_id long, vec array<double>, list int"), "neighbours-index")
    sizes = {r[0]: r[1] for r in index.groupBy("list").count().collect()}  # LISTS rows at most
    groups, n_groups = _packed(sizes)
    filled = np.array([sizes.get(k, 0) for k in range(len(centres))])

    def piloted(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.where(ids[:, None] == pilot_names[None, :], -np.inf, x @ pilot.T)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the pilot's rows those that a query's bound comes from: they are found, whatever lists they are in."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, x = part.column("vec_id").to_numpy(), space.padded(vectors.matrix(part.column("vec"), np.float64))
                best = np.argpartition(piloted(ids, x), -NEAREST, 1)[:, -NEAREST:].ravel()
                who = np.repeat(np.arange(len(ids)), NEAREST)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(pilot_names[best]), pa.array(_products(x[who], pilot[best]))], ["query_id", "vec_id", "score"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, x = part.column("vec_id").to_numpy(), space.padded(vectors.matrix(part.column("vec"), np.float64))
                bound = np.full(len(ids), np.inf)
                if len(pilot) > NEAREST:
                    bound = space.distance(x, np.partition(piloted(ids, x), -NEAREST, 1)[:, -NEAREST]) * (1 + 1e-6) + 1e-9
                order = nearest(space.queries(x), centres, len(centres))
                # on to further lists where the probed ones have too few rows
                use = np.maximum(probes, (np.cumsum(filled[order], 1) <= NEAREST).sum(1) + 1)
                out: list[tuple[int, int, list[int]]] = []
                for k in range(len(ids)):
                    goes: dict[int, list[int]] = {}
                    for one in order[k, : use[k]].tolist():
                        for g in groups.get(one, ()):
                            goes.setdefault(g, []).append(one)
                    out += [(k, g, own) for g, own in goes.items()]
                k, g, own = zip(*out, strict=True) if out else ((), (), ())
                k = pa.array(k, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(k), part.column("vec").take(k), pa.array(bound).take(k), pa.array(g, pa.int32()), pa.array(own, pa.list_(pa.int32()))], ["query_id", "query", "bound", "q_group", "lists"])

    chosen, found = rows.filter(F.col("vec_id") % EVERY == 0), "query_id long, vec_id long, score double"
    queries = chosen.mapInArrow(tk.lean(asked), "query_id long, query array<double>, bound double, q_group int, lists array<int>")
    q_blocks = max(1, -(-chosen.count() // QUERIES))
    queries = queries.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
    places = spark.createDataFrame([(one, own.start, len(own)) for one, own in groups.items()], "list int, first int, parts int")
    # LISTS rows at most are broadcast
    dealt = index.join(F.broadcast(places), "list").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")).select("vec_id", "vec", "list", "group", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("block"))
    near = queries.groupBy("q_group", "q_block").cogroup(dealt.groupBy("group", "block")).applyInArrow(_search(space), found)
    if len(pilot) > NEAREST:
        near = near.unionAll(chosen.mapInArrow(tk.lean(first), found)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")
