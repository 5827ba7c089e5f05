"""N-gram Jaccard join by universe partition and pigeonhole.

Two sets of sizes a and b with a Jaccard similarity of t or more differ in at most (1 - t) / (1 + t) * (a + b)
shingles. Sets of like size (a scheme: one size band, or two neighbouring ones) have the universe of
shingle hashes cut into the same segments. A segment with allowance 0 is indexed by its subset, one with
allowance 1 by its subset and all that leave out one shingle (the one-deletion neighbourhood). Where
allowances plus segments exceed the largest difference, linked sets share an index entry. How many
segments get allowance 1 is the cheapest choice for the scheme's sizes.

Entries that don't tell sets apart are not compared all with all: empty subsets aren't indexed at all,
and entries shared by many sets of different components are set aside. Each scheme has spare credits for
that; the sets that lose more than these are joined by their rarest shingles instead, of which two linked
sets must share one. So no link is lost.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmill.functions.shared import written
from trailmill.llm import textkit as tk
from trailmill.operators.components import connected_components

WIDTH, SHARE = 5, 80
#: An entry that more components share, or that would give more pairs of sets, is set aside.
HOT, HOT_PAIRS = 24, 2000
#: Sizes of a band, in percent of its first.
STEP = 150
#: Low bits of an entry: its scheme, and whether its segment has allowance 1.
SCHEME_BITS, TAG_BITS = 10, 11
SLACK = 1 << 40
BROADCAST_ROWS = 2_000_000
#: Keys that a task remembers in order not to index a set twice; only saves work.
SEEN = 200_000
#: Bytes of texts that are cut into shingles at once.
PIECE = 1 << 19


@functools.cache
def bands(share: int, largest: int) -> tuple[int, ...]:
    """First sizes of the size bands. A band spans at least the sizes that may be similar, so similar sets are
    in the same band or in neighbouring ones; wider bands have looser bounds, narrower ones more schemes."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(100 * out[-1] // share + 1, out[-1] * STEP // 100))
    return tuple(out)


@functools.cache
def allocation(largest: int, share: int, least: int) -> tuple[int, int, int]:
    """(segments, how many of them have allowance 1, spare credits) for pairs that differ in up to `largest`.

    The cost is that of the entries of a set of `least` shingles, the sets that must be cut again, and the
    chance that subsets are too small to tell sets apart.
    """
    best = (math.inf, 1, 1, 0)
    need = largest + 1
    # large sets have segments enough: there only the spare credits are chosen
    for spare in range(need // 16 + (need > 4), 12 + need // 2, 1 + need // 64):
        for ones in (0,) if need > 40 else range((need + spare) // 2 + 1):
            segments = need + spare - ones
            if segments < max(ones, 1):
                continue
            size = least / segments
            empty = segments * (1 - 1 / segments) ** least * (1 + ones / segments) + ones * size * math.exp(-size)
            tail = 0.0 if empty == 0 else min(1.0, math.exp(-((max(spare + 1 - empty, 0)) ** 2) / (2 * (empty + (spare + 1 - empty) / 3 + 1e-9)))) if spare + 1 > empty else 1.0
            entries = segments + ones * size
            cost = entries * (1 + 6 * math.exp(-1.2 * size)) + 3 * tail * (entries + least)
            best = min(best, (cost, segments, ones, spare))
    return best[1:]


def schemes_of(size: np.ndarray, share: int) -> list[tuple[int, np.ndarray, int, int, int]]:
    """(scheme, rows, segments, ones, spare) for all schemes that sets of these sizes take part in."""
    starts = np.array(bands(share, int(size.max(initial=1))))
    band = np.searchsorted(starts, size, side="right") - 1
    out = []
    for b in np.unique(band[size > 0]).tolist():
        lo, hi = int(starts[b]), int(starts[b + 1]) - 1
        mine = np.flatnonzero((band == b) & (size > 0))
        out.append((2 * b, mine, *allocation((100 - share) * 2 * hi // (100 + share), share, lo)))
        for k, rows in ((b, mine), (b + 1, mine)):  # scheme 2 k - 1: bands k - 1 and k
            if k == 0:
                continue
            first = int(starts[k]) if k < len(starts) else hi + 1
            small_hi = first - 1
            big_hi = 100 * small_hi // share
            fits = size[rows] <= big_hi if k == b else 100 * size[rows] >= share * first
            low = share * first // 100
            out.append((2 * k - 1, rows[fits], *allocation((100 - share) * (small_hi + big_hi) // (100 + share), share, max(low, 1))))
    return [x for x in out if len(x[1])]


def entries(values: np.ndarray, bounds: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(entry, row) of ascending sets, and (row, scheme, spare credits that empty subsets leave it).

    An entry's low bits are its scheme and allowance.
    """
    size = np.diff(bounds)
    out_sig, out_row, slack = [], [], []
    for scheme, rows, segments, ones, spare in schemes_of(size, share):
        n = size[rows]
        heads = np.concatenate(([0], np.cumsum(n)[:-1]))
        inner = np.arange(int(n.sum())) - np.repeat(heads, n)
        h = values[np.repeat(bounds[rows], n) + inner]
        owner = np.repeat(np.arange(len(rows)), n)
        with np.errstate(over="ignore"):
            part = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
            cell = owner * segments + part
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            values_mixed = tk.mix64(h ^ tk.MIX[12])
            total = np.add.reduceat(values_mixed, first)
            length = np.diff(np.append(first, len(cell)))
            where, seg = owner[first], part[first]
            tag = np.uint64(scheme + 1) * tk.MIX[10] + seg.astype(np.uint64) * tk.MIX[11]
            wide = seg < ones
            flag = lambda x, w: x >> np.uint64(TAG_BITS) << np.uint64(TAG_BITS) | np.uint64(scheme % (1 << SCHEME_BITS)) | np.asarray(w).astype(np.uint64) << np.uint64(SCHEME_BITS)  # noqa: B023, E731
            sig, sig_row = [flag(tk.mix64(total ^ tag), wide)], [where]
            deletable = wide & (length > 1)
            if deletable.any():
                runs = length[deletable]
                spread = np.repeat(np.flatnonzero(deletable), runs)
                at = np.repeat(first[deletable] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(len(spread))
                sig.append(flag(tk.mix64((total[spread] - values_mixed[at]) ^ tag[spread]), True))
                sig_row.append(where[spread])
            # credits that only empty subsets could redeem
            full = np.bincount(where, 1 + wide, len(rows))
            left = (spare - (segments + ones - full) - np.bincount(where, wide & (length == 1), len(rows))).astype(np.int64)
        out_sig.append(np.concatenate(sig))
        out_row.append(rows[np.concatenate(sig_row)])
        slack += [(r, scheme, x) for r, x in zip(rows.tolist(), left.tolist(), strict=True)]
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), slack
    return np.concatenate(out_sig), np.concatenate(out_row), slack


def set_keys(values: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of each set, equal for equal sets."""
    n = np.diff(bounds)
    out = np.zeros(len(n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(values):
            out[n > 0] = np.add.reduceat(tk.mix64(values ^ (tk.MIX[8] + np.uint64(seed) * tk.MIX[9])), bounds[:-1][n > 0])
        return tk.mix64(out + n.astype(np.uint64) * tk.MIX[7]).view(np.int64)


def parities(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set, whether an odd number of its shingles falls in each of 2**k cells, 64 to a word; and bounds of the words.

    2**k is the least power of two from the set's size on, 64 at least. Where two sets have d such bits that
    differ, they differ in d shingles or more. Half as many cells are had by xor of both halves.
    """
    n = np.diff(bounds)
    words = np.where(n > 0, np.maximum(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64) // 64, 0)
    starts = np.concatenate(([0], np.cumsum(words)))
    cell = (tk.mix64(values ^ tk.MIX[13]) & (np.repeat(words, n) * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(cell + np.repeat(starts[:-1] * 64, n), minlength=int(starts[-1]) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"), starts


def _describe(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tk.blocks(batch, "text", PIECE):
                values, bounds = tk.shingle_sets(data, offsets, WIDTH)
                bits, starts = parities(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(np.diff(bounds)), pa.array(set_keys(values, bounds, seed)), pa.array(set_keys(values, bounds, seed + 1)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(bits))],
                    ["doc_id", "text_key", "n", "key", "second", "bits"])

    return run


def close(a: str, b: str, share: int) -> Column:
    """Whether two sets may be linked by their sizes n and parities `bits`, columns with suffixes `a` and `b`; false only where they can't be."""
    na, nb, xa, xb = F.col("n" + a), F.col("n" + b), F.col("bits" + a), F.col("bits" + b)
    k = F.least(F.size(xa), F.size(xb))
    xor = lambda p, q: p.bitwiseXOR(q)
    fold = lambda x: F.when(F.size(x) > k, F.zip_with(F.slice(x, 1, k), F.slice(x, k + 1, k), xor)).otherwise(x)
    differ = F.aggregate(F.zip_with(fold(xa), fold(xb), xor), F.lit(0), lambda total, w: total + F.bit_count(w))
    like = 100 * F.least(na, nb) >= share * F.greatest(na, nb)
    return like & ((100 + share) * differ <= (100 - share) * (na + nb))


def _index(share: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in tk.blocks(batch, "text", PIECE):
                values, bounds = tk.shingle_sets(data, offsets, WIDTH)
                keys, size = set_keys(values, bounds, seed), np.diff(bounds)
                fresh = np.zeros(len(keys), dtype=bool)
                for k, key in enumerate(keys.tolist()):
                    if key not in seen:
                        fresh[k] = True
                        seen.add(key)
                if len(seen) > SEEN:
                    seen.clear()
                values, bounds, keys = values[np.repeat(fresh, size)], np.concatenate(([0], np.cumsum(size[fresh]))), keys[fresh]
                sig, row, slack = entries(values, bounds, share)
                notes = np.array([(x + SLACK) << SCHEME_BITS | scheme for _, scheme, x in slack], dtype=np.int64)
                of = keys[[r for r, _, _ in slack]] if slack else keys[:0]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((sig.view(np.int64), notes))), pa.array(np.concatenate((keys[row], of))),
                                                  pa.array(np.concatenate((np.zeros(len(sig), bool), np.ones(len(notes), bool))))], ["sig", "key", "note"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, key): those whose sig has two keys or more, with the key before; and notes.

    Notes, the spare credits of a key in a scheme, only pass through.
    """
    held = None  # the last row so far: whether it belongs to a group is known with the next one

    def emit(sig, key, prev, keep, note):
        return pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(key[keep]), pa.array(prev[0][keep], mask=~prev[1][keep]), pa.array(note[keep])], ["sig", "key", "prev", "note"])

    for batch in batches:
        sig, key, note = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "key", "note"))
        prev, has = np.zeros(len(sig), np.int64), np.zeros(len(sig), bool)
        if held is not None:
            sig, key, note, prev, has = (np.concatenate(x) for x in zip(held, (sig, key, note, prev, has), strict=True))
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]) | (note[1:] != note[:-1])
        sig, key, note, prev, has = sig[new], key[new], note[new], prev[new], has[new]
        same = (sig[1:] == sig[:-1]) & ~note[1:] & ~note[:-1]
        prev[1:] = np.where(same, key[:-1], prev[1:])
        has[1:] |= same
        member = has.copy()
        member[:-1] |= same
        keep = member | note
        held = tuple(x[-1:] for x in (sig, key, note, prev, has))
        if len(sig) > 1:
            yield emit(sig[:-1], key[:-1], (prev[:-1], has[:-1]), keep[:-1], note[:-1])
    if held is not None:
        sig, key, note, prev, has = held
        yield emit(sig, key, (prev, has), has | note, note)


def _tokens(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in tk.blocks(batch, "text", PIECE):
                values, bounds = tk.shingle_sets(data, offsets, WIDTH)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(set_keys(values, bounds, seed), n)), pa.array(np.repeat(n, n)), pa.array(values.view(np.int64))], ["key", "n", "h"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([zlib.compress(t.as_py().encode(), 1) for t in batch.column("text")], pa.binary())], ["key", "z"])


def _verify(share: int):
    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return tk.shingle_sets(*tk.buffers(pa.array([zlib.decompress(z.as_py()).decode() for z in column], pa.large_string())), WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                left, right = batch.column("ka").to_numpy(), batch.column("kb").to_numpy()
                # rows come sorted by kb, so its sets are read once for a run of rows
                _, one, back = np.unique(right, return_index=True, return_inverse=True)
                a, b = sets(batch.column("za")), sets(batch.column("zb").take(pa.array(one)))
                good = np.zeros(batch.num_rows, dtype=bool)
                for k in range(batch.num_rows):
                    x, y = a[0][a[1][k] : a[1][k + 1]], b[0][b[1][back[k]] : b[1][back[k] + 1]]
                    if not len(x) or not len(y):
                        continue
                    at_y = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at_y] == x).sum())
                    good[k] = 100 * both >= share * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([pa.array(left[good]), pa.array(right[good])], ["ka", "kb"])

    return run


def fresh(docs: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `docs` has it in any spelling."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _few(df: DataFrame) -> DataFrame:
    """Broadcast only what is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _lacking(texts: DataFrame, parts: DataFrame, sketches: DataFrame, share: int, seed: int) -> DataFrame:
    """Pairs of sets of different components that can be linked, of the sets that lack credits.

    With shingles in one order, the rarest first, take the first that two linked sets share. What follows it
    must hold all the rest of their overlap, so it stands early in both: within the first (1 - t) / (1 + t)
    of the smaller set and the first 1 - t of the larger, and only these are joined, with sizes, places and
    parities in the join's condition.
    """
    tokens = written(texts.select("text").mapInArrow(tk.lean(_tokens(seed)), "key long, n long, h long"), "jaccard-tokens")
    placed = tokens.join(_few(parts.withColumnRenamed("node", "key")), "key", "left").select("key", "n", "h", F.coalesce("component", "key").alias("part"))
    holders = W.partitionBy("h")  # of the lacking sets alone; what exceeds memory is spilled
    spread = placed.withColumns({"df": F.count("*").over(holders), "open": F.min("part").over(holders) != F.max("part").over(holders)})
    ranked = spread.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("df", "h")))
    early = written(ranked.filter("open").filter(100 * (F.col("r") - 1) <= (100 - share) * F.col("n")).select("h", "key", "part", "n", "r"), "jaccard-early")
    early = early.join(sketches.select("key", "bits"), "key")
    x = early.filter((100 + share) * (F.col("r") - 1) <= (100 - share) * F.col("n")).select("h", *(F.col(c).alias(c + "a") for c in ("key", "part", "n", "r", "bits")))
    y = early.select("h", *(F.col(c).alias(c + "b") for c in ("key", "part", "n", "r", "bits")))
    room = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + 1
    found = x.join(y, "h").filter((F.col("parta") != F.col("partb")) & (F.col("na") <= F.col("nb")) & ((100 + share) * room >= share * (F.col("na") + F.col("nb"))) & close("a", "b", share))
    return found.select(F.least("keya", "keyb").alias("ka"), F.greatest("keya", "keyb").alias("kb")).distinct()


def _linked(docs: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n, key) of all rows, and (key, part, component_id) of the sets that several rows have or that are linked.

    key names a set, part a component of sets; component_id is its least doc_id.
    """
    source = tk.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    for seed in range(0, 64, 2):
        meta = written(source.mapInArrow(tk.lean(_describe(seed)), "doc_id long, text_key long, n long, key long, second long, bits array<long>"), "jaccard-meta")
        # one text stands for each set; copies never enter the search
        classes = meta.filter("n > 0").groupBy("key").agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), F.any_value("bits").alias("bits"), (F.min("second") != F.max("second")).alias("mixed"))
        classes = written(classes, "jaccard-classes")
        if classes.filter("mixed").isEmpty():  # else two sets got one name
            break
    else:
        raise RuntimeError("no names tell the sets apart")
    sketches = classes.select("key", "n", "bits")
    wanted_texts = lambda keys: classes.join(_few(keys), "key", "left_semi").select("key", "text_key")

    def texts_of(keys: DataFrame) -> DataFrame:
        """(key, text) once for each key; equal texts of one key are interchangeable."""
        chosen = _few(written(wanted_texts(keys), "jaccard-chosen"))
        return source.select("text_key", "text").join(chosen, "text_key").dropDuplicates(["key"]).select("key", "text")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are linked: by their parities first, which only rule out, then by their shingles."""
        side = lambda k: sketches.select(F.col("key").alias("k" + k), F.col("n").alias("n" + k), F.col("bits").alias("bits" + k))
        pairs = written(pairs.join(side("a"), "ka").join(side("b"), "kb").filter(close("a", "b", share)).select("ka", "kb"), "jaccard-close")
        keys = written(pairs.select(F.explode(F.array("ka", "kb")).alias("key")).distinct(), "jaccard-keys")
        z = written(texts_of(keys).mapInArrow(tk.lean(_packed), "key long, z binary"), "jaccard-texts")
        joined = pairs.join(z.select(F.col("key").alias("ka"), F.col("z").alias("za")), "ka").join(z.select(F.col("key").alias("kb"), F.col("z").alias("zb")), "kb")
        return written(joined.select("ka", "kb", "za", "zb").mapInArrow(tk.lean(_verify(share)), "ka long, kb long"), name)

    def still_open(entry: DataFrame, links: DataFrame) -> DataFrame:
        """(sig, key, part) of the entries that sets of several components share."""
        parts = connected_components(links, "ka", "kb").withColumnRenamed("node", "key")
        placed = entry.join(_few(parts), "key", "left").select("sig", "key", F.coalesce("component", "key").alias("part"))
        spread = placed.groupBy("sig").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("sig")
        return written(placed.join(spread, "sig", "left_semi"), "jaccard-open")

    indexed = source.select("text").mapInArrow(tk.lean(_index(share, seed)), "sig long, key long, note boolean")
    shared = indexed.repartition("sig", F.when(F.col("note"), F.col("key"))).sortWithinPartitions("sig", "note", "key").mapInArrow(tk.lean(_grouped), "sig long, key long, prev long, note boolean")
    shared = written(shared, "jaccard-shared")
    scheme = F.col("sig").bitwiseAND((1 << SCHEME_BITS) - 1).cast("int").alias("scheme")
    entry = shared.filter("not note").select("sig", "key", "prev")
    pairs = written(entry.filter("prev is not null").select(F.col("prev").alias("ka"), F.col("key").alias("kb")).distinct(), "jaccard-pairs")
    found = verified(pairs, "jaccard-links")
    links = found
    open_rows = still_open(entry, links)
    # a text and its many edited copies: copies may be linked through it alone, and it has the most entries
    weight = open_rows.groupBy("key").agg(F.count("*").alias("entries"))
    centre = open_rows.join(_few(weight), "key").groupBy("sig").agg(F.max(F.struct("entries", "key", "part")).alias("c"))
    spokes = open_rows.join(centre, "sig").filter("part <> c.part").select(F.least("key", "c.key").alias("ka"), F.greatest("key", "c.key").alias("kb")).distinct()
    spokes = written(spokes.join(pairs, ["ka", "kb"], "left_anti"), "jaccard-spokes")
    if not spokes.isEmpty():
        links = written(links.unionAll(verified(spokes, "jaccard-links")), "jaccard-more-links")
        open_rows = still_open(entry, links)
    tested = pairs.unionAll(spokes)
    sizes = open_rows.groupBy("sig", "part").agg(F.count("*").alias("sets")).groupBy("sig").agg(
        F.count("*").alias("parts"), ((F.sum("sets") * F.sum("sets") - F.sum(F.col("sets") * F.col("sets"))) / 2).alias("pairs"))
    mild = (F.col("parts") <= HOT) & (F.col("pairs") <= HOT_PAIRS)
    cold = open_rows.join(sizes.filter(mild).select("sig"), "sig", "left_semi")
    hot = written(open_rows.join(sizes.filter(~mild).select("sig"), "sig", "left_semi"), "jaccard-hot")
    # what each key has lost to hot entries; an entry of allowance 1 is worth two credits
    lost = hot.groupBy("key", scheme).agg(F.sum(F.shiftright("sig", SCHEME_BITS).bitwiseAND(1) + 1).alias("lost"))
    spare = shared.filter("note").select("key", scheme, (F.shiftright("sig", SCHEME_BITS) - SLACK).alias("spare"))
    short = written(spare.join(lost, ["key", "scheme"], "left").filter("spare < coalesce(lost, 0)").select("key", "scheme"), "jaccard-short")
    x, y = cold.select("sig", F.col("key").alias("ka"), F.col("part").alias("pa")), cold.select("sig", F.col("key").alias("kb"), F.col("part").alias("pb"))
    cross = x.join(y, "sig").filter("pa < pb").select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()
    cross = written(cross.join(tested, ["ka", "kb"], "left_anti"), "jaccard-cross")
    if not cross.isEmpty():
        links = written(links.unionAll(verified(cross, "jaccard-links")), "jaccard-all-links")
    if not short.isEmpty():
        lacking = written(_lacking(texts_of(short.select("key").distinct()), connected_components(links, "ka", "kb"), sketches, share, seed), "jaccard-lacking")
        links = written(links.unionAll(verified(lacking.join(tested, ["ka", "kb"], "left_anti"), "jaccard-links")), "jaccard-last-links")
    parts = connected_components(links, "ka", "kb").withColumnRenamed("node", "key")
    grouped = classes.join(parts, "key", "left").select("key", "copies", "least", F.coalesce("component", "key").alias("part"))
    least = grouped.groupBy("part").agg(F.min("least").alias("component_id"), F.sum("copies").alias("total")).filter("total > 1")
    # sets of one row alone stay out of what is joined with the rows; AQE splits a hot key
    return meta.select("doc_id", "text_key", "n", "key"), written(grouped.join(least, "part").select("key", "part", "component_id"), "jaccard-known")


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text).

    Sets are distinct lower-cased (A-Z) five-word shingles, shorter texts their whole sequence. Rows whose
    sets share `share` percent of their union are linked, and component_id is the least doc_id reachable.
    Null and empty texts have no shingles and no links; copies are linked; a null doc_id counts as no id:
    its row keeps null unless a linked row has an id. Texts of any length are read whole. Other columns are
    ignored. An empty table gives an empty table.
    """
    meta, known = _linked(docs, share)
    return meta.join(_few(known.select("key", "component_id")), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """`docs`, all columns, with one row of each group of near duplicates: that with the least doc_id.

    A group is of rows whose texts are linked, whatever their ids; rows without id come last in it, a tie of
    ids goes to the least hash of the text, one of both to the least row as JSON. So rows that share an id
    but not a text are in groups of their own. Rows without words are linked with nothing and all stay.
    """
    meta, known = _linked(docs.select("doc_id", "text"), share)
    rows = meta.filter("n > 0").join(_few(known.select("key", "part")), "key").select("part", "doc_id", "text_key")  # groups of one are not there
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = written(rows.groupBy("part").agg(F.min(rank).alias("first")), "jaccard-first")
    counted = rows.groupBy("part", "doc_id", "text_key").agg(F.count("*").alias("n"))
    judged = written(counted.join(_few(first), "part").select("doc_id", "text_key", "n", (rank == F.col("first")).alias("stays")), "jaccard-judged")
    id_, key, stays = (fresh(docs, x) for x in ("judged_id", "judged_text", "judged_stays"))
    judged = judged.filter("not stays or n > 1").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("stays").alias(stays))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(key))
    out = docs.join(_few(judged), same, "left_anti")
    again = judged.filter(F.col(stays))
    if again.isEmpty():
        return out
    row = F.struct(*(F.col(c) for c in docs.columns))
    kept = docs.join(_few(again), same).groupBy(id_, key).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return out.unionAll(kept.select("row.*"))
