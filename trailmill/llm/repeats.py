"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Where a text repeats another, both choose the same anchors: of every `depth` bytes, the run of ANCHOR
bytes with the least hash. The starts that share an anchor, with the bytes they cover, are a snippet;
equal strings lie in snippets of the same anchor. Anchors that occur once are dropped, equal snippets
counted, and the distinct snippets of an anchor go to one shard, where external induced sorting
(`induced.py`) orders their suffixes, carries common prefixes and so finds each start that repeats.
Snippets of an anchor that very many share are split further, by content and by start.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.shared import written
from trailmill.llm import textkit as tk
from trailmill.llm.induced import PAD, repeated

DEPTH, ANCHOR = 400, 100
#: Distinct snippets of one anchor beyond which its starts are dealt out one by one, and rows beyond which its snippets
#: are; the same at any size of the table.
HOT, HOT_ROWS = 20_000, 50_000
#: Parts that very many equal rows are dealt to.
PARTS = 64
#: Bytes of snippets that a shard takes before it is sorted; it takes whole anchors, so it may be larger.
SHARD_BYTES = 8 << 20
#: Bytes of texts that are searched for anchors at once.
PIECE = 1 << 19
#: Copies that a task remembers in order not to search them twice; only saves work.
SEEN = 100_000
BROADCAST_ROWS = 500_000
ROW = ["anchor", "whole", "k1", "k2", "lo", "hi"]
ROWS = "anchor long, whole long, k1 long, k2 long, lo int, hi int"


def rolling(data: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hashes of the `width` bytes from each position on (len - width + 1 values)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        key = tk.BYTE_KEY if lane == 0 else tk.mix64(tk.BYTE_KEY + tk.MIX[lane])
        total = tk.running(data, key)
        return tk.mix64((total[width:] - total[:-width]) * tk.powers(n, tk.INVERSE))


def least_in_window(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each run of `window` values (len - window + 1 values)."""
    n = len(values)
    pad = -n % window
    grid = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, values.dtype))).reshape(-1, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - window + 1], ahead[window - 1 : n])


def snippets(data: np.ndarray, offsets: np.ndarray, depth: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor hash, snippet hash) with starts counted inside the text."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < depth:
        return empty
    h = rolling(data, anchor)
    window = depth - anchor + 1
    bits = np.uint64(max(len(h) - 1, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the first
    at = (least_in_window(packed, window) & low).astype(np.int64)
    start = np.arange(len(at))
    owner = np.searchsorted(offsets, start, side="right") - 1
    valid = start + depth <= offsets[owner + 1]
    start, at, owner = start[valid], at[valid], owner[valid]
    if not len(start):
        return empty
    new = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    lo, hi, at, owner = start[first], start[np.append(first[1:], len(start)) - 1], at[first], owner[first]
    with np.errstate(over="ignore"):
        total = tk.running(data)
        whole = tk.mix64((total[hi + depth] - total[lo]) * tk.powers(len(data), tk.INVERSE)[lo] + (hi - lo).astype(np.uint64) * tk.MIX[3] + (at - lo).astype(np.uint64) * tk.MIX[4])
    return owner, lo - offsets[owner], hi - offsets[owner], h[at], whole


def _anchors(depth: int, anchor: int):
    def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if len(offsets) > 2 or len(data) <= 2 * PIECE:
            yield snippets(data, offsets, depth, anchor)
            return
        for at in range(0, len(data), PIECE):  # an anchor depends on no more than the `depth` bytes that it is chosen for
            part = data[at : at + PIECE + depth - 1]
            owner, lo, hi, h, whole = snippets(part, np.array([0, len(part)]), depth, anchor)
            yield owner, lo + at, hi + at, h, whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part, data, offsets in tk.blocks(batch, "text", PIECE):
                k1, k2 = part.column("k1").to_numpy(), part.column("k2").to_numpy()
                fresh = np.zeros(len(k1), dtype=bool)
                for k, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):  # of copies that a task reads, one is enough
                    if key not in seen:
                        fresh[k] = True
                        seen.add(key)
                if len(seen) > SEEN:
                    seen.clear()
                if not fresh.any():
                    continue
                for owner, lo, hi, h, whole in pieces(data, offsets):
                    keep = fresh[owner]
                    owner = owner[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (h[keep].view(np.int64), whole[keep].view(np.int64), k1[owner], k2[owner], lo[keep].astype(np.int32), hi[keep].astype(np.int32))],
                        ROW)

    return run


def _shared(always: bool):
    """Of rows sorted by (anchor, whole, k1, k2, lo): those with an equal snippet elsewhere, and once more, with
    lead, the first of each run of equals, which stands for them where its anchor has several or `always`."""

    def out(rows: list[np.ndarray], lead: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.array(np.full(len(rows[0]), lead))], [*ROW, "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None  # the last row; the first of its anchor while that has no other snippet

        def given(rows: list[np.ndarray], near: np.ndarray, like: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal first
            yield out([x[many] for x in rows], False)
            if always:
                yield out([x[~like] for x in rows], True)
                return
            group, heads, other = np.cumsum(~near), np.flatnonzero(~near), near & ~like
            several = np.unique(group[other])
            if first is not None and len(several) and several[0] == 0:
                yield out(first, True)
                first = None
            other[heads[several[several > 0] - 1]] = True
            yield out([x[other] for x in rows], True)
            if len(heads):
                first = None if len(several) and several[-1] == len(heads) else [x[heads[-1:]].copy() for x in rows]

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ROW]
            cols += [np.zeros(len(cols[0]), bool), np.zeros(len(cols[0]), bool)]  # like the one before: anchor, snippet
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            again = np.zeros(len(cols[0]), dtype=bool)
            again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:5]])  # the same place, read twice
            cols = [c[~again] for c in cols]
            near, like = cols[6], cols[7]
            near[1:] |= cols[0][1:] == cols[0][:-1]
            like[1:] |= near[1:] & (cols[1][1:] == cols[1][:-1])
            many = like.copy()
            many[:-1] |= like[1:]
            held = [c[-1:].copy() for c in cols]
            yield from given([c[:-1] for c in cols[:6]], near[:-1], like[:-1], many[:-1])
        if held is not None:
            yield from given(held[:6], held[6], held[7], held[7])

    return run


def _cut(depth: int):
    names, kinds = ["k1", "k2", "anchor", "lo", "bytes"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, found in zip(*(batch.column(c) for c in ("k1", "k2", "text", "found")), strict=True):
                raw, rows = text.as_py().encode(), found.as_py()
                for k in range(0, len(rows), 1000):
                    part = rows[k : k + 1000]
                    cols = ([k1.as_py()] * len(part), [k2.as_py()] * len(part), [s["anchor"] for s in part], [s["lo"] for s in part], [raw[s["lo"] : s["hi"] + depth] for s in part])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


class _Shard:
    """Snippets of whole anchors in a task-local file, which ends with the task, and the rows they came from."""

    def __init__(self):
        self.file, self.size, self.rows = tempfile.TemporaryFile(), 0, []

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        column = batch.column("bytes").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data, offsets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        ends = offsets[1:] + np.arange(1, len(offsets))  # 0 ends a snippet; texts' bytes move up by one, which UTF-8 leaves room for
        out = np.zeros(len(data) + batch.num_rows, np.uint8)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = data + 1
        self.file.write(out.tobytes())
        heads = self.size + np.append(0, ends[:-1])
        self.rows.append([*(batch.column(c).to_numpy() for c in ("k1", "k2", "lo")), heads])
        self.size += len(out)

    def ranges(self, depth: int) -> Iterator[pa.RecordBatch]:
        """(k1, k2, lo, hi): runs of starts whose strings are found elsewhere in the shard."""
        self.file.write(b"\xff" * PAD)
        self.file.flush()
        text = np.memmap(self.file, np.uint8, "r")
        k1, k2, lo, heads = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        found, before, open_at = repeated(text, self.size, depth), False, 0
        for at in range(0, self.size, 1 << 20):
            flags = np.concatenate(([before], found[at : at + (1 << 20)], [False] * (at + (1 << 20) >= self.size)))
            step = np.diff(flags.astype(np.int8))
            first, last = np.flatnonzero(step == 1) + at, np.flatnonzero(step == -1) + at - 1
            if before:
                first = np.append(open_at, first)
            before = bool(flags[-1])
            if before:
                open_at, first = int(first[-1]), first[:-1]
            owner = np.searchsorted(heads, first, side="right") - 1
            base = lo[owner].astype(np.int64) - heads[owner]
            yield pa.RecordBatch.from_arrays([pa.array(k1[owner]), pa.array(k2[owner]), pa.array((first + base).astype(np.int32)), pa.array((last + base).astype(np.int32))], ["k1", "k2", "lo", "hi"])


def _sorted(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = _Shard(), None
        for batch in batches:  # sorted by anchor
            anchor = batch.column("anchor").to_numpy()
            total = np.append(0, np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy() + 1))
            heads = np.flatnonzero(np.append(last is None or anchor[:1] != last, anchor[1:] != anchor[:-1])[: len(anchor)])
            at = 0
            while at < len(anchor):
                full = heads[(heads >= at) & (shard.size + total[heads] - total[at] >= SHARD_BYTES)]
                end = int(full[0]) if len(full) else len(anchor)
                shard.add(batch.slice(at, end - at))
                if len(full):
                    yield from shard.ranges(depth)
                    shard = _Shard()
                at = end
            last = anchor[-1:]
        if shard.size:
            yield from shard.ranges(depth)

    return run


def _starts(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, lo, body in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "lo", "bytes")), strict=True):
                data = np.frombuffer(body, dtype=np.uint8)
                a, b = rolling(data, depth), rolling(data, depth, 1)
                at = pa.array((lo + np.arange(len(a))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *(pa.array(np.full(len(a), x)) for x in (k1, k2)), at, at], ROW)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Disjoint, ascending spans of each text from all its ranges; touching ones become one."""
    for batch in batches:
        r = batch.column("r")
        lo, hi = (r.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
        owner = np.repeat(np.arange(batch.num_rows), r.value_lengths().to_numpy())
        order = np.lexsort((lo, owner))
        lo, hi, owner = lo[order], hi[order], owner[order]
        reach = np.maximum.accumulate(owner << 32 | hi)  # texts are shorter than 2**31
        new = np.append(True, (owner[1:] << 32 | lo[1:]) > reach[:-1]) if len(lo) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        ends = reach[np.append(first[1:], len(lo)) - 1] & ((1 << 32) - 1) if len(lo) else lo
        spans = pa.StructArray.from_arrays([pa.array(lo[first].astype(np.int32)), pa.array(ends.astype(np.int32))], ["lo", "hi"])
        bounds = np.searchsorted(owner[first], np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.ListArray.from_arrays(pa.array(bounds), spans)], ["k1", "k2", "spans"])


def _few(df: DataFrame) -> DataFrame:
    """A written table, broadcast where it has few rows (16 to 40 bytes each)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _parted(rows: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of anchors that at most `most` rows have, and the rest (None: there is no rest). The limit is the same
    at any size, so the anchors over it grow with the table: they stay in a written table and are never collected."""
    hot = written(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("anchor"), name)
    if hot.isEmpty():
        return rows, None
    return rows.join(_few(hot), "anchor", "left_anti").select(rows.columns), rows.join(_few(hot), "anchor", "left_semi").select(rows.columns)


def _equal(rows: DataFrame, name: str) -> DataFrame:
    """_shared() for rows of which very many may be equal: each of PARTS parts of equals first, then their leads."""
    part = F.pmod(F.xxhash64("k1", "k2", "lo"), F.lit(PARTS))
    thin = written(rows.repartition("anchor", "whole", part).sortWithinPartitions("anchor", "whole", "k1", "k2", "lo").mapInArrow(tk.lean(_shared(True)), ROWS + ", lead boolean"), name)
    leads = thin.filter("lead").select(ROW).repartition("anchor", "whole").sortWithinPartitions("anchor", "whole", "k1", "k2", "lo").mapInArrow(tk.lean(_shared(True)), ROWS + ", lead boolean")
    return thin.filter("not lead").unionAll(leads)


def _standing(rows: DataFrame) -> DataFrame:
    """What _shared() says of all rows. An anchor's meet in one task, sorted; those of an anchor that very many
    have meet by equal snippets alone, and all its distinct ones are taken to be several."""
    mild, hot = _parted(rows, HOT_ROWS, "repeat-hot-rows")
    out = mild.repartition("anchor").sortWithinPartitions("anchor", "whole", "k1", "k2", "lo").mapInArrow(tk.lean(_shared(False)), ROWS + ", lead boolean")
    if hot is not None:
        out = out.unionAll(_equal(hot, "repeat-equal"))
    return written(out, "repeat-anchors")


def repeated_spans(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, spans) of the texts with repeats; spans are disjoint, ascending [from, to) of bytes.

    k1 and k2 are two 64-bit hashes of the text; `docs` needs column text. Whole copies have one span.
    """
    source = tk.bounded(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("text", *_text_keys(F.col("text")), F.octet_length("text").alias("size"))
    long, keys = source.filter(F.col("size") >= depth), ["k1", "k2"]
    copies = written(long.groupBy(*keys).agg(F.count("*").alias("n"), F.max("size").alias("size")).filter("n > 1").select(*keys, F.col("size").cast("int").alias("size")), "repeat-copies")
    rows = written(long.select("text", *keys).mapInArrow(tk.lean(_anchors(depth, anchor)), ROWS), "repeat-rows")
    shared = _standing(rows)
    # anchors with one distinct snippet have nothing left to sort
    leads = shared.filter("lead").select(*keys, "anchor", "lo", "hi")
    found = written(leads.groupBy(*keys).agg(F.collect_set(F.struct("anchor", "lo", "hi")).alias("found")), "repeat-leads")  # snippets of one text
    texts = long.select(*keys, "text").join(_few(found.select(*keys)), keys, "left_semi").dropDuplicates(keys).join(found, keys)
    pieces = written(texts.select(*keys, "text", "found").mapInArrow(tk.lean(_cut(depth)), "k1 long, k2 long, anchor long, lo int, bytes binary"), "repeat-snippets")
    mild, hot = _parted(pieces, HOT, "repeat-hot-snippets")
    ranges = mild.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tk.lean(_sorted(depth)), "k1 long, k2 long, lo int, hi int")
    if hot is not None:
        starts = hot.select(*keys, "lo", "bytes").mapInArrow(tk.lean(_starts(depth)), ROWS)
        ranges = ranges.unionAll(_equal(starts, "repeat-starts").filter("not lead").select(*keys, "lo", "hi"))
    ranges = ranges.unionAll(shared.filter("not lead").select(*keys, "lo", "hi")).unionAll(copies.select(*keys, F.lit(0).alias("lo"), (F.col("size") - depth).alias("hi")))
    grouped = ranges.groupBy(*keys).agg(F.collect_set(F.struct("lo", (F.col("hi") + depth).alias("hi"))).alias("r"))
    return written(grouped.mapInArrow(tk.lean(_joined), "k1 long, k2 long, spans array<struct<lo:int,hi:int>>"), "repeat-spans")


def fresh(docs: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `docs` has it in any spelling."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _attached(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, str]:
    """Every row of `docs` with the spans of its text in found(k1, k2, spans), and that column's name."""
    one, two, spans = fresh(docs, "text_key_one"), fresh(docs, "text_key_two"), fresh(docs, "repeated_spans")
    found = found.select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("spans").alias(spans))
    k1, k2 = _text_keys(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(_few(found.select(one, two, spans)), (k1 == F.col(one)) & (k2 == F.col(two)), "left").drop(one, two), spans


def with_spans(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR) -> tuple[DataFrame, str]:
    """Every row of `docs`, all its columns, with a column of spans (null without repeats), and that column's name."""
    return _attached(docs, repeated_spans(docs.select("text"), depth, anchor))


def _kept_parts(body: bytes, spans: list[dict] | None) -> list[bytes]:
    parts, at = [], 0
    for s in spans or []:
        parts.append(body[at : s["lo"]])
        at = s["hi"]
    return [*parts, body[at:]]


def _kept_text(body: bytes, spans: list[dict] | None) -> str:
    """Each part by itself, so that bytes on both sides of a cut never make a character that wasn't there."""
    return "".join(p.decode(errors="ignore") for p in _kept_parts(body, spans))


def _united(spans: list[dict] | None, more: list[dict] | None) -> list[dict]:
    """Disjoint, ascending spans of the bytes that either covers."""
    out: list[dict] = []
    for s in sorted((*(spans or []), *(more or [])), key=lambda s: s["lo"]):
        if out and s["lo"] <= out[-1]["hi"]:
            out[-1] = {"lo": out[-1]["lo"], "hi": max(out[-1]["hi"], s["hi"])}
        else:
            out.append(s)
    return out


def dedup_report(docs: DataFrame, depth: int = DEPTH, passages: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of docs(doc_id, text).

    Bytes are those of the UTF-8 text, null counting as empty. A byte is removed if a string of `depth` bytes
    that covers it starts anywhere else too, in the same text or another; copies remove each other. Null
    doc_ids and repeated rows are kept. Other columns are ignored. An empty table gives an empty table.

    With passages(k1, k2, spans) of these texts, see passages.shared_passages(), two columns follow and the others
    stay as they are: n_passage_bytes, the bytes of passages among those not removed, and text, without the removed
    bytes and these (what a cut leaves of a character goes too).
    """
    rows, name = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), depth)
    rows, more = _attached(rows, passages) if passages is not None else (rows, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(name).to_pylist()
            bodies = [t.encode() for t in batch.column("text").to_pylist()]
            cut = [sum(s["hi"] - s["lo"] for s in x or []) for x in spans]
            sha = [hashlib.sha256(b"".join(_kept_parts(b, x))).hexdigest() for b, x in zip(bodies, spans, strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            columns = [batch.column("doc_id"), pa.array([len(b) for b in bodies], pa.int64()), pa.array(cut, pa.int64()), pa.array([len(x or []) for x in spans], pa.int64()), pa.array(sha, pa.string()),
                       pa.array([[(s["lo"], s["hi"]) for s in x or []] for x in spans], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))]
            if more:
                both = [_united(x, y) for x, y in zip(spans, batch.column(more).to_pylist(), strict=True)]
                names += ["n_passage_bytes", "text"]
                columns += [pa.array([sum(s["hi"] - s["lo"] for s in x) - n for x, n in zip(both, cut, strict=True)], pa.int64()), pa.array([_kept_text(b, x) for b, x in zip(bodies, both, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>"
    return rows.mapInArrow(tk.lean(run), kinds + ", n_passage_bytes long, text string" * bool(more))


def without_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`docs`, all its columns, with repeated bytes cut out of text; what a cut leaves of a character goes too.

    n_chars, where there is such a column, follows the text. A null text stays null.
    """
    return cut_out(docs, repeated_spans(docs.select("text"), depth))


def cut_out(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` without the bytes in found(k1, k2, spans), see without_repeats()."""
    (rows, name), schema = _attached(docs, found), docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else _kept_text(t.encode(), s) for t, s in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(n) for k, n in enumerate(schema.fieldNames())]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    out = rows.mapInArrow(tk.lean(run), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.fieldNames() else out
