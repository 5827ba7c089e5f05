"""Passages of many words that different texts share word for word, whatever white space lies between the words.

Where texts share WORDS words, all choose the same anchor for them: of their runs of ANCHOR words that with the least hash.
Windows of WORDS words whose anchor no other text has are dropped unhashed; of the others those are found that another text has
too. Rows follow the words, never pairs of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.shared import written
from trailmill.llm import textkit as tk
from trailmill.llm.repeats import PIECE, _few, _joined, _text_keys, cut_out, least_in_window

#: Words of a passage, and of the anchor that stands for it.
WORDS, ANCHOR = 50, 20


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` words from each on (len - width + 1 values)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * tk.powers(len(h)), dtype=np.uint64)))
        return tk.mix64((total[width:] - total[:-width]) * tk.powers(n, tk.INVERSE))


def _anchors(words: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tk.blocks(batch, "text", PIECE):
                starts, ends, first = tk.words(data, offsets)
                h = _rolled(tk.span_hashes(data, starts, ends), anchor)
                if len(starts) < words:
                    continue
                low = (np.uint64(1) << np.uint64(max(len(h) - 1, 1).bit_length())) - np.uint64(1)
                packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the first
                at = (least_in_window(packed, words - anchor + 1) & low).astype(np.int64)
                window = np.arange(len(at))
                owner = np.searchsorted(first, window, side="right") - 1
                valid = window + words <= first[owner + 1]
                window, at, owner = window[valid], at[valid], owner[valid]
                if not len(window):
                    continue
                head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
                last = np.append(head[1:], len(window)) - 1
                of = owner[head]
                keys = [pa.array(part.column(k).to_numpy()[of]) for k in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([pa.array(h[at[head]].view(np.int64)), *keys, pa.array((window[head] - first[of]).astype(np.int32)), pa.array((window[last] - first[of]).astype(np.int32))],
                                                 ["anchor", "k1", "k2", "lo", "hi"])

    return run


def _windows(words: int):
    names = ["w1", "w2", "k1", "k2", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, found in zip(*(batch.column(c) for c in ("k1", "k2", "text", "found")), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                starts, ends, _ = tk.words(data, np.array([0, len(data)]))
                h = tk.span_hashes(data, starts, ends)
                one, two = _rolled(h, words), _rolled(tk.mix64(h ^ tk.MIX[2]), words)
                wanted = np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in found.as_py()]))
                for k in range(0, len(wanted), 1 << 16):
                    w = wanted[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(one[w].view(np.int64)), pa.array(two[w].view(np.int64)), *(pa.array(np.full(len(w), x.as_py())) for x in (k1, k2)),
                                                      pa.array(starts[w].astype(np.int32)), pa.array(ends[w + words - 1].astype(np.int32))], names)

    return run


def _of_several(rows: DataFrame, *by: str) -> DataFrame:
    """Rows whose `by` rows of another text have too."""
    many = rows.groupBy(*by).agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).filter("a <> b").select(*by)
    return rows.join(_few(written(many, "passage-shared")), list(by), "left_semi")


def shared_passages(docs: DataFrame, words: int = WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, spans) of the texts of docs(text) that share `words` words or more with a different text.

    Spans are disjoint, ascending [from, to) of bytes, from the first byte of a word to the last of one. Copies of a text
    are one text here. Null counts as empty.
    """
    source = tk.bounded(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("text", *_text_keys(F.col("text")))
    long, keys = source.filter(F.octet_length("text") >= 2 * words - 1), ["k1", "k2"]
    rows = written(long.select("text", *keys).mapInArrow(tk.lean(_anchors(words, anchor)), "anchor long, k1 long, k2 long, lo int, hi int"), "passage-anchors")
    found = written(_of_several(rows, "anchor").groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi")).alias("found")), "passage-found")  # anchors of one text
    texts = long.join(_few(found.select(*keys)), keys, "left_semi").dropDuplicates(keys).join(found, keys)
    windows = written(texts.select(*keys, "text", "found").mapInArrow(tk.lean(_windows(words)), "w1 long, w2 long, k1 long, k2 long, lo int, hi int"), "passage-windows")
    grouped = _of_several(windows, "w1", "w2").groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    return written(grouped.mapInArrow(tk.lean(_joined), "k1 long, k2 long, spans array<struct<lo:int,hi:int>>"), "passage-spans")


def without_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`docs`, all its columns, with the passages of shared_passages() cut out of text; n_chars, where there is such a column, follows. A null text stays null."""
    return cut_out(docs, shared_passages(docs.select("text"), words))
