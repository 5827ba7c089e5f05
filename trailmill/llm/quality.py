"""Quality rules: base counts and a calibrated n-gram classifier against fixed thresholds.

The classifier is a logistic regression on hashed word unigrams, word bigrams and character 4-grams
(bytes), trained on a bounded sample of labelled quality rows, with a Platt calibration on the third of
the sample that training doesn't see. Texts are scored whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import textkit as tk
from trailmill.llm.samples import labelled_sample

BITS = 16
#: Fixed thresholds.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 50, 50, 0.5
#: Bounds of the training sample.
PER_CLASS, MAX_CHARS, ROUNDS = 1000, 20_000, 80
SCALE = 60.0
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, probability double, kept boolean")


@dataclass
class QualityModel:
    weights: np.ndarray  # a row for each family of features
    bias: float
    slope: float
    shift: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


def _grams(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: hashed ids of all n-grams, and for each text the bounds of its own."""
    shift = np.uint64(64 - BITS)
    ones = (tk.mix64(h) >> shift).astype(np.int64)
    with np.errstate(over="ignore"):
        pairs = (tk.mix64(h[:-1] * tk.MIX[0] + h[1:] * tk.MIX[1]) >> shift).astype(np.int64) if len(h) > 1 else np.zeros(0, np.int64)
        if len(data) > 3:
            d = data.astype(np.uint32)
            quads = (((d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
        else:
            quads = np.zeros(0, np.int64)
    ends = lambda a, cut: np.maximum(a[1:] - cut, a[:-1])
    return [(ones, first[:-1], first[1:]), (pairs, first[:-1], ends(first, 1)), (quads, offsets[:-1], ends(offsets, 3))]


def _mean(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return (total[np.minimum(hi, len(values))] - total[np.minimum(lo, len(values))]) / np.maximum(hi - lo, 1)


def _raw(model: QualityModel, grams: list) -> np.ndarray:
    return model.bias + SCALE * sum(_mean(w[ids], lo, hi) for w, (ids, lo, hi) in zip(model.weights, grams, strict=True))


def fit(sample: pd.DataFrame) -> QualityModel | None:
    """None where a class has no rows: then only the base rules decide."""
    if sample.empty or sample["label"].nunique() < 2:
        return None
    data, offsets = tk.buffers(pa.array(sample["text"], pa.large_string()))
    starts, ends, first = tk.words(data, offsets)
    grams = _grams(data, offsets, tk.span_hashes(data, starts, ends), first)
    y = sample["label"].to_numpy(float)
    held = sample["doc_id"].to_numpy() % 3 == 1
    train = np.where(held & (len(y) >= 30), 0.0, 1.0)
    train *= np.where(y == 1, 0.5 / max((train * y).sum(), 1), 0.5 / max((train * (1 - y)).sum(), 1))
    model = QualityModel(np.zeros((len(grams), 1 << BITS)), 0.0, 1.0, 0.0)
    speed, bias_speed = np.full_like(model.weights, 1e-8), 1e-8
    for _ in range(ROUNDS):
        error = train * (1 / (1 + np.exp(-np.clip(_raw(model, grams), -60, 60))) - y)
        for f, (ids, lo, hi) in enumerate(grams):
            n = hi - lo
            inside = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            grad = np.bincount(ids[inside], np.repeat(SCALE * error / np.maximum(n, 1), n), 1 << BITS) + 1e-6 * model.weights[f]
            speed[f] += grad**2
            model.weights[f] -= 0.1 * grad / np.sqrt(speed[f])
        bias_speed += error.sum() ** 2
        model.bias -= 0.1 * error.sum() / np.sqrt(bias_speed)
    calibrate = held if len(y) >= 30 and len(set(y[held])) == 2 else np.ones(len(y), bool)
    z, t, a, b = _raw(model, grams)[calibrate], y[calibrate], 1.0, 0.0
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's smoothed targets
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w = np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, [((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    model.slope, model.shift = max(a, 1e-3), b
    model.weights = model.weights.astype(np.float32)
    return model


def _twice(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal (owner, h): which occur twice or more, and which have an earlier equal one."""
    order = np.lexsort((np.arange(len(h)), h, owner))
    o, v = owner[order], h[order]
    later = np.zeros(len(h), dtype=bool)
    later[1:] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    many = later.copy()
    many[:-1] |= later[1:]
    out = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    out[0][order], out[1][order] = many, later
    return out


def measure(data: np.ndarray, offsets: np.ndarray, model: QualityModel | None) -> dict[str, np.ndarray]:
    """Base counts, base verdict and probability of each text."""
    n = len(offsets) - 1
    starts, ends, first = tk.words(data, offsets)
    n_words = np.diff(first)
    inside = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    word_chars = inside(~tk.SEPARATOR[data] & ((data & 0xC0) != 0x80))
    h = tk.span_hashes(data, starts, ends)
    at, wide = tk.window_hashes(h, first, 3)
    owner = np.repeat(np.arange(n), n_words)
    many, _ = _twice(owner[at], wide)
    covered = np.zeros(len(h) + 3, dtype=bool)
    for k in range(3):
        covered[at[many] + k] = True
    n_repeat = np.bincount(owner, covered[: len(h)], n).astype(np.int64) if len(h) else np.zeros(n, np.int64)
    stops = data == 10
    breaks = np.flatnonzero(stops)
    # a line is a stretch without \n inside one text
    cuts = np.unique(np.concatenate((breaks, breaks + 1, offsets)))
    lo, hi = cuts[:-1], cuts[1:]
    real = (hi > lo) & ~stops[np.minimum(lo, max(len(data) - 1, 0))] if len(data) else np.zeros(len(lo), bool)
    lo, hi = lo[real], hi[real]
    has_word = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi = lo[has_word], hi[has_word]
    line_owner = np.searchsorted(offsets, lo, side="right") - 1
    _, later = _twice(line_owner, tk.span_hashes(data, lo, hi))
    n_dup = np.bincount(line_owner, later, n).astype(np.int64) if len(lo) else np.zeros(n, np.int64)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    p = np.ones(n) if model is None else model.probability(_raw(model, _grams(data, offsets, h, first)))
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": inside(SYMBOLS[data]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
            "base_failed": failed, "probability": p, "kept": ~failed & (p >= MIN_PROBABILITY)}


def scorer(model: QualityModel | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tk.blocks(batch, "text"):
                found = measure(data, offsets, model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v) for v in found.values())], ["doc_id", *found])

    return score


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> QualityModel | None:
    return fit(labelled_sample(docs, labels, "quality", per_class, max_chars))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every row of docs(doc_id, text).

    A null or empty text has no words and fails the base rules; repeated rows are judged alike and each
    returned; a null doc_id is kept as null; further columns of `docs` are ignored. Without labels of both
    classes only the base rules decide. An empty table gives an empty table.
    """
    model = train(docs, labels)
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # under 1 MB: three rows of 2**BITS float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scorer(shared.value)(batches)

    return tk.bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tk.lean(run), SCHEMA)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(train(docs, labels)), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tk.blocks(batch, "text"):
                yield part.filter(pa.array(measure(data, offsets, shared.value)["kept"]))

    return tk.bounded(docs).mapInArrow(tk.lean(run), schema)
