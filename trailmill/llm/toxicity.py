"""Toxicity by weak supervision.

Voters of separate sources label a bounded sample: for each kind of unit (words, and word beginnings of four
lengths) a lexicon whose units together fill a share of a text's words, and one of units that do so alone, each
mined from the labels of other rows than those it votes on; a seed list; and two patterns. A generative
model estimates by EM how often each voter fires for either class and how far voters stay correlated once
the class is known, and lets correlated ones count less; a linear classifier on the same units is trained on its
posterior labels and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm import textkit as tk
from trailmill.llm.samples import labelled_sample

#: A feature's number: 60 bits of a unit's hash, 3 of its kind (0 for words, else 1 + a place in PREFIXES), 1 if it's frequent.
KIND, OFTEN, HASH = np.uint64(14), np.uint64(1), ~np.uint64(15)
#: Bounds of the training sample.
PER_CLASS, MAX_CHARS = 2000, 20_000
PREFIXES = (4, 5, 6, 7)
#: A unit is frequent in a text that has it twice or more, and in one of so many words at least.
FREQUENT = 100
FOLDS = 5
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "disgusting", "worthless", "clown")
PATTERNS = 2
#: Voters more correlated than this, the class known, say the same.
COPIES = 0.6
THRESHOLD = 0.7
L1 = 7e-4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Labels may be learnt from these rows alone.
LEARNABLE = "crc32(cast(doc_id as string)) % 3 <> 1"

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _units(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, unit) of every word and word beginning, lower-cased, without punctuation at either end; words of each text."""
    data, offsets = tk.buffers(pc.utf8_lower(text.cast(pa.large_string())))
    spaced = np.where(_PUNCTUATION[data], np.uint8(32), data)
    starts, ends, first = tk.words(spaced, offsets)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    number = lambda h, kind: h & HASH | np.uint64(2 * kind)
    units, owners = [number(tk.span_hashes(data, starts, ends), 0)], [owner]
    for k, size in enumerate(PREFIXES):
        long = ends - starts > size
        units.append(number(tk.span_hashes(data, starts[long], starts[long] + size), k + 1))
        owners.append(owner[long])
    return np.concatenate(owners), np.concatenate(units), counts


def _features(owner: np.ndarray, unit: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times): each of a text's distinct units, and OFTEN set in it again where it is frequent there."""
    names, place = np.unique(unit, return_inverse=True)
    both, times = np.unique(owner * len(names) + place, return_counts=True)
    owner, unit = both // max(len(names), 1), names[both % max(len(names), 1)]
    often = (times > 1) & (times * FREQUENT >= words[owner])
    return tuple(np.concatenate(x) for x in ((owner, owner[often]), (unit, unit[often] | OFTEN), (times, times[often])))


@dataclass
class ToxicityModel:
    names: np.ndarray  # ascending features
    weights: np.ndarray
    bias: float

    def score(self, text: pa.Array) -> np.ndarray:
        owner, unit, words = _units(text)
        told = np.isin(unit, np.unique(self.names & ~OFTEN))
        owner, feature, _ = _features(owner[told], unit[told], words)
        known = np.isin(feature, self.names)
        z = self.bias + np.bincount(owner[known], self.weights[np.searchsorted(self.names, feature[known])], len(text))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _lexica(owner: np.ndarray, place: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Features (by place) that the labels of `rows` set apart: three times likelier in class 1 two standard errors down, in four rows."""
    own = rows[owner]
    pos, neg = (np.bincount(place[own], x[owner[own]], place.max(initial=-1) + 1) for x in (y, 1 - y))
    odds = np.log((pos + 0.5) / (y[rows].sum() + 1)) - np.log((neg + 0.5) / ((1 - y[rows]).sum() + 1))
    return (pos > 3) & (odds - 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) > np.log(3))


def voters(text: pa.Array, y: np.ndarray, units: tuple[np.ndarray, ...], features: tuple[np.ndarray, ...]) -> np.ndarray:
    """Votes (texts x voters) of 0 or 1; patterns are the last PATTERNS. A lexicon's vote on a row of one fold
    is that of the other folds' labels; the seed list and patterns see no labels."""
    (_, _, words), (owner, feature, times) = units, features
    kinds, n = len(PREFIXES) + 1, len(text)
    share = lambda hit: (np.bincount(owner[hit], times[hit], n) > 1) & (np.bincount(owner[hit], times[hit], n) * FREQUENT >= words)
    votes = np.zeros((n, 2 * kinds + 1 + PATTERNS))
    fold = np.arange(n) % FOLDS
    listed = np.zeros(len(owner), bool)
    _, place = np.unique(feature, return_inverse=True)
    often, kind = (feature & OFTEN).astype(bool), (feature & KIND) // np.uint64(2)
    for k in range(FOLDS):
        own = fold[owner] == k
        listed[own] = _lexica(owner, place, y, fold != k)[place[own]]
    for k in range(kinds):
        votes[:, k] = share(listed & ~often & (kind == k))
        votes[owner[listed & often & (kind == k)], kinds + k] = 1
    _, seeds, _ = _units(pa.array(SEED_WORDS))
    votes[owner[np.isin(feature, seeds[seeds & KIND == 0])], 2 * kinds] = 1
    data, offsets = tk.buffers(text)
    within = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets]) / np.maximum(np.diff(offsets), 1)
    votes[:, -2] = within(data == ord("!")) > 0.02
    votes[:, -1] = within((data >= 65) & (data <= 90)) > 0.3
    return votes


def label_model(votes: np.ndarray, prior: float, patterns: int = PATTERNS, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, how often each voter fires for class 0 and 1, and the correlations of
    voters given the class. The labels aren't an input: only their share is.

    A voter's weight is 1 over 1 plus its correlations of over COPIES with others, so that voters that copy each
    other count about once and can't take the class over; once the rates are found, in the last third of the
    rounds, it is the root of that, as voters of one kind of text are related without being copies. The last `patterns` voters have no say in the start.
    """
    hits = votes[:, : votes.shape[1] - patterns].sum(axis=1)
    post = np.where(hits > np.quantile(hits, 1 - prior) / 2, 0.9, 0.1)
    for r in range(rounds):
        rates = np.array([(w @ votes + 0.5) / (w.sum() + 1) for w in (1 - post, post)])
        resid = votes - np.outer(post, rates[1]) - np.outer(1 - post, rates[0])
        scale = np.sqrt((resid**2).mean(axis=0)) + 1e-3
        related = (resid / scale).T @ (resid / scale) / max(len(votes), 1)
        np.fill_diagonal(related, 0)
        weight = 1 / (1 + np.where(related > COPIES, related, 0).sum(axis=1))
        if 3 * r >= 2 * rounds:
            weight = np.sqrt(weight)
        on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        logit = np.log(prior / (1 - prior)) + votes @ (weight * on) + (1 - votes) @ (weight * off)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, rates, related


def fit(sample: pd.DataFrame, rounds: int = 150) -> ToxicityModel:
    """A classifier of bias alone where a class has no rows."""
    y = sample["label"].to_numpy(float) if len(sample) else np.zeros(0)
    if len(set(y)) < 2:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -4.0)
    text = pa.array(sample["text"], pa.large_string())
    units = _units(text)
    owner, feature, _ = features = _features(*units)
    target, _, _ = label_model(voters(text, y, units, features), float(y.mean()))
    # rare features can't be told from chance
    names, feature, counts = np.unique(feature, return_inverse=True, return_counts=True)
    common = counts >= 3
    owner, feature, names = owner[common[feature]], (np.cumsum(common) - 1)[feature[common[feature]]], names[common]
    w, bias, speed, bias_speed = np.zeros(len(names)), 0.0, np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, w[feature], len(y)), -40, 40)))
        error = (p - target) / len(y)
        grad = np.bincount(feature, error[owner], len(names))
        speed += grad**2
        rate = 0.3 / np.sqrt(speed)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(rate * L1, 0.3), 0)  # only features that carry the verdict stay
        bias_speed += error.sum() ** 2
        bias -= 0.3 * error.sum() / np.sqrt(bias_speed)
    return ToxicityModel(names[w != 0], w[w != 0], bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """A score of every row of docs(doc_id, text), from its text alone.

    Null and empty texts get the score of a text without features; a very long text is scored whole, alone in
    its block, and bytes that aren't UTF-8 count as one replacement character. Repeated rows are each scored; a row
    without doc_id is scored and counts as not held out. Further columns are ignored. Without labels of
    both classes every score is low. An empty table gives an empty table.
    """
    model = fit(labelled_sample(docs, labels, "toxic", per_class, max_chars, LEARNABLE))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 16 bytes for each feature of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in tk.blocks(batch, "text"):
                p = shared.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")).mapInArrow(tk.lean(run), SCHEMA)
