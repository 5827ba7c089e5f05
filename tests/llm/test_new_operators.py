"""Conversation repair, hard negatives and nearest neighbours against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from trailmill.llm import conversations, negatives, neighbours

SPACE = r"[^\x20\x09-\x0D]"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        out += [(conv, turn, role, text)] * (2 if lot == 3 else 1)
    return out


def cheapest(rows):
    """All edit sequences by brute force: (cost, audit, repaired turns) of the best."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        found = re.findall(SPACE, text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(k, cost, audit, turns, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
            best = min(x for x in (best, (cost, audit, turns)) if x)
        if not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in turns)):
            return
        if inserted < 2:
            for role in ("user", "assistant"):
                go(k, cost + 2, audit + "I", [*turns, (role, "")], inserted + 1)
        if k < len(rows):
            role, text = rows[k][2:]
            go(k + 1, cost + 3, audit + "D", turns, 0)
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                go(k + 1, cost + more, audit + "K", [*turns, (role, text)], 0)
                for new in ("user", "assistant"):
                    go(k + 1, cost + 2 + more, audit + "R", [*turns, (new, text)], 0)

    go(0, 0, "", [], 0)
    return faults, best


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in hurt(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest(), r[3]))
        faults, (cost, audit, turns) = cheapest(own)
        known = {r[1] for r in own if r[1] is not None}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise([r[2][:1] for r in own]))
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
    return out


def talk(seed, convs, most):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "assistant"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t\n", None, "Why? \n", f"say {turn}.", f"say {turn}", "é" * 50 + "?"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, key string, seg long"


@pytest.mark.parametrize("limit", [None, 3])
def test_conversations(spark, monkeypatch, limit):
    """Against all edit sequences; with `limit`, in segments of a few turns."""
    if limit:
        monkeypatch.setattr(conversations, "ROWS", limit)
    rows = talk(limit or 1, 60, 7)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = conversations.repair_report(conversations.damaged(table), table).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expected(rows) and len(got) == 61
    turns = conversations.repaired(conversations.damaged(table)).orderBy("conv_id", "place").collect()
    told = {}
    for r in turns:
        told.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in got:
        assert hashlib.sha256("\n".join(told.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_long_and_empty_conversations(spark, monkeypatch):
    """A conversation of thousands of turns with equal rows and very long texts is the same whole and in segments."""
    rng = random.Random(4)
    rows = [(7, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"n {k}.", f"n {k % 50}", "w " * 30_000 + ("!" if k % 3 else "")]) if k % 100 == 0 else f"t {k}.") for k in range(3000)]
    rows += [(7, None, "user", "again.")] * 500 + [(8, 1, "user", "Hi."), (8, 2, "assistant", "Ho.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r[0]: tuple(r) for r in conversations.repair_report(table).collect()}
    monkeypatch.setattr(conversations, "ROWS", 400)
    parts = {r[0]: tuple(r) for r in conversations.repair_report(table).collect()}
    assert whole == parts and whole[8][6:8] == (0, "KK")
    assert conversations.repair_report(table.limit(0)).collect() == []
    lost = conversations.repair_report(table.limit(0), table.filter("conv_id = 8")).collect()
    assert [tuple(r) for r in lost] == [(8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def odd_vectors(seed, count, scale, wide=6):
    """(vec_id, embedding, label, key, list): ties, copies, repeated and unusable rows, ragged and empty vectors."""
    rng = random.Random(seed)
    rows = [(k * (5 if k % 3 else 1), [rng.choice([-1, 1]) * rng.choice([0.0, 0.25, 0.5, 1.0, rng.random()]) * scale for _ in range(wide)], rng.randrange(3), 0, "x") for k in range(count)]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(10_000 + k, rows[3][1], 1, 0, "x") for k in range(40)] + rows[:5]
    bad = [None, [None] * wide, [math.nan] * wide, [1.0, math.inf], [1.0, None]]
    rows += [(20_000 + 100 * k, v, 1, 0, "x") for k, v in enumerate(bad)] + [(None, rows[0][1], 1, 0, "x"), (30_000, rows[0][1], None, 0, "x"), (40_000, [], 2, 0, "x"), (40_001, [0.5 * scale], 2, 0, "x"), (40_100, [0.0] * wide, 2, 0, "x")]
    return rows


VECTORS = "vec_id long, embedding array<double>, label int, rank int, list string"


def proper(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


@pytest.mark.parametrize(("scale", "blocks"), [(1.0, (2048, 16384, 2048)), (1.0, (2, 50, 7)), (3e4, (3, 40, 11))])
def test_hard_negatives(spark, monkeypatch, scale, blocks):
    """Against plain integer products, in one block and in many, with small and with large components."""
    for name, n in zip(("ANCHORS", "ROWS", "CHUNK"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, n)
    rows = odd_vectors(3, 500, scale)
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    known = {}
    for vec_id, v, label, *_ in proper(rows):
        if label is not None:
            known.setdefault(vec_id, ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    want = set()
    for a, (label, v) in known.items():
        if a % 100:
            continue
        score = {r: sum(x * y for x, y in zip(v, w, strict=False)) for r, (_, w) in known.items() if r != a}
        ranked = sorted(score, key=lambda r: (-score[r], r))
        for p in [r for r in ranked if known[r][0] == label][:5]:
            fits = [r for r in ranked if known[r][0] != label and 30 * score[p] <= 100 * score[r] <= 90 * score[p]]
            want |= {(a, p, k + 1, r, score[p], score[r]) for k, r in enumerate(fits[:10])}
    got = [tuple(r) for r in negatives.hard_negatives(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert negatives.hard_negatives(table.limit(0)).count() == 0


def test_sliced_products():
    """Every pair that could be wanted is there, with its exact score; others may be dropped."""
    rng = np.random.default_rng(1)
    for wide in (4, 60, 1 << 20, 1 << 26):
        a, r = rng.integers(-wide, wide, (7, 9)), rng.integers(-wide, wide, (90, 9))
        full = a @ r.T
        low, high = np.quantile(full, 0.9, axis=1).astype(np.int64), np.quantile(full, 0.95, axis=1).astype(np.int64)
        i, j, s = negatives.sliced(a, r, np.ones((7, 90), bool), low, high)
        want = (full >= low[:, None]) & (full <= high[:, None])
        assert (s == full[i, j]).all() and want.sum() == len(i) and want[i, j].all()
        i, j, s = negatives.sliced(a, r, np.ones((7, 90), bool), np.full(7, -(1 << 61)), most=5)
        fifth = np.sort(full, 1)[:, -5]
        assert (s == full[i, j]).all() and (np.bincount(i[s >= fifth[i]], minlength=7) == (full >= fifth[:, None]).sum(1)).all()


@pytest.mark.parametrize("small", [False, True])
def test_nearest_neighbours(spark, monkeypatch, small):
    """Exact scores and order, a recall of 0.9 or more against brute force, with odd rows, ties and hot vectors."""
    if small:  # many groups, a bounded sample, lists cut in blocks, queries in blocks
        for name, n in (("ROWS", 60), ("QUERIES", 16), ("SAMPLE", 300), ("PILOT", 100), ("COLUMNS", 3)):
            monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(2)
    rows = odd_vectors(5, 300, 1.0, 12) + [(50_000 + k, (rng.normal(size=12) + 3 * np.eye(12)[k % 12]).tolist(), 1, 0, "x") for k in range(900)]
    rows += [(60_000 + k, rows[-1][1], 1, 0, "x") for k in range(600)]  # a third are copies
    table = spark.createDataFrame(rows, VECTORS).repartition(4)
    known = {}
    for vec_id, v, *_ in proper(rows):
        if any(v):
            known.setdefault(vec_id, np.pad(np.array(v), (0, 12 - len(v))))
    got = {}
    for r in neighbours.nearest_neighbours(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {k for k in known if k % 20 == 0}
    hit = total = 0
    for q, own in got.items():
        assert sorted(own) == list(range(1, 21)) and len({v for v, _ in own.values()}) == 20 and q not in {v for v, _ in own.values()}
        score = {v: float((known[q] * w).sum()) for v, w in known.items() if v != q}
        for v, s in own.values():
            assert abs(s - score[v]) < 1e-12
        told = [own[k] for k in range(1, 21)]
        assert told == sorted(told, key=lambda x: (-x[1], x[0]))
        last = sorted(score.values(), reverse=True)[19] - 1e-12
        hit, total = hit + sum(s >= last for _, s in told), total + 20
    assert hit >= 0.9 * total
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0
    few = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest_neighbours(spark.createDataFrame([(0, [1.0], 1, 0, ""), (1, [2.0], 1, 0, ""), (2, [2.0], 1, 0, ""), (20, [1e200], 1, 0, "")], VECTORS)).collect()}
    assert few == {(0, 1): (20, 1e200), (0, 2): (1, 2.0), (0, 3): (2, 2.0), (20, 1): (1, 2e200), (20, 2): (2, 2e200), (20, 3): (0, 1e200)}
