"""Each operator on a small table of odd rows, against brute force or an exact round trip."""

import base64
import hashlib
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmill.llm import contamination, extraction, induced, jaccard, licences, packing, passages, quality, repeats, sharding, toxicity, warc

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
say = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
BASE = say(120)
LONG = say(160)
TEXTS = [BASE, BASE, BASE.upper(), BASE + " one more word here", say(60) + "\n" + LONG + "\n" + say(40), LONG + " " + say(90), None, "", "   \n\t ", "one two", "One Two", "x" * 3000, "é " * 700,
         say(3000), "a b c <|endoftext|> d", "same line\nsame line\nsame line", BASE]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, say(70), "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sharding(docs):
    got = sharding.shard_by_bytes(docs, 4).toPandas()
    assert len(got) == len(TEXTS) + 1
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert by["size"][i] == len(raw) + 1 and by.text_crc32[i] == zlib.crc32(raw)
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [0, 30, 200])
def test_shards_keep_groups_and_sizes(spark, copies):
    """Against brute force: equal texts together, sizes near equal, rows whole, with a group of a third of all rows."""
    rng = random.Random(copies)
    texts = [say(rng.randint(1, 120)) for _ in range(400)]
    texts += [t for t in texts[:40] for _ in range(3)] + [BASE] * copies + [None, "", None]
    rows = [(rng.randint(0, 300) if i % 9 else None, t) for i, t in enumerate(texts)]
    rows += rows[:20]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).toPandas()
    size = lambda t: len((t or "").encode()) + 1
    key = lambda i, t: (-1 if i is None else i, size(t), zlib.crc32((t or "").encode()))
    mine = [(-1 if i != i else int(i), n, c) for i, n, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)]
    assert Counter(mine) == Counter(key(i, t) for i, t in rows)
    mean = got["size"].sum() / 8
    by = got.groupby("shard")
    assert len(by) == 8 and by["size"].sum().sub(mean).abs().max() <= 0.02 * mean + (max(map(size, texts)) if copies == 200 else 0)
    assert all(sorted(s) == list(range(len(s))) for _, s in by.slot)
    group = got.groupby("text_crc32")
    whole = group.shard.nunique()[group["size"].sum() <= mean]
    assert whole.max() == 1 and (copies < 200 or group.shard.nunique().max() > 1)


def test_jaccard(docs):
    def shingles(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, root = [shingles(t) for t in TEXTS], list(range(len(TEXTS)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_group(spark):
    """One row of a group whatever the ids, the same whatever the partitions, and nobody else's text lost."""
    other = say(90)
    rows = [(1, BASE, "b"), (1, BASE, "a"), (1, other, "c"), (2, BASE + " more", "d"), (None, other.upper(), "e"), (None, None, "f"), (3, "", "g"), (3, "", "g"), (None, say(70), "h")]
    want = {(1, BASE, "a"), (1, other, "c"), (None, None, "f"), (3, "", "g"), (None, rows[-1][1], "h")}
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, judged_id string").repartition(parts)
        got = [tuple(r) for r in jaccard.one_of_each(docs).collect()]
        assert set(got) == want and len(got) == len(want) + 1
    empty = jaccard.one_of_each(docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 5)), dtype=np.uint64)))
        bits, at = jaccard.parities(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        x, y = bits[: at[1]], bits[at[1] :]
        while len(x) != len(y):
            x, y = ((x[: len(x) // 2] ^ x[len(x) // 2 :]), y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_allocation_covers_every_difference():
    for largest in (0, 1, 3, 9, 40, 300):
        segments, ones, spare = jaccard.allocation(largest, 80, max(1, largest * 4))
        assert segments + ones >= largest + 1 + spare and ones <= segments


@pytest.mark.parametrize("hot", [None, (3, 5, 10)])
def test_repeats(docs, monkeypatch, hot):
    if hot:  # all anchors but the rarest go the ways of hot ones
        for name, value in zip(("HOT", "HOT_ROWS", "PARTS"), hot, strict=True):
            monkeypatch.setattr(repeats, name, value)
    depth = 400
    count = Counter(b[p : p + depth] for t in TEXTS for b in [(t or "").encode()] for p in range(len(b) - depth + 1))
    got = {r.doc_id: r for r in repeats.dedup_report(docs).collect()}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if count[b[p : p + depth]] > 1:
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest()), i
    assert repeats.dedup_report(docs.limit(0)).count() == 0
    assert repeats.without_repeats(docs).columns == docs.columns


def _padded(body):
    return np.concatenate((np.frombuffer(body, np.uint8), np.full(induced.PAD, 255, np.uint8)))


@pytest.mark.parametrize("held", [1 << 24, 30])
@pytest.mark.parametrize("base", [2, 1 << 15])
def test_induced_sorting(monkeypatch, held, base):
    """Against brute force, with and without recursion to the end and every queue on disk."""
    monkeypatch.setattr(induced, "BATCH", 7)
    monkeypatch.setattr(induced, "HELD", held)
    monkeypatch.setattr(induced, "BASE", base)
    monkeypatch.setattr(induced, "STRIDE", 5)
    rng = np.random.default_rng(3)
    for _ in range(60):
        b = rng.integers(0, int(rng.integers(2, 6)), int(rng.integers(1, 150))).astype(np.uint8).tobytes()
        order = induced.Level(_padded(b), len(b), 1, np.arange(256)).sorted_suffixes()
        assert np.asarray(order).tolist() == sorted(range(len(b)), key=lambda k: b[k:])
        for depth in (1, 3, 6):
            good = [p + depth <= len(b) and 0 not in b[p : p + depth] for p in range(len(b))]
            count = Counter(b[p : p + depth] for p in range(len(b)) if good[p])
            assert np.array(induced.repeated(_padded(b), len(b), depth)).tolist() == [g and count[b[p : p + depth]] > 1 for p, g in enumerate(good)]


PEAK = """
import re, sys, threading, time
import numpy as np
import pyarrow as pa
from trailmill.llm import induced
induced.BATCH, induced.HELD = 1 << 14, 1 << 20
n = int(sys.argv[1]) << 20
text = induced.mapped(n + induced.PAD, "u1")
rng = np.random.default_rng(1)
for at in range(0, n, 1 << 18):  # every second stretch repeats one before
    text[at : at + (1 << 18)] = rng.integers(97, 123, 1 << 18) if at % (1 << 19) == 0 else text[at - (1 << 18) : at]
text[n:] = 255
now = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1])
before, peak = now(), [0]
def watch():
    while True:
        peak[0] = max(peak[0], now())
        time.sleep(0.02)
threading.Thread(target=watch, daemon=True).start()
assert induced.repeated(text, n, 400).sum() > n * 0.9
print((peak[0] - before) // 1024)
"""


def test_sorter_memory_does_not_follow_the_shard():
    peak = {mb: int(subprocess.run([sys.executable, "-c", PEAK, str(mb)], capture_output=True, text=True, check=True).stdout) for mb in (2, 8)}
    assert peak[8] < 60 and peak[8] < peak[2] + 20, peak


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, with_ids=True).toPandas()
    for i, t in enumerate(TEXTS):
        own = got[got.doc_id == i].sort_values("start")
        ids = [x for part in own.ids for x in part]
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 0], i
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(own.ids, own.ids_crc32, strict=True))
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024
    assert 50256 in [x for part in got[got.doc_id == next(i for i, t in enumerate(TEXTS) if "endoftext" in (t or ""))].ids for x in part]
    tight = packing.pack_documents(docs, path, capacity=64, max_segments=2, max_loss=40).toPandas().groupby("sequence_id")
    assert tight.length.sum().max() <= 64 and tight.length.count().max() <= 2 and tight.loss_tokens.sum().max() <= 40
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_packing_instructions(spark):
    """Prompts bear no loss, and each of three limits binds somewhere."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, say(RNG.choice((3, 40, 200))), say(RNG.choice((2, 30, 150)))) for i in range(120)] + [(200, None, "answer"), (201, "question", None)]
    pairs = spark.createDataFrame(rows, "doc_id long, prompt string, text string").repartition(2)
    got = packing.pack_documents(pairs, path, capacity=256, max_segments=6, max_loss=120, prompt="prompt").toPandas()
    by = got.groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "count"), loss=("loss_tokens", "sum"))
    assert by.tokens.max() <= 256 and by.segments.max() <= 6 and by.loss.max() <= 120
    assert (by.tokens == 256).any() and (by.loss == 120).any()
    own = packing.encoder(path)
    for i, prompt, text in rows:
        n = lambda t: len(own.tokenizer.encode(t or "", add_special_tokens=False).ids)
        mine = got[got.doc_id == i]
        assert mine.length.sum() == n((prompt or "") + (text or "")) + 1 and mine.loss_tokens.sum() == mine.length.sum() - n(prompt), i


def test_archives_of_odd_pages(spark, monkeypatch):
    """Keys with braces and line ends, payloads over an archive's bytes, repeated rows, null columns."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 14)
    rows = [(1, "http://a.b/x {y", "<p>1"), (2, 'http://a.b/"\n{', None), (3, None, "x" * 70000), (4, "http://c.d/", "x" * 70000), (None, "http://c.d/", "x" * 70000), (5, "u", "<p>1"), (5, "u", "<p>1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.archive_round_trip(pages).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(1, 4, "revisit", 5, sha("<p>1")), (2, 0, "response", None, sha("")), (3, 70000, "revisit", 4, sha("x" * 70000)), (4, 70000, "response", None, sha("x" * 70000)),
            (0, 70000, "response", None, sha("x" * 70000)), (5, 4, "response", None, sha("<p>1")), (5, 4, "response", None, sha("<p>1"))]
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_decontamination_rows(spark):
    """Each row by its own text: no id, shared ids, clashing names, ties."""
    item = say(30)
    rows = [(None, say(50) + " " + item, "a"), (None, say(60), "b"), (7, item + " " + say(20), "c"), (7, say(70), "d"), (8, None, "e"), (9, "", "f"), (7, say(70) + " z", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, caught_id string")
    items = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (2, None, "z")], "item_id long, text string, caught_text string")
    got = contamination.decontaminated(docs, items)
    assert got.columns == docs.columns and sorted(r.caught_id for r in got.collect()) == ["b", "d", "d", "e", "f"]
    assert contamination.decontaminated(docs.limit(0), items).count() == 0 and contamination.decontaminated(docs, items.limit(0)).count() == len(rows)


def test_quality(docs, labels):
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        w, seen, dup = words(t), set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        count = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q = quality.quality_rules(docs, labels).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert (q.kept == (q.quality == 1)).mean() > 0.95
    t = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (t.predicted == t.toxic).mean() > 0.85 and t.score.between(0, 1).all()


def test_toxicity_odd_rows(docs, labels):
    got = toxicity.toxicity_scores(docs, labels).toPandas()
    assert len(got) == len(TEXTS) + 1 and got.predicted.eq(0).all()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_label_model(seed):
    """On made votes the model finds each voter's rates, which voters copy each other, and the class better than
    any voter does, without labels."""
    rng = np.random.default_rng(seed)
    y = rng.random(4000) < 0.3
    rates = np.array([(0.02, 0.7), (0.05, 0.6), (0.1, 0.8), (0.03, 0.5), (0.15, 0.6)])
    alone = rng.random((4000, 5)) < np.where(y[:, None], rates[:, 1], rates[:, 0])
    copies = np.where(rng.random((4000, 2)) < 0.03, ~alone[:, 4:], alone[:, 4:])  # two more voters that copy the last
    votes = np.hstack([alone, copies]).astype(float)
    post, found, related = toxicity.label_model(votes, 0.3, patterns=0)
    assert np.abs(found.T[:4] - rates[:4]).max() < 0.06
    assert related[4, 5] > 0.7 and related[5, 6] > 0.7 and related[:4, :4].max() < 0.2
    right = ((post > 0.5) == y).mean()
    assert right > 0.93 and right > max(((v > 0) == y).mean() for v in votes.T)


def test_lexica_vote_on_rows_they_were_not_mined_from():
    """A word that one fold alone has in class 1 votes nowhere in that fold; one of all folds votes in each."""
    n = 400
    y = np.arange(n) % 2.0
    y[:] = (np.arange(n) // toxicity.FOLDS) % 2
    fold = np.arange(n) % toxicity.FOLDS
    text = pa.array([" ".join(["foul foul"] * bool(y[i]) + ["lone lone"] * bool(y[i] and fold[i] == 0) + [say(30)]) for i in range(n)])
    units = toxicity._units(text)
    votes = toxicity.voters(text, y, units, toxicity._features(*units))
    assert np.array_equal(votes[:, 0], y)
    only = pa.array([t.replace("foul", "fair") for t in text.to_pylist()])
    units = toxicity._units(only)
    assert not toxicity.voters(only, np.where(fold == 0, y, 0), units, toxicity._features(*units))[fold == 0, 0].any()


def test_toxicity_held_out_recall(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    t = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    toxic = t.toxic == 1
    assert (t.predicted[toxic] == 1).mean() > 0.85 and (t.predicted[~toxic] == 1).mean() < 0.005


def test_toxicity_reads_accents_long_texts_and_odd_bytes(spark):
    say_no = "RÉEUXAN idées"
    a, b = (toxicity._units(pa.array([x])) for x in (say_no, say_no.lower()))
    assert all(np.array_equal(x, z) for x, z in zip(a, b, strict=True))
    foul = [(i, (say(20) + " vile vile") if i % 2 else say(20), i % 2) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in foul], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in foul] + [(900, " ".join([*(f"other{i}" for i in range(200_000)), "vile " * 4000])), (901, "x" * 2_000_000)], "doc_id long, text string")
    odd = spark.sql("select 902L as doc_id, cast(unhex('FF76696C65FE') as string) as text")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs.unionAll(odd), labels).filter("doc_id >= 900").collect()}
    assert got == {900: 1, 901: 0, 902: 0}
    empty = toxicity.toxicity_scores(docs.limit(0), labels)
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "score", "predicted"]


def test_licences(spark):
    lines = ["Released under the MIT License.", say(20), None, "", "Intro words\nLicensed under the Apache License, Version 2.0."]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in licences.scan(df).collect()}
    assert got == {(0, 0): ("mit", True), (4, 1): ("apache-2.0", True)}


def test_licence_versions_and_dual_licences(spark):
    lines = ["This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY 3.0.", "Released under the 2-clause BSD License.", "Licensed under CC BY 7.0.",
             "This work is licensed under the GNU General Public License, version 9.", "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
             "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under CC BY-NC-SA 4.0."]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in licences.scan(df).collect() if r.confirmed}
    assert got == {(0, "gpl-2.0"), (1, "cc-by-3.0"), (2, "bsd-2-clause"), (5, "mit"), (5, "apache-2.0"), (6, "lgpl-3.0"), (7, "cc-by-nc-sa-4.0")}


def test_contamination(spark):
    item = say(30)
    rows = [(1, say(400) + " " + item.upper() + " " + say(400)), (2, say(50)), (3, None), (4, " ".join(item.split()[:10])), (5, "three short words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, ""), (9, None), (10, "short words")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.item_shingles) for r in contamination.leaks(df, items).orderBy("doc_id", "item_id").collect()] == [(1, 7, 26), (5, 10, 1)]
    assert {r.doc_id for r in contamination.decontaminated(df, items).collect()} == {2, 3, 4}
    assert contamination.leaks(df, items.limit(0)).count() == 0


def test_items_that_share_an_id(spark):
    a, b, c, d = (say(30) for _ in range(4))
    docs = spark.createDataFrame([(k, f"{say(100)} {t} {say(100)}") for k, t in enumerate((a, b, c, d, say(30)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, a), (7, b), (7, b), (None, c), (None, d), (None, None), (7, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in contamination.leaks(docs, items).collect()) == [(0, 7, 26, 26), (1, 7, 26, 26), (2, None, 26, 26), (3, None, 26, 26)]
    assert {r.doc_id for r in contamination.decontaminated(docs, items).collect()} == {4}


@pytest.mark.parametrize("broadcast_rows", [warc.BROADCAST_ROWS, 0])
def test_warc(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)  # 0: the salted join
    bodies = ["<p>x</p>", None, "", "y\r\n\r\nWARC/1.1\r\n", "<p>é</p>", "<p>x</p>", "<p>x</p>"]
    df = spark.createDataFrame([(i, f"http://A.b.com/{i}" if i != 2 else None, h) for i, h in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(df, f"file://{tmp_path}/w").collect()}
    for i, h in enumerate(bodies):
        raw = (h or "").encode()
        last = max(j for j, x in enumerate(bodies) if (x or "") == (h or ""))
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), None if i == last else last)
    found = warc.lookup(spark, f"file://{tmp_path}/w/index", "http://a.b.com/3")
    assert warc.read_range(spark, found[0]).endswith(b"y\r\n\r\nWARC/1.1\r\n\r\n\r\n")


def test_many_keys_are_looked_up_through_directory_and_blocks(spark, tmp_path):
    """A key that fills many blocks of several parts, keys at the ends of blocks, unknown and null keys, against a plain filter."""
    url = lambda i: None if i % 50 == 7 else "http://hot.org/" if i % 3 == 0 else f"http://h{i % 40}.org/{i % 7}"
    pages = spark.createDataFrame([(i, url(i), f"<p>{i % 11}</p>" * (i % 9), "x") for i in range(900)], "page_id long, url string, html string, Key string").repartition(3)
    warc.write_archives(pages, f"file://{tmp_path}/a")
    captures = warc.read_archives(spark, f"file://{tmp_path}/a").cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of so few rows
    try:
        warc.write_index(captures, f"file://{tmp_path}/i", block_lines=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"file://{tmp_path}/i/directory").select("part").distinct().count() > 1
    every = {r.page_id: r for r in captures.collect()}
    assert len(every) == 900 and captures.count() == 900
    for asked in (["http://hot.org/", "http://h1.org/1", "http://none.org/", "http://h1.org/1"], [f"http://h{i}.org/{j}" for i in range(40) for j in range(7)], [None], []):
        keys = spark.createDataFrame([(a,) for a in asked], "url string").select(warc.surt(F.col("url")).alias("key"))
        got = sorted(tuple(r) for r in warc.read_ranges(warc.lookups(spark, f"file://{tmp_path}/i", keys)).collect())
        assert got == sorted(tuple(every[i]) for i in range(900) if url(i) in asked)


@pytest.mark.parametrize("change", ["payload", "length", "other"])
def test_records_that_contradict_their_captures_are_errors(spark, tmp_path, change):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", f"<p>page {i}</p>") for i in range(4)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/a")
    captures = spark.createDataFrame(warc.read_archives(spark, f"file://{tmp_path}/a").collect(), warc.CAPTURE)
    assert warc.read_ranges(captures).count() == 4
    if change == "payload":
        for f in (tmp_path / "a").glob("part-*"):
            f.write_bytes(f.read_bytes().replace(b"page 2", b"page 9"))
        for f in (tmp_path / "a").glob(".part-*.crc"):
            f.unlink()
    elif change == "length":
        captures = captures.withColumn("length", F.col("length") - 1)
    else:
        captures = captures.withColumn("page_id", F.col("page_id") + 1)
    with pytest.raises(Exception, match="digest|not of|another"):
        warc.read_ranges(captures).collect()


def test_ranges_are_read_from_their_offset(spark, tmp_path):
    name = tmp_path / "sparse"
    with name.open("wb") as f:  # more than binaryFile holds, nearly no disk
        f.seek((1 << 31) + 5)
        f.write(b"record")
    assert warc.read_range(spark, {"file": f"file://{name}", "offset": (1 << 31) + 6, "length": 4}) == b"ecor"


LONG = "The committee met on Tuesday to discuss the plans for the new bridge, and several members raised questions about cost and safety before the vote."
REPLY = "I completely disagree with this article, because the author forgets that the old bridge was closed for years, and nobody in town complained about it at all."


@pytest.mark.parametrize(("page", "main"), [
    (f'<div class="content"><h1>Bridge plans</h1><p>{LONG}</p><p>{LONG} Again.</p><div id="comments"><p>{REPLY}</p></div></div>', [1, 1, 1, 0]),
    (f'<main><h1>Bridge plans</h1><p>{LONG}</p><ul><li>Two lanes for cars</li><li>A path for bicycles</li><li>Lights</li></ul><p>{LONG}</p></main><footer>All rights reserved</footer>', [1, 1, 1, 1, 1, 1, 0]),
    (f'<table><tr><td><a href=a>Home</a> <a href=b>News</a></td></tr><tr><td><h1>Bridge plans</h1><p>{LONG}</p><p>{LONG} Again.</p></td></tr><tr><td>All rights reserved</td></tr></table>', [0, 1, 1, 1, 0])])
def test_comments_lists_and_tables(labeller, page, main):
    blocks = extraction.blocks_of(f"<html><body>{page}</body></html>")
    assert labeller.label(extraction.features([blocks]))[0].tolist() == list(map(bool, main))


def test_odd_rows_of_pages(spark):
    """Null ids and html, repeated rows, other columns with the names of results or of the plan; an empty table."""
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>Bridge plans</h1><p>{LONG}</p></article></body></html>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", None), (3, "u", "")]
    pages = spark.createDataFrame([(*r, "x", 7, 9) for r in rows], "page_id long, url string, html string, text string, n_chars int, o long")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in extraction.main_text(pages).collect()]
    assert len(got) == 5 and got.count((2, "u", "", 0)) == 1 and got.count((3, "u", "", 0)) == 1
    whole = [t for k, _, t, n in got if k not in (2, 3) and n == len(t)]
    assert len(whole) == 3 and len(set(whole)) == 1 and LONG in whole[0]
    assert extraction.main_text(pages.limit(0)).collect() == []


@pytest.fixture(scope="module")
def labeller(spark):
    """A labeller of the pages of sf0.01."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    return extraction.train([p for p in pages if p][: extraction.PAGES])


def test_extraction(spark):
    page = ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class=ad>Buy now</div><article><h1>A &amp; b</h1><p><b>One\n two<br><p>Three four five.</p></article>"
            "<footer>(c)</footer></body></html>")
    pages = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", "")] + [(k, "z", page.replace("Three", say(12))) for k in range(4, 40)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.main_text(pages).collect()}
    assert got[1] == ("A & b\nOne two\nThree four five.", 30) and got[2] == got[3] == ("", 0)


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><body><p>One two</p><p>three", "<head><meta charset=utf-8><link rel=x><p>One two</p><p>three", "<head><style>a{}</style>One two<p>three",
    "<html><head></head><body><svg width=1 /><p>One two</p><MATH/><p>three", "<body><svg class='a>/' d=\"/>\"/><p>One two</p><p>three<svg><path d=1 />x</svg>",
    "<body><p>One two</p><svg xmlns=http://a.b/c><g/>x</svg><math><mi/>y</math><p>three"])
def test_pages_with_open_heads_and_self_closed_elements(page):
    assert [t for _, t, _ in extraction.blocks_of(page)] == ["One two", "three"]


@pytest.mark.parametrize("page", ["<body><p>One two</p><object data=x><p>three", "<p>One two</p><select><p>three", "<p>One two<svg><p>three</p><script>x", "<p>One two</p><textarea></textarea><p>three<a href='x>", "<title><p>One two<p>three"])
def test_elements_left_open(page):
    assert [t for _, t, _ in extraction.blocks_of(page)] == ["One two", "three"]


@pytest.mark.parametrize("part", ["<a ", '<a "', '<a b="', "<svg '", "<object>", "<!", "</", "<!--", "<title>", "<p>x", "</x>"])
def test_long_pages_are_read_once(part):
    start = time.process_time()
    extraction.blocks_of("<body>" + part * (1_000_000 // len(part)))
    assert time.process_time() - start < 10


def test_deep_pages_keep_their_text():
    assert [t for _, t, _ in extraction.blocks_of("<div>x" * 1000 + "</div>" * 1000 + "y")] == ["x"] * 1000 + ["y"]


def test_held_out_pages(spark):
    """Pages that training didn't see: as they are, without the element around the text, and with a name that says nothing."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").orderBy("page_id").collect()]
    model = extraction.train(pages[::2][:150])
    held = pages[1::2]
    truth = [[extraction.silver(path) for path, _, _ in extraction.blocks_of(p)] for p in held]
    for change, most in (((r"$^", ""), 0.001), ((r"</?(?:article|main)\b[^>]*>", ""), 0.02), ((r"<(/?)(?:article|main)\b[^>]*>", r"<\1div class=q7>"), 0.05)):
        found = [extraction.blocks_of(re.sub(*change, p)) for p in held]
        got = model.label(extraction.features(found))
        wrong = sum(sum(a != b for a, b in zip(y, g.tolist(), strict=True)) for y, g in zip(truth, got, strict=True))
        assert wrong <= most * sum(map(len, truth)), (change, wrong)


def test_training_learns_whole_pages(monkeypatch):
    seen = []
    known = extraction.Labeller.gradients
    monkeypatch.setattr(extraction.Labeller, "gradients", lambda self, x, mask, y: seen.append(int(mask.sum(axis=1).max())) or known(self, x, mask, y))
    extraction.train(["<article>" + "".join(f"<p>word {k}</p>" for k in range(300)) + "</article><footer>end</footer>"], epochs=1)
    assert max(seen) >= 301


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, d).cache()
        assert docs_out.columns == docs.columns and 0 < docs_out.count() <= n, name
        docs, n = docs_out, docs_out.count()
    packed = corpus_pipeline.packing(spark, docs, d)
    assert packed.select(F.countDistinct("doc_id")).first()[0] == n


def test_passages_that_texts_share(spark):
    """Against brute force: runs of words that another text has, with other white space too; one word short, in one text alone and in copies alone they stay."""
    rng = random.Random(11)
    tell = lambda n: [f"w{rng.randint(0, 10**6)}é" for _ in range(n)]
    a, b, short, own = tell(50), tell(73), tell(49), tell(60)
    texts = [" ".join(x) for x in (tell(30) + a + tell(5) + b, b + tell(80), tell(9) + a, tell(40) + short + tell(3), short + tell(70), own + tell(4) + own, a + b + tell(20))]
    texts += ["\n\t".join(tell(3) + a + tell(60)), " ".join(tell(90)), None, "", " \n ", "x " * 200, " ".join(tell(10) + b[:55]) + "\n"]
    texts.append(texts[8])
    split = lambda t: [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
    owners = {}
    for t in texts:
        w = [x[2] for x in split(t)]
        for k in range(len(w) - 49):
            owners.setdefault(tuple(w[k : k + 50]), set()).add(t)
    want = []
    for i, t in enumerate(texts):
        w, gone = split(t), set()
        for k in range(len(w) - 49):
            if len(owners[tuple(x[2] for x in w[k : k + 50])]) > 1:
                gone |= set(range(w[k][0], w[k + 49][1]))
        want.append((i, None if t is None else "".join(c for k, c in enumerate(t) if k not in gone)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text")).repartition(3)
    got = passages.without_passages(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == want and all(r.text is None or r.n_chars == len(r.text) for r in got)
    assert sum(x[1] != t for x, t in zip(want, texts, strict=True)) == 6
    assert passages.without_passages(docs.limit(0)).count() == 0


def test_suffix_dedup_shows_passages(spark, tmp_path):
    """op10's text against brute force: passages of 50 words and more of under 400 bytes are out of it, strings of 400 bytes too; the other columns follow the strings alone."""
    from trailmill.llm import queries

    rng = random.Random(12)
    tell = lambda n: " ".join(str(rng.randint(0, 9999)) for _ in range(n))
    a, b, long, body = tell(52), tell(49), tell(120), tell(100)
    assert len(a) < 400 < len(long)
    texts = [f"{tell(30)} {a} {tell(9)}", f"{a}\n{tell(80)} {b}", f"{b} {tell(4)} {a} {long}", f"{tell(20)} {long} {tell(70)}", "ü" + body + "é", "ļ" + body + "ö", tell(90), None, "", tell(60)]
    texts += [texts[6], texts[9]]
    depth, raw = 400, [(t or "").encode() for t in texts]
    count = Counter(x[p : p + depth] for x in raw for p in range(len(x) - depth + 1))
    found = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)] for x in raw]
    owners = {}
    for x, w in zip(raw, found, strict=True):
        for k in range(len(w) - 49):
            owners.setdefault(tuple(y[2] for y in w[k : k + 50]), set()).add(x)
    want = []
    for i, (x, w) in enumerate(zip(raw, found, strict=True)):
        gone, shared = set(), set()
        for p in range(len(x) - depth + 1):
            if count[x[p : p + depth]] > 1:
                gone |= set(range(p, p + depth))
        for k in range(len(w) - 49):
            if len(owners[tuple(y[2] for y in w[k : k + 50])]) > 1:
                shared |= set(range(w[k][0], w[k + 49][1]))
        parts = "".join(chr(c) if k not in gone | shared else "\n\n\n" for k, c in enumerate(x)).split("\n\n\n")
        kept = bytes(c for k, c in enumerate(x) if k not in gone)
        want.append((i, len(x), len(gone), hashlib.sha256(kept).hexdigest(), len(shared - gone), "".join(y.encode("latin-1").decode(errors="ignore") for y in parts)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_suffix_dedup(spark, str(tmp_path)).orderBy("doc_id")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "text"]
    rows = got.collect()
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256, r.n_passage_bytes, r.text) for r in rows] == want
    assert all(a not in r.text for r in rows) and [b in r.text for r in rows[1:3]] == [True, True]
    assert rows[0].n_removed == 0 < rows[0].n_passage_bytes and rows[4].text == rows[5].text == ""


def test_packing_leaves_no_memory_behind(spark, docs):
    """Workers outlive their tasks: none keeps an encoder, plain texts load one vocabulary, and waiting pieces hold no ids but their own."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")

    def held(batches):
        import gc

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "UnitEncoder" for x in gc.get_objects())], pa.int64())], ["n"])

    assert packing.pack_documents(docs, path).count()
    assert spark.range(64, numPartitions=16).mapInArrow(held, "n long").agg(F.sum("n")).first()[0] == 0
    own, data = packing.encoder(path), np.frombuffer(BASE.encode(), np.uint8)
    ids, _ = own.encode(data, np.array([0, len(data)]))
    assert "tokenizer" not in vars(own) and ids.tolist() == [*own.tokenizer.encode(BASE, add_special_tokens=False).ids, 0]
    packer = packing.Packer(0, 1024, 512, 1024)
    packer.add(1, np.zeros(1 << 16, np.int32)[5:25], np.ones(1 << 16, bool)[5:25])
    assert [p[2].base is None and p[3].base is None for p in packer.waiting] == [True]
