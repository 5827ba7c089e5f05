"""Conversation structure repair: the cheapest edits that give a conversation legal roles.

Roles must follow (system? (user assistant)+)?, so a conversation is read with one of four states. Going backward
over its turns, each state gets its cost-to-go: the least cost of edits that bring the rest to a legal end. A greedy
walk forward then takes, among the edits that stay on that cost, the one whose initial comes first in ASCII.

Costs-to-go differ between states by a few units only, so they are kept as a vector of differences and an offset;
there are a handful of such vectors, and a turn costs a look-up.

A conversation of bounded size is repaired as its sorted rows stream through a task. A longer one is cut into
segments that Spark deals out by range: each segment gives its matrix of costs between states, these are multiplied
backward, and each segment then walks with the costs known at its end, for every state it may start in. Only the hash
of a long conversation's text has to run over its segments in order; they stream, and memory doesn't grow with it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.shared import written
from trailmill.llm import textkit as tk

#: A conversation with more rows or bytes is cut into segments of about that size.
ROWS, BYTES = 20_000, 8 << 20
INF = 1 << 40
#: States: at the start, after system, after user, after assistant. Letters that each accepts, and the one it wants.
ADVANCE = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE = "uuau"
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
EMPTY = hashlib.sha256(b"").hexdigest()
LONGEST = (1 << 63) - 1
#: A turn as the grammar sees it: its role's letter or "", whether it must go, whether it is truncated.
Kind = tuple[str, bool, bool]
Costs = tuple[int, ...]


@functools.cache
def with_inserts(costs: Costs) -> Costs:
    """Costs-to-go where turns may be inserted first."""
    for _ in range(3):
        costs = tuple(min(c, 2 + costs[ADVANCE[s][DUE[s]]], INF) for s, c in enumerate(costs))
    return costs


END = with_inserts((0, INF, INF, 0))


@functools.cache
def edits(kind: Kind, state: int) -> tuple[tuple[str, int, int], ...]:
    """(initial, cost, next state) of what may be done with a turn."""
    letter, doomed, cut = kind
    out = [("D", 3, state)]
    if not doomed:
        if letter in ADVANCE[state]:
            out.append(("K", int(cut), ADVANCE[state][letter]))
        out.append(("R", 2 + cut, ADVANCE[state][DUE[state]]))
    return tuple(out)


@functools.cache
def before(kind: Kind, after: Costs) -> tuple[int, Costs]:
    """Costs-to-go before a turn from those after it: the least, and what each state has above that."""
    full = with_inserts(tuple(min(cost + after[to] for _, cost, to in edits(kind, s)) for s in range(4)))
    return min(full), tuple(min(c - min(full), INF) for c in full)


def backward(kinds: list[Kind], end: Costs = END) -> tuple[int, list[Costs]]:
    """The offset of the first costs, and the costs before each turn and at the end."""
    total, out = 0, [end]
    for kind in reversed(kinds):
        low, costs = before(kind, out[-1])
        total += low
        out.append(costs)
    return total, out[::-1]


@functools.cache
def step(kind: Kind, after: Costs, state: int) -> tuple[str, str, int]:
    """(edits' initials, letters of the turns they give, next state) at a turn.

    A kept turn's letter is a dot, an inserted one's is small, a capital is a new role for the turn's text.
    """
    low, here = before(kind, after)
    initials = letters = ""
    while True:
        tight = [(name, to) for name, cost, to in edits(kind, state) if low + here[state] == cost + after[to]]
        wanted = DUE[state]
        if here[state] == 2 + here[ADVANCE[state][wanted]]:
            tight.append(("I", ADVANCE[state][wanted]))
        name, to = min(tight)
        initials += name
        letters += {"D": "", "I": wanted, "K": ".", "R": wanted.upper()}[name]
        state = to
        if name != "I":
            return initials, letters, state


@functools.cache
def finish(state: int) -> str:
    """Letters of the turns inserted at the end."""
    return "" if END[state] == 0 else DUE[state] + finish(ADVANCE[state][DUE[state]])


def walk(kinds: list[Kind], costs: list[Costs], state: int) -> tuple[list[str], list[str], int]:
    """The initials and letters at each turn, and the last state."""
    initials, letters = [], []
    for kind, after in zip(kinds, costs[1:], strict=True):
        own, given, state = step(kind, after, state)
        initials.append(own)
        letters.append(given)
    return initials, letters, state


def kinds_of(rows: list[tuple], seen: set | None = None) -> tuple[list[Kind], list[int]]:
    """Kinds of turns (role, digest, blank, ended, again) in order, and counts of blank, duplicate and truncated ones.

    A turn is a duplicate if `again` says so or, with `seen`, if its role and digest are there.
    """
    kinds, counts = [], [0, 0, 0]
    for role, digest, blank, ended, again in rows:
        if seen is not None:
            again = (role, digest) in seen
            seen.add((role, digest))
        fault = 0 if blank else 1 if again else 2 if not ended else None
        if fault is not None:
            counts[fault] += 1
        letter = role[:1]
        kinds.append((letter if letter in "sua" else "", fault in (0, 1), fault == 2))
    return kinds, counts


def _turns(letters: Iterable[str], rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn after repair."""
    for given, (role, text) in zip(letters, rows, strict=True):
        for x in given:
            yield (role, text) if x == "." else (ROLE[x.lower()], text if x.isupper() else "")


def _gaps(turns: Iterable[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return min(max(known) - min(known) + 1 - len(known), LONGEST) if known else 0


def _illegal(letters: list[str]) -> int:
    return sum(pair not in LEGAL for pair in itertools.pairwise(letters))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations(conv_id, turn, role, text) with faults of known places.

    crc32 of `conv_id:turn` modulo 20 decides: 0 drops a row, 1 empties its text, 2 takes its `.!?` away, 3 repeats
    it, 4 makes the role user. A null role or text, and a null in that name, counts as one space. A null turn stays
    null. Other columns are ignored; an empty table stays empty.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(lot == 1, F.lit("")).when(lot == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(lot == 4, F.lit("user")).otherwise(word("role"))
    times = F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter(lot != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _key(name: str = "conv_id") -> Column:
    """A conversation's key that is never null."""
    return F.when(F.col(name).isNull(), F.lit("none")).otherwise(F.concat(F.lit("id "), F.col(name).cast("string")))


def _read(rows: DataFrame) -> DataFrame:
    """Rows with their conversation's key, a digest of the text, and whether it is blank, or ends as a sentence does."""
    told = tk.bounded(rows).select(_key().alias("key"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return told.select("*", F.md5("text").alias("digest"), (~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"), F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")).alias("ended"))


ORDER = ("turn", "role", "digest", "text")


def _streamed(one: Callable[[str, list[tuple]], Iterator[tuple]], schema: pa.Schema):
    """Runs `one` on each conversation of rows sorted by key; only one conversation is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "digest", "blank", "ended")), strict=True))
        out: list[tuple] = []
        size = 0
        for key, own in itertools.groupby(rows, key=lambda r: r[0]):
            for row in one(key, [r[1:] for r in own]):
                out.append(row)
                size += 64 + sum(len(x) for x in row if isinstance(x, str))
                if size >= tk.BATCH_BYTES // 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return tk.lean(run)


def _repaired(rows: list[tuple]) -> tuple[list[str], list[str], int, list[int]]:
    """Initials and letters at each turn of a whole conversation and at its end, the cost, and the counts of faults."""
    kinds, counts = kinds_of([(role, digest, blank, ended, None) for _, role, _, digest, blank, ended in rows], set())
    total, costs = backward(kinds)
    initials, letters, state = walk(kinds, costs, 0)
    tail = finish(state)
    return [*initials, "I" * len(tail)], [*letters, tail], total + costs[0][0], counts


def _reported(key: str, rows: list[tuple]) -> Iterator[tuple]:
    initials, letters, cost, counts = _repaired(rows)
    digest = hashlib.sha256()
    for k, (role, text) in enumerate(_turns(letters, [*((r[1], r[2]) for r in rows), ("", "")])):
        digest.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
    yield key, _gaps(r[0] for r in rows), *counts, _illegal([r[1][:1] for r in rows]), cost, "".join(initials), digest.hexdigest()


def _rebuilt(key: str, rows: list[tuple]) -> Iterator[tuple]:
    _, letters, _, _ = _repaired(rows)
    for k, (role, text) in enumerate(_turns(letters, [*((r[1], r[2]) for r in rows), ("", "")])):
        yield key, k, role, text


_REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURN = "key string, place long, role string, text string"
_ARROW = {"string": pa.string(), "long": pa.int64()}
_schema = lambda ddl: pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _whole(rows: DataFrame, one: Callable, ddl: str) -> DataFrame:
    """Conversations of bounded size: their rows meet in one task, sorted, each conversation held alone."""
    return rows.repartition("key").sortWithinPartitions("key", *ORDER).mapInArrow(_streamed(one, _schema(ddl)), ddl)


def _sizes(rows: DataFrame) -> DataFrame:
    """(key, conv_id, n, bytes) of each conversation, summed in the tasks that read it."""
    return rows.groupBy(_key().alias("key")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("role").cast("string")), F.lit(0)) + 64).alias("bytes"))


def _split(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of the conversations of bounded size, those of the others (None: there are none), and how many segments these make."""
    big = (F.col("n") > ROWS) | (F.col("bytes") > BYTES)
    much = sizes.filter(big).agg(F.count("*"), F.sum("n"), F.sum("bytes")).first()
    if not much[0]:
        return rows, None, 0
    long = written(sizes.filter(big).select("key"), "conversations-long")  # at most one for BYTES of the table
    return rows.join(long, "key", "left_anti"), rows.join(long, "key", "left_semi"), int(much[1] // ROWS + much[2] // BYTES + 1)


class _Segments:
    """The long conversations, cut by range into segments whose turns have kinds, costs at their ends and states at their starts."""

    def __init__(self, rows: DataFrame, pieces: int) -> None:
        # equal rows may lie in several segments: they are dealt out by a number that any order of them serves
        numbered = rows.withColumn("salt", F.monotonically_increasing_id())
        dealt = numbered.repartitionByRange(2 * pieces, "key", "turn", "role", "digest", "salt").sortWithinPartitions("key", *ORDER, "salt")
        self.rows = written(dealt.drop("salt").withColumn("pos", F.monotonically_increasing_id()).withColumn("seg", F.shiftright("pos", 33)), "conversations-segments")
        slim = self.rows.select("key", "seg", "pos", "turn", "role", "digest", "blank", "ended")
        first = slim.groupBy("key", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        known = slim.join(first, ["key", "role", "digest"], "left").select("key", "seg", "pos", "turn", "role", "digest", "blank", "ended", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)).alias("again"))
        self.kinds = written(known, "conversations-kinds")
        parts = written(self.kinds.groupBy("key", "seg").applyInPandas(_summary, "key string, seg long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, least array<long>"), "conversations-sums")
        ends = written(parts.groupBy("key").applyInPandas(_ends, "key string, seg long, costs array<long>"), "conversations-ends")
        maps = self.kinds.groupBy("key", "seg").cogroup(ends.groupBy("key", "seg")).applyInPandas(_maps, "key string, seg long, costs array<long>, to array<long>")
        self.starts = written(maps.groupBy("key").applyInPandas(_starts, "key string, seg long, costs array<long>, state long, tail string"), "conversations-starts")
        self.sums = parts.groupBy("key").applyInPandas(_totals, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")

    def walked(self, one: Callable[[pd.DataFrame, list[str], list[str]], pd.DataFrame], ddl: str) -> DataFrame:
        """`one` of each segment's sorted rows, initials and letters (one more for what is inserted at the end)."""

        def run(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("pos", ignore_index=True)
            kinds, _ = kinds_of(list(rows[["role", "digest", "blank", "ended", "again"]].itertuples(index=False, name=None)))
            _, costs = backward(kinds, tuple(int(c) for c in start.costs[0]))
            initials, letters, _ = walk(kinds, costs, int(start.state[0]))
            tail = start["tail"][0]
            return one(rows, [*initials, "I" * len(tail)], [*letters, tail])

        flagged = self.rows.join(self.kinds.select("key", "seg", "pos", "again"), ["key", "seg", "pos"])
        return flagged.groupBy("key", "seg").cogroup(self.starts.groupBy("key", "seg")).applyInPandas(run, ddl)


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    """A segment's figures, and at 4 * s + t of `least` the least cost from state s at its start to t at its end."""
    rows = rows.sort_values("pos", ignore_index=True)
    kinds, counts = kinds_of(list(rows[["role", "digest", "blank", "ended", "again"]].itertuples(index=False, name=None)))
    least = [INF] * 16
    for t in range(4):
        low, costs = backward(kinds, tuple(0 if s == t else INF for s in range(4)))
        for s in range(4):
            least[4 * s + t] = min(low + costs[0][s], INF)
    turns = rows.turn.dropna()
    initial = rows.role.str[:1].tolist()
    row = (rows.key[0], int(rows.seg[0]), int(turns.min()) if len(turns) else None, int(turns.max()) if len(turns) else None, turns.nunique(), *counts, _illegal(initial), initial[0], initial[-1], least)
    return pd.DataFrame([row], columns=["key", "seg", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "least"]).astype({"low": "Int64", "high": "Int64"})


def _ends(parts: pd.DataFrame) -> pd.DataFrame:
    """The costs at each segment's end, from a conversation's last segment to its first."""
    costs, out = END, []
    for key, seg, least in parts.sort_values("seg", ascending=False)[["key", "seg", "least"]].itertuples(index=False, name=None):
        out.append((key, seg, list(costs)))
        costs = tuple(min(INF, *(int(least[4 * s + t]) + costs[t] for t in range(4))) for s in range(4))
        costs = tuple(min(c - min(costs), INF) for c in costs)
    return pd.DataFrame(out, columns=["key", "seg", "costs"])


def _maps(rows: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
    """Where a segment's walk ends from each state it may start in."""
    rows = rows.sort_values("pos", ignore_index=True)
    kinds, _ = kinds_of(list(rows[["role", "digest", "blank", "ended", "again"]].itertuples(index=False, name=None)))
    _, costs = backward(kinds, tuple(int(c) for c in end.costs[0]))
    return pd.DataFrame([(end.key[0], end.seg[0], list(end.costs[0]), [walk(kinds, costs, s)[2] for s in range(4)])], columns=["key", "seg", "costs", "to"])


def _starts(maps: pd.DataFrame) -> pd.DataFrame:
    """The state that each segment starts in, and what is inserted after the last."""
    maps, state, out = maps.sort_values("seg", ignore_index=True), 0, []
    for k, (key, seg, costs, to) in enumerate(maps[["key", "seg", "costs", "to"]].itertuples(index=False, name=None)):
        out.append((key, seg, list(costs), state, finish(int(to[state])) if k == len(maps) - 1 else ""))
        state = int(to[state])
    return pd.DataFrame(out, columns=["key", "seg", "costs", "state", "tail"])


def _totals(parts: pd.DataFrame) -> pd.DataFrame:
    """A conversation's figures from those of its segments, which follow one another."""
    parts = parts.sort_values("seg", ignore_index=True)
    costs, blank, duplicate, truncated = END, *(int(parts[c].sum()) for c in ("blank", "duplicate", "truncated"))
    for least in parts.least[::-1]:
        costs = tuple(min(INF, *(int(least[4 * s + t]) + costs[t] for t in range(4))) for s in range(4))
    illegal = int(parts.illegal.sum()) + _illegal_between(parts)
    known = parts.dropna(subset=["low"])
    shared = sum(int(a) == int(b) for a, b in zip(known.high[:-1], known.low[1:], strict=True))
    gaps = int(known.high.max()) - int(known.low.min()) + 1 - (int(known.turns.sum()) - shared) if len(known) else 0
    return pd.DataFrame([(parts.key[0], min(gaps, LONGEST), blank, duplicate, truncated, illegal, costs[0])], columns=["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"])


def _illegal_between(parts: pd.DataFrame) -> int:
    return sum(pair not in LEGAL for pair in zip(parts["last"][:-1], parts["first"][1:], strict=True))


def _pieces(rows: pd.DataFrame, initials: list[str], letters: list[str]) -> pd.DataFrame:
    lines = [f"{role}:{text}" for role, text in _turns(letters, [*zip(rows.role, rows.text, strict=True), ("", "")])]
    return pd.DataFrame([(rows.key[0], int(rows.seg[0]), "".join(initials), "\n".join(lines), bool(lines))], columns=["key", "seg", "audit", "text", "some"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from its pieces in order; one piece is held at a time."""
    pieces = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "text", "some")), strict=True))
    for key, own in itertools.groupby(pieces, key=lambda r: r[0]):
        digest, audit, begun = hashlib.sha256(), [], False
        for _, initials, text, some in own:
            audit.append(initials)
            if some:
                digest.update(("\n" * begun + text).encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["key", "audit", "repaired_sha256"])


def _placed(rows: pd.DataFrame, _: list[str], letters: list[str]) -> pd.DataFrame:
    out, k = [], 0
    at = [*rows.pos, int(rows.pos.iloc[-1]) + 1]
    for given, place, own in zip(letters, at, [*zip(rows.role, rows.text, strict=True), ("", "")], strict=True):
        for k, (role, text) in enumerate(_turns([given], [own])):
            out.append((rows.key[0], int(place) * 4 + k, role, text))
    return pd.DataFrame(out, columns=["key", "place", "role", "text"])


def repair_report(rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations(conv_id, turn, role, text).

    A conversation's turns are read by turn, nulls first, turns of one number by role, hash of text and text. audit
    has the initials of the cheapest edits (Keep 0, Rerole 2, Delete 3, Insert 2, and 1 for a truncated turn that
    stays; blank turns and duplicates must go) that give legal roles, of equally cheap ones the ASCII-least; repaired_sha256 is of the turns after them,
    `role:text`, one to a line. There is a row for each conv_id of `asked` (default: `rows`), one for a null conv_id, too;
    without rows it has zeros, no edits and the hash of nothing. A null role or text is one space, a null turn has no
    number. Repeated rows are duplicates of the first. Texts of any length are read whole, conversations of any number
    of turns are repaired in segments; other columns are ignored; an empty table gives an empty table.
    """
    sizes = written(_sizes(rows), "conversations-sizes")
    short, long, pieces = _split(_read(rows), sizes)
    found = _whole(short, _reported, _REPORT)
    if long is not None:
        cut = _Segments(long, pieces)
        texts = cut.walked(_pieces, "key string, seg long, audit string, text string, some boolean")
        hashed = texts.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(tk.lean(_hashed), "key string, audit string, repaired_sha256 string")
        found = found.unionAll(cut.sums.join(hashed, "key").select("key", *NAMES))
    ids = sizes.select("key", "conv_id") if asked is None else asked.groupBy(_key().alias("key")).agg(F.min("conv_id").alias("conv_id"))
    nothing = {"audit": "", "repaired_sha256": EMPTY}
    return ids.join(found, "key", "left").select("conv_id", *(F.coalesce(c, F.lit(nothing.get(c, 0))).alias(c) for c in NAMES))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns after repair, by place within their conversation; see repair_report."""
    sizes = written(_sizes(rows), "conversations-sizes")
    short, long, pieces = _split(_read(rows), sizes)
    found = _whole(short, _rebuilt, _TURN)
    if long is not None:
        found = found.unionAll(_Segments(long, pieces).walked(_placed, _TURN))
    return found.join(sizes.select("key", "conv_id"), "key").select("conv_id", "place", "role", "text")


_WS = "[^\\x20\\x09-\\x0D]"
#: Another way for the same rows: forward over the turns, each state with its least (cost, initials) so far. crc32 is by its bits.
ORACLE_SQL = f"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint)) as bytes from conversations),
lots as (
  select *, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r // 2, case when r % 2 = 1 then 3988292384 else 0 end)))) % 20 as lot from named),
hurt as (
  select conv_id, turn, case lot when 4 then 'user' else role end as role, case lot when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from lots, (select unnest([0, 1]) as copy) where lot <> 0 and (copy = 0 or lot = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), text) as i from hurt),
judged as (
  select *, row_number() over (partition by conv_id, role, text order by i) as seen, substr(role, 1, 1) as l, not regexp_matches(text, '{_WS}') as blank, regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') as ended from placed),
row_ as (
  select *, seen > 1 and not blank as again, not blank and seen = 1 and not ended as cut, blank or seen > 1 as doomed, lag(l) over (partition by conv_id order by i) || l as pair from judged),
-- states n (nothing yet), s, u, a: structs of cost, initials and text; an absent one costs 1e9
went(conv_id, i, n, s, u, a) as (
  select distinct conv_id, cast(0 as bigint), {{'c': 0, 'w': '', 't': ''}}, {{'c': 1000000000, 'w': '', 't': ''}}, {{'c': 2, 'w': 'I', 't': chr(10) || 'user:'}}, {{'c': 4, 'w': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} from hurt
  union all
  select conv_id, i, n, s, u3, least(a2, {{'c': u3.c + 2, 'w': u3.w || 'I', 't': u3.t || chr(10) || 'assistant:'}}) from (
    select *, least(u2, {{'c': n.c + 2, 'w': n.w || 'I', 't': n.t || chr(10) || 'user:'}}, {{'c': s.c + 2, 'w': s.w || 'I', 't': s.t || chr(10) || 'user:'}}, {{'c': a2.c + 2, 'w': a2.w || 'I', 't': a2.t || chr(10) || 'user:'}}) as u3 from (
      select w.conv_id, r.i,
        {{'c': w.n.c + 3, 'w': w.n.w || 'D', 't': w.n.t}} as n,
        least({{'c': w.s.c + 3, 'w': w.s.w || 'D', 't': w.s.t}}, {{'c': case when l = 's' and not doomed then w.n.c + cut::int else 1000000000 end, 'w': w.n.w || 'K', 't': w.n.t || chr(10) || role || ':' || text}}) as s,
        least({{'c': w.u.c + 3, 'w': w.u.w || 'D', 't': w.u.t}},
          {{'c': case when l = 'u' and not doomed then w.n.c + cut::int else 1000000000 end, 'w': w.n.w || 'K', 't': w.n.t || chr(10) || role || ':' || text}},
          {{'c': case when l = 'u' and not doomed then w.s.c + cut::int else 1000000000 end, 'w': w.s.w || 'K', 't': w.s.t || chr(10) || role || ':' || text}},
          {{'c': case when l = 'u' and not doomed then w.a.c + cut::int else 1000000000 end, 'w': w.a.w || 'K', 't': w.a.t || chr(10) || role || ':' || text}},
          {{'c': case when not doomed then w.n.c + 2 + cut::int else 1000000000 end, 'w': w.n.w || 'R', 't': w.n.t || chr(10) || 'user:' || text}},
          {{'c': case when not doomed then w.s.c + 2 + cut::int else 1000000000 end, 'w': w.s.w || 'R', 't': w.s.t || chr(10) || 'user:' || text}},
          {{'c': case when not doomed then w.a.c + 2 + cut::int else 1000000000 end, 'w': w.a.w || 'R', 't': w.a.t || chr(10) || 'user:' || text}}) as u2,
        least({{'c': w.a.c + 3, 'w': w.a.w || 'D', 't': w.a.t}},
          {{'c': case when l = 'a' and not doomed then w.u.c + cut::int else 1000000000 end, 'w': w.u.w || 'K', 't': w.u.t || chr(10) || role || ':' || text}},
          {{'c': case when not doomed then w.u.c + 2 + cut::int else 1000000000 end, 'w': w.u.w || 'R', 't': w.u.t || chr(10) || 'assistant:' || text}}) as a2
      from went w join row_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1))),
told as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again) as duplicate, count(*) filter (where cut) as truncated,
    count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal, count(*) as rows_ from row_ group by conv_id)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(coalesce(least(n, a).c, 0) as bigint) as cost, coalesce(least(n, a).w, '') as audit, sha256(coalesce(substr(least(n, a).t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) ids left join told on told.conv_id is not distinct from ids.conv_id left join went on went.conv_id is not distinct from ids.conv_id and went.i = told.rows_"""
