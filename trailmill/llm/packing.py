"""Vector bin packing of tokenised examples into fixed-length sequences.

Each task tokenises the rows it reads and packs them itself: nothing is shuffled. Full stretches of
`capacity` tokens are sequences of their own; what is left of each text is a piece with a demand on three
limits at once: tokens, segments and loss-bearing tokens. An open sequence takes, again and again, the
piece whose demand has the largest dot product with what the sequence has left. When no whole piece
fits, the best one is cut, so that sequences end up full. The last open sequence of a task is cut into
stretches of powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm import textkit as tk

CAPACITY, MAX_SEGMENTS = 1024, 512
END_ID = 0
#: Pieces among which an open sequence chooses; bounds a task's memory, not what is packed.
POOL = 1024
#: Bytes of texts that are encoded at once.
PIECE = 1 << 18
CACHE_UNITS, CACHE_TOKENS = 250_000, 1_250_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class UnitEncoder:
    """Token ids of whole texts by way of their units, a run of white space and the word after it.

    The vocabulary's splitting pattern never looks across the start of white space, so a unit's ids don't
    depend on its neighbours and equal units are encoded once. Texts with white space beyond ASCII, where
    that doesn't hold, and those that hold the string of an added token are one unit each.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        # a plain call finds these strings in a text before it splits the rest
        self.added = [t["content"] for t in parts.get("added_tokens") or [] if t["content"]]
        self.ranked = self._ranked(parts["model"])
        self.forget()

    @functools.cached_property
    def tokenizer(self):
        """The file's own tokenizer; most tasks need none beside the ranked form."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _ranked(model: dict):
        """The same vocabulary for the library that is faster on single words, if its merges are in the order of their ids."""
        import public_tokenizers
        import tiktoken

        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        rest = [b for b in range(256) if b not in plain]
        letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(letter[x] for x in token): rank for token, rank in model["vocab"].items() if rank < 256 + len(merges)}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, units: list[str]) -> list[list[int]]:
        plain = lambda some: [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        if self.ranked:
            return [plain([u])[0] if any(x in u for x in self.added) else self.ranked.encode_ordinary(u) for u in units]
        return plain(units)

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bounds, self.tokens = np.zeros(1, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _odd(data: np.ndarray) -> np.ndarray:
        """Where white space or a separator beyond the six ASCII ones begins."""
        odd = (data >= 0x1C) & (data <= 0x1F)
        if len(data) > 1:
            odd[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        if len(data) > 2:
            a, b, c = data[:-2], data[1:-1], data[2:]
            odd[:-2] |= ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
            odd[:-2] |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c >= 0x9F)))
        return np.flatnonzero(odd)

    def _special(self, data: np.ndarray) -> np.ndarray:
        """Where strings of added tokens begin."""
        raw = data.tobytes()
        return np.array([m.start() for x in self.added for m in re.finditer(re.escape(x.encode()), raw)], dtype=np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by END_ID, and len + 1 bounds."""
        n = len(offsets) - 1
        space = tk.SEPARATOR[data]
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[1:-1] = space[1:] & ~space[:-1]
        odd = np.unique(np.searchsorted(offsets, np.concatenate((self._odd(data), self._special(data))), side="right") - 1)
        for k in odd:
            begins[offsets[k] : offsets[k + 1]] = False
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        unique, example, inverse = np.unique(tk.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_UNITS or len(self.tokens) > CACHE_TOKENS:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            raw = data.tobytes()
            lo, hi = starts[example[new]], ends[example[new]]
            found = self._ids([raw[a:b].decode() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            slots = len(self.bounds) - 1 + np.arange(len(found))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in found])))
            self.tokens = np.concatenate((self.tokens, np.array([t for x in found for t in x], dtype=np.int32)))
            place = np.searchsorted(self.keys, unique[new])
            self.keys, self.slots = np.insert(self.keys, place, unique[new]), np.insert(self.slots, place, slots)
            at = np.searchsorted(self.keys, unique)
        slot = self.slots[at][inverse] if len(unique) else np.zeros(0, np.int64)
        size = self.bounds[slot + 1] - self.bounds[slot]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        counts = np.bincount(owner, size, n).astype(np.int64) + 1
        bounds = np.concatenate(([0], np.cumsum(counts)))
        ids = np.full(int(bounds[-1]), END_ID, dtype=np.int32)
        heads = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
        inner = np.arange(int(size.sum())) - np.repeat(heads, size)
        ids[np.repeat(heads + owner, size) + inner] = self.tokens[np.repeat(self.bounds[slot], size) + inner]
        return ids, bounds


def encoder(path: str) -> UnitEncoder:
    """An encoder for one task: workers outlive their tasks, and one kept in them would weigh on every later stage."""
    return UnitEncoder(path)


class Packer:
    """Pieces that wait, the open sequence, and the rows of closed ones. A piece is
    [doc_id, start, ids, flags of the ids that bear loss, tokens of the document]."""

    def __init__(self, first_sequence: int, capacity: int, max_segments: int, max_loss: int):
        self.limits = np.array([capacity, max_segments, max_loss], dtype=float)
        self.capacity, self.next = capacity, first_sequence
        self.rows: list[tuple] = []
        self.waiting: list[list] = []

    def close(self, pieces: list[list]) -> None:
        offset = 0
        for doc, start, ids, loss, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, int(loss.sum()), ids))
            offset += len(ids)
        self.next += 1

    def close_last(self, pieces: list[list]) -> None:
        """Cut the last sequence into stretches of powers of two, the longest first."""
        length = sum(len(p[2]) for p in pieces)
        for bit in reversed(range(length.bit_length())):
            room, mine = length & 1 << bit, []
            while room:
                doc, start, ids, loss, total = pieces[0]
                take = min(room, len(ids))
                mine.append([doc, start, ids[:take], loss[:take], total])
                pieces[0] = [doc, start + take, ids[take:], loss[take:], total]
                pieces, room = pieces[take == len(ids) :], room - take
            if mine:
                self.close(mine)

    def add(self, doc: int | None, ids: np.ndarray, loss: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            piece = [doc, at, ids[at : at + self.capacity], loss[at : at + self.capacity], total]
            if len(piece[2]) == self.capacity and piece[3].sum() <= self.limits[2]:
                self.close([piece])
            else:  # a view would keep the ids of all texts around it as long as it waits
                self.waiting.append([doc, at, piece[2].copy(), piece[3].copy(), total])
            at += self.capacity
        if len(self.waiting) >= 2 * POOL:
            self.pack(POOL)

    def pack(self, leave: int = 0) -> None:
        """Fill sequences until at most `leave` pieces wait."""
        items = self.waiting
        demand = lambda p: np.array([len(p[2]), 1, p[3].sum()]) / self.limits
        need = np.array([demand(p) for p in items]).reshape(-1, 3)
        alive, left = np.ones(len(items), dtype=bool), len(items)
        weight = need.mean(axis=0) if len(items) else np.ones(3)
        while left > leave:
            room, mine = np.ones(3), []
            while left and room[0] * self.limits[0] > 0.5 and room[1] * self.limits[1] > 0.5:
                score = np.where(alive & (need <= room + 1e-9).all(axis=1), need @ (weight * room), -1.0)
                best = int(score.argmax())
                piece = items[best]
                if score[best] < 0:  # none fits whole: cut the longest
                    best = int(np.where(alive, need[:, 0], -1).argmax())
                    doc, start, ids, loss, total = items[best]
                    bearing = int(np.searchsorted(np.cumsum(loss), round(room[2] * self.limits[2]), side="right"))
                    take = min(round(room[0] * self.limits[0]), bearing, len(ids))
                    if take < 1:
                        break
                    piece, items[best] = [doc, start, ids[:take], loss[:take], total], [doc, start + take, ids[take:], loss[take:], total]
                    need[best] = demand(items[best])
                else:
                    alive[best], left = False, left - 1
                mine.append(piece)
                room = room - demand(piece)
            if left or leave:
                self.close(mine)
            else:
                self.close_last(mine)
        self.waiting = [p for p, a in zip(items, alive.tolist(), strict=True) if a]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS,
                   max_loss: int | None = None, prompt: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of every row of docs(doc_id, text): where it lies in the text's ids and in which sequence.

    A text's ids are those of the tokenizer at `tokenizer_path` and END_ID, so a null or empty text has
    one id; texts of any length are cut like others. Each id lies in one piece; a sequence holds at most `capacity` ids, `max_segments` pieces and
    `max_loss` loss-bearing ids (`capacity` by default). With `prompt`, a column of instruction data, its
    ids come first and bear no loss; else every id bears loss. `with_ids` adds each piece's ids. Repeated
    rows are packed each on its own and a null doc_id is kept. Further columns are ignored. An empty table
    gives an empty table.
    """
    max_loss = max_loss or capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, max_segments, max_loss)
        enc = encoder(tokenizer_path)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            cols = list(zip(*rows, strict=True)) or [()] * 9
            arrays = [pa.array(c, pa.int64()) for c in cols[:8]] + ([pa.array(cols[8], pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"][: len(arrays)])

        for batch in batches:
            for part, data, offsets in tk.blocks(batch, "text", PIECE):
                ids, bounds = enc.encode(data, offsets)
                if prompt:
                    before = np.diff(enc.encode(*tk.buffers(part.column("prompt")))[1]) - 1
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    mine = ids[bounds[k] : bounds[k + 1]]
                    loss = np.ones(len(mine), dtype=bool)
                    if prompt:
                        loss[: before[k]] = False
                    packer.add(doc, mine, loss)
                if packer.rows:
                    yield out()
        packer.pack()
        yield out()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if prompt:
        columns[1] = F.concat(F.coalesce(F.col(prompt), F.lit("")), F.coalesce("text", F.lit(""))).alias("text")
        columns.append(F.col(prompt).cast("string").alias("prompt"))
    return tk.bounded(docs).select(*columns).mapInArrow(tk.lean(run), SCHEMA + (", ids array<int>" if with_ids else ""))
