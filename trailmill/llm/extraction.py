"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks, each with its tag path, its words and a few counts. A
bidirectional LSTM in numpy reads the whole sequence and labels every block as main text or not. It is
trained here: on a bounded sample of the input's own pages, labelled by the sectioning elements around
each block, and on pages laid out anew from their blocks with other elements and class names.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm import textkit as tk

#: Bounds of the training sample.
PAGES, MAX_CHARS = 150, 60_000
PATH_DIM, WORD_DIM, COUNTS, HIDDEN = 64, 24, 6, 16
INPUT = PATH_DIM + WORD_DIM + COUNTS
SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements by their role in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object textarea select head title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOT_MAIN = frozenset("nav header footer aside form menu button dialog".split())
NOT_MAIN_NAMES = re.compile(r"(?:^|[-_ ])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|header|footer|notice|alert|cookie\w*|consent|popup|comment\w*|reply|replies|respond|related|share|social|breadcrumbs?|pager|pagination|newsletter|subscribe|login|search|widget|toolbar)(?:$|[-_ ])")
MAIN_NAMES = re.compile(r"(?:^|[-_ ])(?:article|content|main|post|entry|story|body|text)(?:$|[-_ ])")

#: Elements nested more deeply are read as if they stood at this depth; their text stays.
DEPTH = 128
#: Elements that may stand in head; any other one, or text outside them, ends a head left open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: What stands in a tag up to its end. Quotes count after "=" only, and a tag left open ends with the page,
#: so that no attempt fails and a page is read once.
_INSIDE = r"(?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-z][^\s/>]*+)({_INSIDE})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|([^<]+|<)", re.S | re.I)
_ENDS = {tag: re.compile(rf"</{tag}\s*+(?:>|\Z)", re.I) for tag in SILENT - {"head"}}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters inside links) of each leaf block; references decoded, white space folded."""
    out, path, buffer, linked, links, headed = [], [], [], 0, 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        if text:
            out.append((tuple(p for p, t in path if t not in INLINE), text, linked))
        buffer.clear()
        linked = 0

    def leave_head() -> None:
        nonlocal headed
        headed = False
        at = next((k for k, (_, t) in enumerate(path) if t == "head"), None)
        if at is not None:
            flush()
            del path[at:]

    at, beyond, unclosed = 0, 0, set()
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m[4]
        if text is not None:
            if headed and path and path[-1][1] == "head" and not text.isspace():
                leave_head()
            buffer.append(text)
            if links:
                linked += len(text)
            continue
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if headed and not m[1] and tag not in IN_HEAD:
            leave_head()
        if tag in _ENDS:  # contents are no text; an element that nothing closes ends at once, a script or style with the page
            if not m[1] and not (tag in ("svg", "math") and m[3].endswith("/")) and tag not in unclosed:
                end = _ENDS[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if m[1]:
            if tag == "a":
                links = max(links - 1, 0)
            if tag not in INLINE:
                flush()
            if beyond:
                beyond -= 1
                continue
            up = next((k for k in range(len(path) - 1, -1, -1) if path[k][1] == tag), None)
            if up is not None and not (tag in INLINE and any(t not in INLINE for _, t in path[up + 1 :])):
                del path[up:]
            continue
        if tag not in INLINE:
            flush()
            links = 0
            while path and path[-1][1] in INLINE:  # left open
                path.pop()
            if tag in CLOSES_P and path and path[-1][1] == "p" or tag == "li" and path and path[-1][1] == "li":
                path.pop()
        if tag in VOID or m[3].endswith("/") and tag in INLINE:
            continue
        if tag == "a":
            links += 1
        if len(path) >= DEPTH:
            beyond += 1
            continue
        names = " ".join("".join(x) for x in _NAMES.findall(m[3])).lower() if "=" in m[3] else ""
        path.append((f"{tag} {names}".strip(), tag))
        headed = headed or tag == "head"
    flush()
    return [(p, t, n) for p, t, n in out if not any(x.split(" ", 1)[0] in SILENT for x in p)]


def silver(path: tuple[str, ...]) -> bool:
    """Whether the elements around a block call it main text."""
    main = False
    for step in path:
        tag, _, names = step.partition(" ")
        if tag in NOT_MAIN and not (tag == "header" and main) or NOT_MAIN_NAMES.search(names):
            return False
        main = main or tag in ("article", "main") or bool(names and MAIN_NAMES.search(names))
    return main


_steps: dict[str, np.ndarray] = {}


def _step(step: str) -> np.ndarray:
    """A hashed vector of one step of a tag path: its element and each part of its names."""
    if step not in _steps:
        if len(_steps) > 50_000:
            _steps.clear()
        v = np.zeros(PATH_DIM, dtype=np.float32)
        tag, _, names = step.partition(" ")
        for k, part in enumerate([tag, *re.split(r"[\s_-]+", names)]):
            if part:
                h = zlib.crc32(f"{'.' * (k > 0)}{part}".encode())
                v[h % PATH_DIM] += 1 if h & 1 << 20 else -1
        _steps[step] = v
    return _steps[step]


def features(pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[np.ndarray]:
    """A matrix (blocks x INPUT) for each page."""
    flat = [b for page in pages for b in page]
    x = np.zeros((len(flat), INPUT), dtype=np.float32)
    if flat:
        for k, (path, _, _) in enumerate(flat):
            for step in path:
                x[k, :PATH_DIM] += _step(step)
        data, offsets = tk.buffers(pa.array([b[1] for b in flat], pa.large_string()))
        starts, ends, first = tk.words(tk.LOWER[data], offsets)
        h = tk.span_hashes(tk.LOWER[data], starts, ends)
        counts = np.diff(first)
        owner = np.repeat(np.arange(len(flat)), counts)
        slot = (h % np.uint64(WORD_DIM)).astype(np.int64)
        sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        words = np.bincount(owner * WORD_DIM + slot, sign, len(flat) * WORD_DIM).reshape(-1, WORD_DIM)
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = words / np.maximum(np.sqrt((words**2).sum(axis=1)), 1)[:, None] * 2
        size = np.diff(offsets)
        extra = x[:, PATH_DIM + WORD_DIM :]
        extra[:, 0] = np.log1p(counts) / 4
        extra[:, 1] = np.array([b[2] for b in flat]) / np.maximum(size, 1)
        extra[:, 2] = np.minimum(size / np.maximum(counts, 1) / 10, 2)
        stops = np.concatenate(([0], np.cumsum((data == 46) | (data == 44))))
        extra[:, 3] = np.minimum((stops[offsets[1:]] - stops[offsets[:-1]]) / np.maximum(counts, 1), 2)
        extra[:, 4] = 1
    out, at = [], 0
    for page in pages:
        x[at : at + len(page), -1] = np.arange(len(page)) / max(len(page), 1)
        out.append(x[at : at + len(page)])
        at += len(page)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Labeller:
    """Parameters of both directions (input, hidden and bias to four gates) and of the output."""

    w: list[np.ndarray]  # for each direction: (INPUT + HIDDEN + 1) x 4 HIDDEN
    out: np.ndarray  # 2 HIDDEN + INPUT + 1

    @classmethod
    def new(cls, seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        return cls([rng.normal(0, 0.1, (INPUT + HIDDEN + 1, 4 * HIDDEN)) for _ in range(2)], np.zeros(2 * HIDDEN + INPUT + 1))

    def _run(self, w: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        hs, tape = np.zeros((n, t, HIDDEN), x.dtype), []
        given = x @ w[:INPUT] + w[-1]
        for k in range(t):
            z = given[:, k] + h @ w[INPUT:-1]
            i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN] + (j == 1)) for j in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                tape.append((h, c, i, f, o, g, tc))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            hs[:, k] = h
        return hs, tape

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x is pages x blocks x INPUT, padded after each page's own blocks."""
        a, ta = self._run(self.w[0], x, mask, keep)
        b, tb = self._run(self.w[1], x[:, ::-1], mask[:, ::-1], keep)
        top = np.concatenate((a, b[:, ::-1], x), axis=2)
        return top @ self.out[:-1] + self.out[-1], [ta, tb, a, b, top]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z, (ta, tb, a, b, top) = self.logits(x, mask, keep=True)
        d = np.where(mask, _sigmoid(z) - y, 0) / max(mask.sum(), 1)
        gout = np.append(np.einsum("nt,ntk->k", d, top), d.sum())
        grads = []
        for way, (w, tape, hs) in enumerate(((self.w[0], ta, a), (self.w[1], tb, b))):
            xx, mm, dd = (v[:, ::-1] if way else v for v in (x, mask, d))
            dh_out = dd[:, :, None] * self.out[way * HIDDEN : (way + 1) * HIDDEN]
            dh, dc, gw = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN)), np.zeros_like(w)
            for k in range(x.shape[1] - 1, -1, -1):
                h, c, i, f, o, g, tc = tape[k]
                m = mm[:, k, None]
                dh = dh + dh_out[:, k]
                live, dcl = np.where(m, dh, 0), np.where(m, dc, 0)
                do, dcell = live * tc, dcl + live * o * (1 - tc**2)
                dz = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), do * o * (1 - o), dcell * i * (1 - g**2)), axis=1)
                gw[:INPUT] += xx[:, k].T @ dz
                gw[INPUT:-1] += h.T @ dz
                gw[-1] += dz.sum(axis=0)
                dh = np.where(m, dz @ w[INPUT:-1].T, dh)
                dc = np.where(m, dcell * f, dc)
            grads.append(gw)
        return [*grads, gout]

    def label(self, pages: list[np.ndarray], cells: int = 12_000) -> list[np.ndarray]:
        """For each page, which blocks are main text; pages of like length are padded together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest, mine = 0, []
            while order and (not mine or len(pages[order[0]]) * (len(mine) + 1) <= cells):
                mine.append(order.pop(0))
                longest = len(pages[mine[-1]])
            x, mask = padded([pages[k] for k in mine], longest)
            z, _ = self.logits(x, mask)
            for row, k in enumerate(mine):
                out[k] = z[row, : len(pages[k])] > 0
        return out


def padded(pages: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(pages), longest, INPUT), np.float32), np.zeros((len(pages), longest), bool)
    for row, page in enumerate(pages):
        x[row, : len(page)], mask[row, : len(page)] = page, True
    return x, mask


#: What menus and footers of made layouts say; real pages' own words come beside them.
MENU = ("Home", "News", "About", "Contact", "Search", "Login", "Archive", "Shop", "Help", "Topics", "Sign in", "Products")
CLOSING = ("All rights reserved", "Copyright 2024", "Terms of use", "Privacy policy", "Contact us", "Imprint", "Follow us", "Back to top")


def laid_out(main: list[str], rest: list[str], rng: np.random.Generator) -> tuple[list, list[bool]]:
    """A page of other elements and names from given texts, with its labels."""
    pick = lambda *a: str(a[rng.integers(len(a))])
    body = pick("div wrapper", "div", "div page", "div container")
    blocks, labels = [], []
    inside = rng.random() < 0.5
    table = rng.random() < 0.15  # all lies in cells of a table
    around = ("html", "body", *([body] if inside else []), *(("table", "tr") if table else ()))

    def put(steps: tuple[str, ...], leaf: str, texts: list[str], label: bool, link: bool = False) -> None:
        for t in texts:
            blocks.append(((*around, *(s for s in steps if s), *((leaf,) if leaf else ())), t, len(t) if link else 0))
            labels.append(label)

    take = lambda n: [rest[k] for k in rng.integers(len(rest), size=n)]
    short = lambda n: [" ".join(t.split()[:3]) for t in take(n)]
    menu = lambda n: [" ".join(pick(*MENU) for _ in range(int(rng.integers(1, 4)))) for _ in range(n)]
    if table:  # cells without a name, and with nothing in them but text
        put(("td",), "", menu(int(rng.integers(1, 4))) if rng.random() < 0.7 else short(2), False, rng.random() < 0.8)
    if not table and rng.random() < 0.6:
        put((pick("header", "div header", "div id-header site-header", "div notice", "div cookie-banner", "div alert"),), pick("p", "div", "h1"), take(1), False)
    if not table and rng.random() < 0.8:
        n = int(rng.integers(2, 8))
        put((pick("nav", "nav menu", "div menu", "ul nav", "div navbar", "aside sidebar"), pick("", "ul")), "li", short(n) if rng.random() < 0.6 else menu(n), False, True)
    if not table and rng.random() < 0.5:
        put((pick("div ad", "div ads", "aside", "div advert", "div sponsor", "aside sidebar", "div promo"),), pick("p", "div"), take(1), False)
    step = pick("article", "main", "div content", "div article", "section post", "div entry-content", "div main", "article post", "div story")
    if rng.random() < 0.4:  # nothing around the text tells what it is
        step = pick("", "", "div", "td", f"div x{rng.integers(1000)}", f"section c{rng.integers(1000)} row")
    if table:
        step = "td"
    put((step,), "h1", [" ".join(main[0].split()[:12])], True)
    for t in main:
        leaf = pick("p", "p", "p", "p", "li", "blockquote", "h2")
        put((step, pick("ul", "ol") if leaf == "li" else ""), leaf, [t], True)
        if rng.random() < 0.1:  # a list of short items
            put((step, pick("ul", "ol")), "li", [" ".join(t.split()[k : k + int(rng.integers(1, 7))]) or t for k in range(0, int(rng.integers(2, 6)))], True)
        if rng.random() < 0.06:
            put((step, pick("aside", "div ad", "div related", "form newsletter", "div share")), "p", take(1), False)
    if step and not table and rng.random() < 0.3:  # readers' comments within the element that holds the text, as long as it
        own = [main[k] for k in rng.integers(len(main), size=2)] if rng.random() < 0.5 else take(2)
        put((step, pick("div comments", "section comments", "div comment-list", "ol comments", "div replies"), pick("", "div comment", "article", "li")), pick("p", "p", "div"), own, False)
    for kind in ("div comments", "section comments", "form", "div sidebar", "aside", "div related", "div notice", "footer"):
        if not table and rng.random() < (0.8 if kind == "footer" else 0.25):
            put((kind,), pick("p", "div", "li"), take(int(rng.integers(1, 4))) if kind != "footer" else short(1) if rng.random() < 0.6 else [pick(*CLOSING)], False, kind == "div related")
    if table and rng.random() < 0.9:
        put(("td",), "", [pick(*CLOSING) for _ in range(int(rng.integers(1, 3)))], False, rng.random() < 0.3)
    return blocks, labels


def train(pages: list[str], epochs: int = 14, seed: int = 7) -> Labeller:
    """Labels come from `silver` for the pages as they are, and by construction for pages laid out anew; all are learnt whole."""
    rng = np.random.default_rng(seed)
    found = [b for b in map(blocks_of, pages) if b]
    labels = [[silver(path) for path, _, _ in b] for b in found]
    texts = [t for b in found for _, t, _ in b] or ["Some words of text, as a page may have them."]
    others = [t for b, y in zip(found, labels, strict=True) for (_, t, _), main in zip(b, y, strict=True) if not main] or texts
    for k in range(max(len(found), 60)):
        own = [t for (_, t, _), y in zip(found[k], labels[k], strict=True) if y] if k < len(pages) and k < len(found) else []
        blocks, ys = laid_out((own or [texts[j] for j in rng.integers(len(texts), size=int(rng.integers(2, 12)))]), others if k % 2 else texts, rng)
        found.append(blocks)
        labels.append(ys)
    x = features(found)
    model = Labeller.new(seed)
    params = [*model.w, model.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = sorted(rng.permutation(len(x)).tolist(), key=lambda k: len(x[k]) // 8)
        batches = [order[k : k + 16] for k in range(0, len(order), 16)]
        for b in rng.permutation(len(batches)):
            mine = batches[b]
            xs, mask = padded([x[k] for k in mine], max(len(x[k]) for k in mine))
            y = np.zeros(mask.shape)
            for row, k in enumerate(mine):
                y[row, : len(x[k])] = labels[k]
            step += 1
            for p, g, m, v in zip(params, model.gradients(xs.astype(float), mask, y), first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g**2
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Labeller([w.astype(np.float32) for w in model.w], model.out.astype(np.float32))


def main_text(pages: DataFrame, sample_pages: int = PAGES, max_chars: int = MAX_CHARS) -> DataFrame:
    """Main text of every row of pages(page_id, url, html), from its whole html.

    A null or empty html, or one without main text, gives ''. Repeated rows and null ids are kept. Other
    columns are ignored. Html of any length is read whole. Training takes the `sample_pages` different pages with
    the least hash among those of at most `max_chars` characters. An empty table gives an empty table.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    small = source.filter(F.length("html") <= max_chars).select("html", F.xxhash64("page_id", "html").alias("o"))
    least = [r[0] for r in small.select("o").distinct().orderBy("o").limit(sample_pages).collect()]  # hashes first: html of the sample alone moves
    sample = small.filter(F.col("o").isin(least)).dropDuplicates(["o"]).collect() if least else []
    model = train([r.html for r in sorted(sample, key=lambda r: (r.o, r.html))])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some 20,000 float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, _, _ in tk.blocks(whole, "html", 1 << 22):
                found = [blocks_of(h or "") for h in batch.column("html").to_pylist()]
                keep = shared.value.label(features(found))
                texts = ["\n".join(t for (_, t, _), y in zip(b, k.tolist(), strict=True) if y) if b else "" for b, k in zip(found, keep, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(tk.lean(run), SCHEMA)
