"""Main text of web pages: a bidirectional LSTM labels every block with the whole page as context.

A page is cut into blocks at block-level tags. A block's inputs are its tag path (element names and the words of their class, id and
role, hashed), hashed word vectors of its text, and a few numbers (length, share of link text, place in the page). The network reads the
sequence of blocks in both directions and labels each as main text or not; the main blocks, in page order, are the result. It is
trained in numpy on ``TRAIN_PAGES`` pages made by ``made_page`` from a seed: containers of many names with articles, menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, with and without end tags.

Cases: a null page is empty; a page without main text has an empty text. Unclosed and stray tags, comments and quotes never fail: a ``<``
that begins no tag is text, a quoted value ends at its closing quote however far, or where none follows at the next ``>``, and a last
tag without ``>`` is dropped. Scripts and styles are never text. A block whose probability is exactly one half is main text. Pages of
any length, depth and number of blocks are read whole. Repeated rows give repeated rows, an empty table none. Columns to ``keep`` that
are called like the result's own get the prefix ``page_``; others are not read.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import Words, cut, map_batches, table

PATH_DIM, WORD_DIM, NUMBERS, EMBED, HIDDEN = 1024, 64, 8, 32, 24
TRAIN_PAGES, EPOCHS, SEED = 700, 14, 7
#: Elements whose start or end ends a block, those without content, and those whose content is no text. Fixed values of HTML.
BLOCK = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_CLOSES_P = BLOCK - {"button", "td", "th", "tr", "option", "body", "html", "head"}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_LABELS = frozenset(("class", "id", "role", "aria-label", "itemprop"))
_GAP, _ATTRIBUTE, _EQUALS, _BARE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ITEMS = frozenset(("li", "option", "tr", "td", "th", "dt", "dd"))


class Block:
    """``path``: the hashed labels of all open elements, sorted, and ``depth``, their number; ``last``: the two innermost elements."""

    __slots__ = ("depth", "last", "links", "path", "text")

    def __init__(self, text: str, path: list[int], depth: int, last: tuple[str, ...], links: int):
        self.text, self.path, self.depth, self.last, self.links = text, path, depth, last, links


def _hash(x: str) -> int:
    return zlib.crc32(x.encode())


def tag_end(page: str, at: int) -> tuple[int, list[str]]:
    """Where the tag whose name ends at ``at`` closes (-1: nowhere), and the words of its labels."""
    words: list[str] = []
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return -1, words
        if page[at] == ">":
            return at, words
        name = _ATTRIBUTE.match(page, at)
        equals = _EQUALS.match(page, name.end())
        if not equals:
            at = name.end()
            continue
        at = equals.end()
        quote = page[at : at + 1]
        if quote in ('"', "'"):
            begin, end = at + 1, page.find(quote, at + 1)
            if end < 0:  # never closed
                at = end = page.find(">", begin)
                if end < 0:
                    return -1, words
            else:
                at = end + 1
        else:
            begin, end = at, _BARE.match(page, at).end()
            at = end
        if name.group().lower() in _LABELS:
            words += [w.lower() for w in _PARTS.findall(page, begin, end)]


class Stack:
    """The open elements, with counts of their labels, so that no step costs more than its own element."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, list[int]]] = []
        self.named: list[str] = []  # the block elements and the labelled ones
        self.open: dict[str, int] = {}
        self.counts: dict[int, int] = {}
        self.depth = 0

    def push(self, tag: str, labels: list[str]) -> None:
        ids = [_hash(x) % PATH_DIM for x in labels]
        self.tags.append((tag, ids))
        self.open[tag] = self.open.get(tag, 0) + 1
        for k in ids:
            self.counts[k] = self.counts.get(k, 0) + 1
        self.depth += len(ids)
        if ids:
            self.named.append(tag)

    def pop(self) -> str:
        tag, ids = self.tags.pop()
        self.open[tag] -= 1
        for k in ids:
            self.counts[k] -= 1
            if not self.counts[k]:
                del self.counts[k]
        self.depth -= len(ids)
        if ids:
            self.named.pop()
        return tag


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page, references decoded and white space normalised."""
    out: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    links, place = 0, ([], 0, ())

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, *place, links))
        parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links, place
        text = html.unescape(raw) if "&" in raw else raw
        if not parts:
            place = (sorted(stack.counts), stack.depth, tuple(stack.named[-2:]))
        parts.append(text)
        if stack.open.get("a"):
            links += len(text)

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        if begin > at:
            say(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        follows = page[begin + 1 : begin + 2]
        if follows in ("!", "?"):
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        closing = follows == "/"
        name = _NAME.match(page, begin + 1 + closing)
        if not name:
            say("<")
            at = begin + 1
            continue
        end, words = tag_end(page, name.end())
        if end < 0:
            break
        tag, at = name.group().lower(), end + 1
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            if stack.open.get(tag):
                while stack.pop() != tag:
                    pass
            continue
        if tag in RAW:
            shut = _RAW_END[tag].search(page, at)
            end = page.find(">", shut.end()) if shut else -1
            at = size if end < 0 else end + 1
            continue
        ends = [x for x in ("p" if tag in _CLOSES_P else "", tag if tag in _ITEMS else "") if stack.open.get(x)]
        if ends:
            for k in range(len(stack.tags) - 1, -1, -1):
                t = stack.tags[k][0]
                if t in ends:
                    while len(stack.tags) > k:
                        stack.pop()
                    break
                if t in BLOCK and t != "p":
                    break
        if tag in VOID or page[end - 1] == "/" and tag not in BLOCK:
            continue
        stack.push(tag, [tag, *(f".{w}" for w in words)] if tag in BLOCK or words else [])
    flush()
    return out


def inputs(page: list[Block]) -> tuple[list[np.ndarray], np.ndarray]:
    """Path features (hashed, the last elements also by themselves) and the dense part of each block, from all its words."""
    ids = [np.array([*b.path, _hash("last:" + "".join(b.last[-1:])) % PATH_DIM, _hash("pair:" + " ".join(b.last)) % PATH_DIM]) for b in page]
    dense = np.zeros((len(page), WORD_DIM + NUMBERS), np.float32)
    words = Words(pa.array([b.text for b in page], pa.large_string()), lower=True)
    counts = np.maximum(np.diff(words.starts), 1)
    owner = np.repeat(np.arange(len(page)), np.diff(words.starts))
    own = np.fromiter((zlib.crc32(w) % WORD_DIM for w in cut(words.distinct)), np.int64, len(words.distinct))
    dense[:, :WORD_DIM] = np.bincount(owner * WORD_DIM + own[words.index], 1 / counts[owner], minlength=len(page) * WORD_DIM).reshape(len(page), WORD_DIM)
    for k, b in enumerate(page):
        n = len(b.text)
        dense[k, WORD_DIM:] = (np.log1p(n) / 8, b.links / n, b.text.count(" ") / n, min(1, k / 40), min(1, (len(page) - k) / 40), b.depth / 20, b.text[-1] in ".!?…:»”\"", len(page) / 200)
    return ids, dense


class Network:
    """Embedding, two LSTMs and a logistic output; ``train`` is truncated nowhere."""

    def __init__(self, seed: int = SEED):
        r = np.random.RandomState(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"path": g(PATH_DIM, EMBED) * 4, "dense": g(WORD_DIM + NUMBERS, EMBED), "out": g(2 * HIDDEN, 1), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": g(EMBED, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}

    def embed(self, ids: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        flat = np.concatenate(ids)
        starts = np.cumsum([0] + [len(x) for x in ids[:-1]])
        return np.tanh(np.add.reduceat(self.p["path"][flat], starts, axis=0) + dense @ self.p["dense"])

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        z0 = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z0[:, t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c2 = (f * c + i * u) * m
            tc = np.tanh(c2)
            h2 = o * tc * m
            if keep is not None:
                keep.append((t, i, f, o, u, c, tc, h, m))
            h, c = h2, c2
            out[:, t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return 1 / (1 + np.exp(-(both @ self.p["out"] + self.p["out_b"])[:, :, 0]))

    def gradients(self, pages: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]) -> tuple[float, dict[str, np.ndarray]]:
        steps = max(len(y) for *_, y in pages)
        x, mask, y = np.zeros((len(pages), steps, EMBED), np.float32), np.zeros((len(pages), steps), np.float32), np.zeros((len(pages), steps), np.float32)
        for k, (ids, dense, labels) in enumerate(pages):
            x[k, : len(labels)], mask[k, : len(labels)], y[k, : len(labels)] = self.embed(ids, dense), 1, labels
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.p["out"] + self.p["out_b"])[:, :, 0]))
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / mask.sum())
        e = (p - y) * mask / mask.sum()
        g = {"out": np.einsum("ntk,nt->k", both, e)[:, None], "out_b": np.array([e.sum()], np.float32)}
        dboth, dx = e[:, :, None] * self.p["out"][:, 0], np.zeros_like(x)
        for d, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            dh, dc = np.zeros((len(pages), HIDDEN), np.float32), np.zeros((len(pages), HIDDEN), np.float32)
            gx, gh, gc = (np.zeros_like(self.p[f"{k}{d}"]) for k in "xhc")
            for t, i, f, o, u, c, tc, h, m in reversed(kept[d]):
                dh = (dh + part[:, t]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                gx += x[:, t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(axis=0)
                dx[:, t] += dz @ self.p[f"x{d}"].T
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        dx *= 1 - x * x
        g["path"], g["dense"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["dense"])
        for k, (ids, dense, labels) in enumerate(pages):
            own = dx[k, : len(labels)]
            g["dense"] += dense.T @ own
            np.add.at(g["path"], np.concatenate(ids), np.repeat(own, [len(q) for q in ids], axis=0))
        return loss, g

    def train(self, pages: list, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 24, seed: int = SEED) -> Network:
        r = random.Random(seed)
        m1, m2, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        pages = [p for p in pages if len(p[2])]
        for _ in range(epochs):
            r.shuffle(pages)
            for at in range(0, len(pages), batch):
                _, g = self.gradients(pages[at : at + batch])
                t += 1
                for k, v in self.p.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                    m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                    v -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, the probability that each block is main text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            group = order[at : at + 64]
            while len(group) > 1 and len(pages[group[-1]]) * len(group) > 20_000:
                group = group[: len(group) // 2]
            at += len(group)
            steps = len(pages[group[-1]])
            x, mask = np.zeros((len(group), steps, EMBED), np.float32), np.zeros((len(group), steps), np.float32)
            for k, page in enumerate(group):
                n = len(pages[page])
                x[k, :n], mask[k, :n] = self.embed(*inputs(pages[page])), 1
            p = self.forward(x, mask)
            for k, page in enumerate(group):
                out[page] = p[k, : len(pages[page])]
        return out


_SYLLABLES = "an er on th in ent ion re ti es or le de la que ung sch ach ció mente eau ré ment ä ü".split()
_MAIN = ("article", "main", "div.content", "div.post-body", "div.entry-content", "section.story", "div#article", "div.article-body", "main.page-main article", "div.container article", "div.post article.entry", "section article")
_OTHER = {
    "menu": ("nav", "ul.menu", "div.navbar", "div#menu", "div.nav-links", "header nav", "div.breadcrumb", "div.main-menu", "nav.site-nav"),
    "header": ("header", "div.header", "div#header", "header.site-header", "div.masthead", "div.top-bar"),
    "footer": ("footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright"),
    "sidebar": ("aside", "div.sidebar", "div#sidebar", "aside.related", "div.related-posts", "div.widget", "section.trending", "div.recommended"),
    "notice": ("div.cookie-notice", "div.notice", "div#cookie-banner", "div.consent", "div.banner", "div.alert", "div.gdpr", "div.popup", "section.cookies"),
    "advert": ("div.ad", "div.ads", "div.advert", "aside.sponsored", "div.promo", "div#ad-slot", "div.advertisement", "ins.adsbygoogle", "section.sponsor"),
    "form": ("form", "div.newsletter form", "form.search", "div.subscribe", "form#signup", "form.login"),
    "comments": ("div.comments", "section#comments", "div.comment-list", "ol.commentlist", "section.reader-comments", "div.discussion", "div#disqus_thread", "ul.replies"),
    "share": ("div.share", "div.social", "ul.social-links", "div.pagination", "div.tags", "div.author-bio"),
}


def _open(selector: str, r: random.Random) -> tuple[str, str]:
    begin, end = "", ""
    for one in selector.split(" "):
        m = re.fullmatch(r"(\w+)(?:([.#])([\w-]+))?", one)
        label = "" if not m[3] else f' {"class" if m[2] == "." else "id"}="{m[3]}"'
        if not m[3] and r.random() < 0.15:
            label = f' class="c{r.randrange(99)}"'
        begin, end = f"{begin}<{m[1]}{label}>", f"</{m[1]}>{end}"
    return begin, end


def made_page(seed: int) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks, in order."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    texts: list[tuple[str, int]] = []

    def sentence(low: int, high: int) -> str:
        s = " ".join(word() for _ in range(r.randint(low, high))).capitalize()
        return s + r.choice([".", ".", ".", "", "!", "?"])

    def put(tag: str, text: str, main: int, link: bool = False) -> str:
        texts.append((text, main))
        inner = f'<a href="/{word()}">{text}</a>' if link else text if r.random() < 0.8 else f"<b>{text}</b>"
        return f"<{tag}>{inner}" + ("" if tag in ("p", "li") and loose else f"</{tag}>")

    loose = r.random() < 0.3

    def other(kind: str) -> str:
        begin, end = _open(r.choice(_OTHER[kind]), r)
        if kind in ("menu", "share"):
            body = "<ul>" + "".join(put("li", word(), 0, True) for _ in range(r.randint(1, 8))) + "</ul>"
        elif kind == "comments":
            body = (put("h3", sentence(1, 3), 0) if r.random() < 0.6 else "") + "".join(r.choice(["<div class='comment'>{}</div>", "<li>{}</li>", "<article class='comment'>{}</article>", "<div>{}</div>"]).format(put("p", sentence(3, 40), 0)) for _ in range(r.randint(1, 5)))
        elif kind == "sidebar":
            body = put("h3", sentence(1, 4), 0) + "".join(put(r.choice(["li", "p"]), sentence(2, 14), 0, r.random() < 0.6) for _ in range(r.randint(1, 6)))
        elif kind == "form":
            body = put("label", sentence(1, 4), 0).replace("label", "div") + '<input type="text">' + put("button", word(), 0)
        else:
            body = "".join(put(r.choice(["p", "div", "div"]), sentence(1, 25), 0, r.random() < 0.2) for _ in range(r.randint(1, 3)))
        return begin + body + end

    def article() -> str:
        begin, end = _open(r.choice(_MAIN), r)
        body = put(r.choice(["h1", "h1", "h2"]), sentence(2, 12), 1) if r.random() < 0.9 else ""
        for _ in range(r.randint(1, 22)):
            kind = r.random()
            if kind < 0.74:
                body += put("p", sentence(1, 90), 1)
            elif kind < 0.8:
                body += put(r.choice(["h2", "h3"]), sentence(1, 8), 1)
            elif kind < 0.85:
                body += "<ul>" + "".join(put("li", sentence(1, 20), 1) for _ in range(r.randint(1, 5))) + "</ul>"
            elif kind < 0.89:
                body += put(r.choice(["blockquote", "pre", "div"]), sentence(3, 40), 1)
            elif kind < 0.92:
                body += "<table><tr>" + put("td", sentence(1, 6), 1) + put("td", sentence(1, 6), 1) + "</tr></table>"
            else:
                body += other(r.choice(["advert", "share", "sidebar", "form", "notice"]))
        if r.random() < 0.2:
            body += other("comments")
        return begin + body + end

    parts = [f"<!DOCTYPE html><html lang='x'><head>{put('title', sentence(2, 9), 0)}<style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"]
    for kind, chance in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("advert", 0.5), ("sidebar", 0.2)):
        if r.random() < chance:
            parts.append(other(kind))
    if r.random() < 0.96:
        parts.append(article())
    for kind, chance in (("comments", 0.4), ("sidebar", 0.4), ("advert", 0.3), ("form", 0.3), ("share", 0.2), ("notice", 0.2), ("menu", 0.1), ("footer", 0.85)):
        if r.random() < chance:
            parts.append(other(kind))
    page = "".join(parts) + ("" if r.random() < 0.2 else "</body></html>")
    return page, [main for _, main in texts]


@functools.lru_cache(maxsize=4)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """The network of a seed; the same in every process, and fitted once in each."""
    data = []
    for k in range(pages):
        page, labels = made_page(seed * 1_000_003 + k)
        own = blocks(page)
        if len(own) == len(labels) and own:
            data.append((*inputs(own), np.array(labels, np.float32)))
    return Network(seed).train(data, epochs)


def main_text(pages: DataFrame, network: Network, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: the key, the ``keep`` columns, ``text`` and ``n_blocks``; one narrow pass. The network has a fixed size."""
    shared = pages.sparkSession.sparkContext.broadcast(network.p)
    own_names = {key, "text", "n_blocks"}
    rows = pages.select(F.col(key), *[F.col(c).alias(f"page_{c}" if c in own_names else c) for c in keep], F.col(page).cast("string").alias("__html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [blocks(x or "") for x in some.column(some.num_columns - 1).to_pylist()]
                labels = own.label(found)
                texts = ["\n\n".join(b.text for b, p in zip(page, ps, strict=True) if p >= 0.5) for page, ps in zip(found, labels, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*some.schema.names[:-1], "text", "n_blocks"])

    return map_batches(rows, run, schema)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), trained()).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
