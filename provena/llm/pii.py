"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The base finds e-mail addresses, IPv4 addresses, card numbers and telephone numbers in whole texts by fixed patterns and checks. The
field adds other forms of these (spelt-out addresses, telephone numbers without a plus, card numbers with other marks, bracketed IP
addresses), repeats of a known one that only the first mention gives away, and secrets (keys, tokens, passwords). Its variables are the
tokens with a digit or an at sign and those of spelt-out addresses; any other token is outside by definition. Its labels are the five
kinds and none. Chain potentials join tokens at most ``REACH`` tokens apart; skip potentials join each token to the next one of the
document with the same letters and digits, or the same digits, however far away. Loopy sum-product message passing gives the marginals;
tokens whose kind has at least ``CONFIDENCE`` and which overlap no base span become added spans. Base spans are observed: their tokens
are clamped, so what they say reaches repeated and similar tokens along the skip edges.

Weights come from pseudo-likelihood on ``TRAIN_TEXTS`` labelled texts that ``made_text`` writes from a seed, none from the corpus. The
checks (Luhn, marks) are hidden at random in training so that context and shape carry weight too.

Cases: a null text counts as empty and has no spans; an empty table gives no rows. Repeated rows give repeated rows, a null ``doc_id``
stays null. Spans that start at one place stand in the order of ``ALL_KINDS``; of kinds with equal marginals the first counts. Other
input columns are not read, whatever their names. Texts are read whole: long runs of digits or letters cost time in proportion.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import map_batches, table

#: Fixed values of the base patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile("[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")

#: What the field adds to the kinds of the base.
ALL_KINDS = (*KINDS, "secret")
DIM, REACH, ROUNDS, DAMPING, CONFIDENCE, TRAIN_TEXTS, HIDE, SEED = 1 << 14, 2, 12, 0.3, 0.9, 1_200, 0.35, 11
NONE = len(ALL_KINDS)
#: Digits in a span of a kind, at most; marks around a token that are no part of it.
_MOST_DIGITS = {"ip": 12, "card": 19, "phone": 15}
_MARKS, _BRACKETS = ".,;:!?#$%&*|\"'", "[](){}<>"
_DOT, _AT = re.compile(r"\bdot\b", re.I), re.compile(r"[\[({]at[\])}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the base matches, in order. Equal to a leftmost, non-overlapping search per kind: an address' local part
    is the whole run before its at sign, as the run's characters exclude the sign; a dotted number starts where its digits do."""
    if not _ANY.search(text):
        return []
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        follow = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = follow = m.end()
        else:
            last = max(last, at)
        at = text.find("@", follow)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def spelt_out(words: list[str]) -> dict[int, int]:
    """Places of the words of ``name at host dot org``, with or without brackets around the spelt marks, and where each address starts."""
    out: dict[int, int] = {}
    core = [w.lower().strip(_BRACKETS) for w in words]
    for i, word in enumerate(core):
        if word == "at" and 0 < i:
            dot = next((j for j in range(i + 2, min(i + 5, len(core) - 1)) if core[j] == "dot"), None)
            while dot is not None:
                out |= dict.fromkeys(range(i - 1, dot + 2), i - 1)
                dot = dot + 2 if dot + 3 < len(core) and core[dot + 2] == "dot" else None
    return out


class Graph:
    """The variables of one document: tokens with a digit or an at sign, their features, and the edges between them."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        every = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        words = [text[a:b] for a, b in every]
        spelt = spelt_out(words) if _DOT.search(text) else {}
        self.spans, self.features, self.telling, self.places, self.address = [], [], [], [], []
        for k, word in enumerate(words):
            if not (_ANY.search(word) or k in spelt or _AT.search(word)):
                continue
            near = [words[q].lower().strip(_MARKS) if 0 <= q < len(words) else "^" for q in (k - 2, k - 1, k + 1, k + 2)]
            near = ["9" if any(c.isdigit() for c in x) else x for x in near]
            core = word.strip(_MARKS)
            inner = core.strip(_BRACKETS)
            shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{len(m.group())}", core)) if k not in spelt else "spelt " + (inner.lower() if inner.lower() in ("at", "dot") else "a") + " " * (inner != core)
            n, letters = len(_digits(word)), sum(c.isalpha() for c in word)
            mixed = f"{len(core) // 8 if letters and n else 0} {len(set(core) - set('0123456789abcdefABCDEF')) == 0}"
            parts = [f"shape {shape}", f"digits {n}", f"before2 {near[0]}", f"before {near[1]}", f"after {near[2]}", f"after2 {near[3]}", f"mixed {mixed}", "bias"]
            tell = [f"at {'@' in word} {'at]' in word or 'at)' in word}", f"plus {word[:1] == '+'}", f"luhn {12 <= n <= 19 and luhn(_digits(word))}", f"dots {word.count('.')}", f"set {core.partition('=')[0].partition(':')[0].lower() if '=' in core or ':' in core else ''}"]
            self.spans.append(every[k])
            self.features.append([zlib.crc32(x.encode()) % DIM for x in parts])
            self.telling.append([zlib.crc32(x.encode()) % DIM for x in tell])
            self.places.append(k)
            self.address.append(spelt.get(k, -1))
        places = self.places
        self.labels = np.full(len(self.spans), NONE)
        self.known = np.zeros(len(self.spans), bool)
        at = 0
        for start, kind, end in base:
            while at and self.spans[at - 1][1] > start:
                at -= 1
            while at < len(self.spans) and self.spans[at][1] <= start:
                at += 1
            k = at
            while k < len(self.spans) and self.spans[k][0] < end:
                self.labels[k], self.known[k] = kind, True
                k += 1
        self.chain = [(i, i + 1) for i in range(len(places) - 1) if places[i + 1] - places[i] <= REACH]
        self.skip = []
        latest: dict[str, int] = {}
        for i, (a, b) in enumerate(self.spans):
            word = text[a:b]
            for form in {"w" + "".join(c for c in word.lower() if c.isalnum()), "d" + _digits(word) if len(_digits(word)) >= 6 else ""} - {""}:
                if form in latest and latest[form] != i:
                    self.skip.append((latest[form], i))
                latest[form] = i
        self.skip = sorted(set(self.skip) - set(self.chain))


def train(graphs: list[Graph], rounds: int = 120, rate: float = 0.1, l2: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Unary weights and the chain and skip potentials, by pseudo-likelihood: each token given its neighbours' labels."""
    graphs = [g for g in graphs if g.spans]
    if not graphs:
        return None
    r, n_labels = np.random.RandomState(seed), NONE + 1
    base = np.cumsum([0] + [len(g.spans) for g in graphs])
    labels = np.concatenate([g.labels for g in graphs])
    plain = np.array([f for g in graphs for f in g.features])
    tell = np.array([f for g in graphs for f in g.telling])
    seen = r.rand(*tell.shape) >= HIDE
    edges = {k: np.array([(a + o, b + o) for g, o in zip(graphs, base, strict=False) for a, b in getattr(g, k)], dtype=np.int64).reshape(-1, 2) for k in ("chain", "skip")}
    count = {}
    for k, e in edges.items():
        count[k] = np.zeros((len(labels), n_labels))
        np.add.at(count[k], (e[:, 0], labels[e[:, 1]]), 1)
        np.add.at(count[k], (e[:, 1], labels[e[:, 0]]), 1)
    w, pots = np.zeros((DIM, n_labels)), {k: np.zeros((n_labels, n_labels)) for k in edges}
    target = np.eye(n_labels)[labels]
    params = [w, pots["chain"], pots["skip"]]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        z = w[plain].sum(axis=1) + (w[tell] * seen[:, :, None]).sum(axis=1) + count["chain"] @ pots["chain"] + count["skip"] @ pots["skip"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - target) / len(labels)
        g = np.zeros_like(w)
        for c in range(n_labels):
            g[:, c] = np.bincount(plain.ravel(), np.repeat(d[:, c], plain.shape[1]), minlength=DIM) + np.bincount(tell.ravel(), (seen * d[:, c, None]).ravel(), minlength=DIM)
        grads = [g + l2 * w, *((lambda x: (x + x.T) / 2)(count[k].T @ d) + l2 * pots[k] for k in edges)]
        for k, (q, x) in enumerate(zip(params, grads, strict=True)):
            m1[k] = 0.9 * m1[k] + 0.1 * x
            m2[k] = 0.999 * m2[k] + 0.001 * x * x
            q -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-9)
    return w, pots["chain"], pots["skip"]


def marginals(graphs: list[Graph], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Loopy sum-product over all graphs of a batch at once; base tokens are clamped to their labels."""
    w, chain, skip = model
    base = np.cumsum([0] + [len(g.spans) for g in graphs])
    n, n_labels = int(base[-1]), NONE + 1
    if not n:
        return [np.zeros((0, n_labels)) for _ in graphs]
    unary = w[np.array([f for g in graphs for f in g.features])].sum(axis=1) + w[np.array([f for g in graphs for f in g.telling])].sum(axis=1)
    known, labels = np.concatenate([g.known for g in graphs]), np.concatenate([g.labels for g in graphs])
    unary[known] = -30.0
    unary[known, labels[known]] = 30.0
    sides, tables = [], []
    for kind, table_ in (("chain", chain), ("skip", skip)):
        e = np.array([(a + o, b + o) for g, o in zip(graphs, base, strict=False) for a, b in getattr(g, kind)], dtype=np.int64).reshape(-1, 2)
        sides += [e, e[:, ::-1]]
        tables += [np.repeat(t[None], len(e), axis=0) for t in (table_, table_.T)]
    e, pot = np.concatenate(sides), np.exp(np.clip(np.concatenate(tables), -15, 15))
    pairs = [len(sides[0]), len(sides[2])]
    back = np.concatenate([np.arange(pairs[0]) + pairs[0], np.arange(pairs[0]), np.arange(pairs[1]) + 2 * pairs[0] + pairs[1], np.arange(pairs[1]) + 2 * pairs[0]]) if len(e) else np.empty(0, np.int64)
    messages = np.zeros((len(e), n_labels))
    belief = unary.copy()
    for _ in range(ROUNDS if len(e) else 0):
        belief = unary.copy()
        np.add.at(belief, e[:, 1], messages)
        out = belief[e[:, 0]] - messages[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ek,ekl->el", out, pot) + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        messages = DAMPING * messages + (1 - DAMPING) * new
    belief = unary.copy()
    np.add.at(belief, e[:, 1], messages) if len(e) else None
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return [p[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


def _trimmed(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """The span less the marks around it and, of a secret, the name that it is set to."""
    if ALL_KINDS[kind] == "secret":
        cut = max(text.rfind(mark, a, b - 1) for mark in "=:")
        a = cut + 1 if cut >= a else a
    for opens, shuts in ("()", "[]"):
        while b > a and (text[b - 1] in _MARKS or text[b - 1] == shuts and text.count(shuts, a, b) > text.count(opens, a, b)):
            b -= 1
        while b > a and (text[a] in _MARKS or text[a] == opens and text.count(opens, a, b) > text.count(shuts, a, b)):
            a += 1
    return a, b


def added_spans(text: str, graph: Graph, p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of adjacent tokens of one kind, as long as their digits are no more than such a span has."""
    runs: list[list[int]] = []  # kind, start, end, place of the last token
    sure = np.where(p.max(axis=1) >= CONFIDENCE, p.argmax(axis=1), NONE)
    # a spelt-out address is one, or none, by the mean of its words
    address = np.array(graph.address)
    for first in set(graph.address) - {-1}:
        mean = p[address == first].mean(axis=0)
        sure[address == first] = 0 if mean.argmax() == 0 and mean[0] >= CONFIDENCE / 2 else NONE
    for (a, b), place, known, kind in zip(graph.spans, graph.places, graph.known, sure.tolist(), strict=True):
        if known or kind == NONE:
            continue
        last = runs[-1] if runs else None
        joins = ALL_KINDS[kind] in ("email", "card", "phone") and last and last[0] == kind and last[3] == place - 1
        if joins and (kind == 0 and "@" not in text[last[1] : b] or kind and len(_digits(text[last[1] : b])) <= _MOST_DIGITS[ALL_KINDS[kind]]):
            last[2], last[3] = b, place
        else:
            runs.append([kind, a, b, place])
    out = []
    for kind, a, b, _ in runs:
        a, b = _trimmed(text, kind, a, b)
        if a < b and not any(a < e and s < b for s, _, e in base):
            out.append((a, kind, b))
    return out


_SYLLABLES = "an er on th in ent ion re ti es or le de la que ung sch ach ció mente eau ré ment ä ü".split()
_HOSTS, _ENDS = ("mail", "example", "post", "web", "inbox", "corp"), ("com", "org", "net", "de", "example")
_CALL = ("call", "tel", "tel:", "phone", "phone:", "mobile", "fax", "ring", "at", "contact", "numéro", "Telefon")
_PAY = ("card", "card:", "visa", "pay", "credit", "carte", "Karte", "tarjeta")
_NAMES = ("token", "key", "api_key", "secret", "password", "passwd", "access_key", "auth")


def made_text(seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with personal data in many forms, repeats and things that only look like it; and all its spans."""
    r = random.Random(seed)
    text, spans = [], []
    size = 0
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))

    def say(part: str, kind: int | None = None, tail: str = "") -> None:
        nonlocal size
        if kind is not None:
            spans.append((size, kind, size + len(part)))
        text.append(part + tail)
        size += len(part) + len(tail) + 1

    def card() -> str:
        body = r.choice("3456") + digits(r.choice([14, 14, 14, 13]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(number: str, mark: str) -> str:
        return mark.join(number[k : k + 4] for k in range(0, len(number), 4))

    for _ in range(r.randint(4, 9)):
        for _ in range(r.randint(2, 12)):
            say(word() if r.random() < 0.93 else r.choice(("at", "a", "dot", "for", "key", "number")), tail=r.choice(("", "", "", ",", ".")))
        tail, kind = r.choice(("", "", "", ".", ",", "!", "!!", "###", "%%%", ")")), r.random()
        if kind < 0.14:
            local, host, end = f"{word()}{r.choice(('', '.', '_'))}{digits(r.randint(0, 2))}", r.choice(_HOSTS) + digits(r.randint(0, 1)), r.choice(_ENDS)
            form = r.randrange(6)
            if r.random() < 0.5:
                say(r.choice(("mail", "write", "email:", "contact", "to")))
            at, dot = (("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)"))[form % 3]
            if form > 3:
                say(f"{local}{at}{host}{dot}{end}" if at != "at" else f"{local}@{host}.{end}", 0, tail)
            else:
                say(f"{local} {at} {host} {dot} {end}", 0, tail)
        elif kind < 0.24:
            parts = [str(r.randint(0, 255)) for _ in range(4)]
            say(r.choice((".", "[.]", "(.)", "[.]")).join(parts), 1, tail)
        elif kind < 0.38:
            number = card()
            if r.random() < 0.5:
                say(r.choice(_PAY))
            say(grouped(number, r.choice(("", " ", "-", ".", "/", "_"))), 2, tail)
            if r.random() < 0.4:  # said again, in a form that tells nothing
                for _ in range(r.randint(1, 40)):
                    say(word())
                say(grouped(number, r.choice((".", "/", "_"))), 2, tail)
        elif kind < 0.58:
            area, a, b = digits(3), digits(3), digits(4)
            short = f"{a}-{b}"
            form = r.choice((f"+{r.randint(1, 99)} ({area}) {short}", f"+{r.randint(1, 99)} {area} {a} {b}", f"({area}) {short}", f"({area}) {short}", f"{area}-{short}", f"{area}.{a}.{b}", f"00{r.randint(10, 99)} {area} {a}{b}"))
            if not form.startswith(("+", "(")) or r.random() < 0.5:
                say(r.choice(_CALL))
            say(form, 3, tail)
            if r.random() < 0.4 and short in form:
                for _ in range(r.randint(1, 40)):
                    say(word())
                say(r.choice((f"{a}{b}", f"{a}.{b}", short)), 3, tail)
        elif kind < 0.74:
            value = r.choice((lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64)))), lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(40)), lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: "sk_live_" + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(24)), lambda: f"{word()}{digits(3)}!x"))()
            name = r.choice(_NAMES)
            name, mark = r.choice((name, name.upper())), r.choice(("=", ":"))
            if not any("0" <= c <= "9" for c in value):
                value += "7"
            if r.random() < 0.7:
                say(name + ("" if mark == "=" else ":"))
                if mark == "=":
                    say("=")
                quote = r.choice(('"', '"', "'", ""))
                size += len(quote)
                spans.append((size, 4, size + len(value)))
                size -= len(quote)
                say(quote + value + quote, tail=r.choice(("", "###", "!!", ",")))
            else:
                spans.append((size + len(name) + 1, 4, size + len(name) + 1 + len(value)))
                say(f"{name}={value}")
        else:  # looks like it, but is none
            other = r.randrange(12)
            say((f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(0, 23)}:{r.randint(10, 59)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{digits(2)}.{digits(2)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{r.randint(256, 999)}.1.2.{r.randint(300, 999)}", digits(r.choice((1, 2, 3, 4, 5, 6, 7, 8, 9, 11))), f"{digits(3)},{digits(3)}", f"{word()}{digits(2)}", f"@{word()}", f"{digits(3)}/{digits(2)}", next(x for x in iter(lambda: digits(16), None) if not luhn(x)))[other], tail=tail)
    return " ".join(text), sorted(spans)


@functools.lru_cache(maxsize=2)
def personal_model(texts: int = TRAIN_TEXTS, seed: int = SEED) -> tuple:
    """The field's weights from made texts of a seed: the same in every process, and fitted once in each."""
    return train([Graph(*made_text(seed * 1_000_003 + k)) for k in range(texts)])


def find_personal(docs: DataFrame, model: tuple | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the numbers of base spans by kind, ``base`` and ``spans`` as ``kind:start:end`` lists (code points, end
    exclusive) and ``n_added``. One narrow pass; the broadcast model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            spans = list(base)
            some = [k for k, t in enumerate(texts) if shared.value is not None and (_ANY.search(t) or _DOT.search(t))]
            graphs = [Graph(texts[k], base[k]) for k in some]
            for k, g, p in zip(some, graphs, marginals(graphs, shared.value) if some else [], strict=True):
                spans[k] = sorted(base[k] + added_spans(texts[k], g, p, base[k]))
            counts = np.array([[sum(kind == k for _, kind, _ in b) for k in range(len(KINDS))] for b in base], dtype=np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array([shown(b) for b in base], pa.string()), pa.array([shown(s) for s in spans], pa.string()), pa.array([len(s) - len(b) for s, b in zip(spans, base, strict=True)], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, n_added long")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"), personal_model())
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_added")
