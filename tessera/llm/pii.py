"""Personal data by patterns and a skip-chain conditional random field.

Patterns find what is certain: e-mail and IP addresses, card and phone numbers. In all documents
a random field labels the other tokens with a digit or an @: neighbours in the
text share chain potentials, and mentions of the same or a similar string, however far
apart, share skip potentials. Tokens inside pattern matches are observed; loopy belief
propagation carries labels along the links to mentions that the patterns miss, such as
a phone number repeated without its country code or a secret that is named once and then used bare. Tokens without digit and @ are observed
as no data, so the chain falls apart into short runs with nothing lost.

There are no hand labels. The field is trained on matches of the patterns and on secrets that a text
itself calls so (``token = "..."``), and on further mentions of both that are written into the
training texts in forms that the patterns miss, among numbers and hashes of like looks that are
no personal data. What a mention looks like and what stands before it are hidden at random, so links
learn to tell what a token is where its look doesn't.

A token has a skip link to the next token with the same key only, so links grow in
proportion to tokens however often a string is repeated.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_slices, ship, stored

ship(__name__)
KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans: the field adds secrets.
EVERY = (*KINDS, "secret")
#: Documents that train the field, about: of all that hold personal data, those of the smallest hashes; and code points of each, around its tokens.
MOST_DOCS, MOST_CHARS = 2_000, 8_192
#: Belief from which a token becomes a span, the part of a message that is kept, and the change of a message that still counts.
BELIEF, DAMPING, SETTLED = 0.8, 0.3, 1e-4
#: Rounds of message passing at most, besides one for each token at hand, as long as any chain is: messages that circle without settling stop there.
ROUNDS = 100
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive, and at the first digit of a run only: inner starts of a run can't match where its start doesn't.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, TOKEN, TELLS = re.compile(r"[0-9]"), re.compile(r"\S+"), re.compile(r"[0-9@]")
CORE = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?", re.DOTALL)
#: What a text itself calls a secret, and what of it stands before a token; code points before a token that count.
NAMES = r"(?i:token|secret|passwor[dt]|passwd|pwd|api[_-]?key|access[_-]?key|auth[a-z]*)"
NAMED, CALLED, BEFORE = re.compile(NAMES + r"[\"']?\s*[=:]\s*[\"']?(?P<value>[^\s\"']{12,})"), re.compile(NAMES), 24
HEX = re.compile("[0-9a-f]+|[0-9A-F]+")
#: An area code in parentheses with a number after it.
NATIONAL = re.compile(r"\([0-9]{2,5}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])")


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(double[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What leftmost search for the pattern finds, in linear time: each match has one @ with its longest local part before it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1, start):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    return out


def patterns(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in code points, end exclusive."""
    out = [emails(text), [], [], []]
    if DIGIT.search(text):
        out[1] = [m.span() for m in IP.finditer(text) if all(len(y := x.lstrip("0")) < 4 and int(y or "0") < 256 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d):
                out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    """Spans of the values that a text names as secrets, with a digit and a letter."""
    out = []
    for m in NAMED.finditer(text):
        found = CORE.search(text, *m.span("value"))
        if found and DIGIT.search(found[0]) and any(map(str.isalpha, found[0])):
            out.append(found.span())
    return out


def shape(core: str, before: str, national: bool) -> list[int]:
    """Numbers of a token's features: its look, then from CONTEXT on what stands before it."""
    digits = sum(map(str.isdigit, core))
    letters = sum(map(str.isalpha, core))
    size = 0 if digits < 1 else 1 if digits < 4 else 2 if digits < 7 else 3 if digits < 10 else 4 if digits < 16 else 5 if digits < 20 else 6
    length = 0 if len(core) < 8 else 1 if len(core) < 16 else 2 if len(core) < 32 else 3
    out = [0, 1 + size, 8 + length]
    only = re.sub("[^0-9]", "", core)
    looks = (
        "@" in core, "." in core, core.count(".") == 3, "-" in core, "(" in core, core[:1] == "+", letters > 0, letters > digits, "_" in core,
        len(only) >= 13 and not letters and luhn(only), len(core) >= 12 and letters > 0 and bool(HEX.fullmatch(core)), len(core) >= 16 and letters > 0 and digits > 0,
        core.count("-") == 1, core.count("-") > 1 or core.count(".") == 2, national,
    )
    out += [12 + k for k, has in enumerate(looks) if has]
    tail = before.rstrip("\"' \t")
    return out + [CONTEXT + k for k, has in enumerate((tail[-1:] in ("=", ":") and tail != "", bool(CALLED.search(before)))) if has]


CONTEXT = 27
FEATURES, LABELS = CONTEXT + 2, 1 + len(EVERY)


def keys(core: str) -> list[tuple[int, str]]:
    """What links a token with like ones: the same letters and digits (type 0), the same seven or more digits or local part (type 1)."""
    low = core.lower()
    out = [(0, same)] if len(same := re.sub(r"[^a-z0-9@]", "", low)) >= 4 else []
    digits = re.sub(r"[^0-9]", "", low)
    if len(digits) >= 7:
        out.append((1, digits[-7:]))
    if "@" in low[4:]:
        out.append((1, low.split("@")[0]))
    elif len(low) >= 4 and any(map(str.isalpha, low)):
        out.append((1, low))
    return out


class Graph:
    """The tokens of documents with their links. kind: 0 none, 1 to 5 a kind, -1 where the field decides."""

    def __init__(self):
        self.span, self.doc, self.kind, self.shape = [], [], [], []
        self.links: tuple[list, list, list] = ([], [], [])  # chain; skip: same; skip: similar

    def add(self, doc: int, text: str, base: list[list[tuple[int, int]]]) -> None:
        spans = sorted((a, b, k + 1) for k, own in enumerate(base) for a, b in own)
        last: dict[tuple, int] = {}
        at, before, before_end, called = 0, -1, -2, [m.span() for m in NATIONAL.finditer(text)] if "(" in text else []
        called.reverse()
        for m in TOKEN.finditer(text):
            if not TELLS.search(m[0]):
                continue
            found = CORE.search(text, *m.span()) or m
            (a, b), core = found.span(), found[0]
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            n = len(self.doc)
            self.span.append((a, b))
            self.doc.append(doc)
            # A token inside or around a match has its label.
            self.kind.append(spans[at][2] if at < len(spans) and spans[at][0] < b else -1)
            while called and called[-1][1] <= a:
                called.pop()
            self.shape.append(shape(core, text[max(0, a - BEFORE) : a].rpartition("\n")[2], bool(called) and called[-1][0] < b))
            if before >= 0 and text[before_end : m.start()].isspace():
                self.links[0].append((before, n))
            before, before_end = n, m.end()
            linked = set()
            for kind, key in keys(core):
                if (x := last.get((kind, key), -1)) >= 0 and x not in linked:
                    self.links[1 + kind].append((x, n))
                    linked.add(x)
                last[kind, key] = n


class Field:
    """Weights: of features, FEATURES x LABELS; of links, one LABELS x LABELS table for each type."""

    def __init__(self, node: np.ndarray, link: np.ndarray):
        self.node, self.link = node, link

    @staticmethod
    def fit(graph: Graph, rounds: int = 500, ridge: float = 0.1) -> Field:
        """By pseudo-likelihood: each token given its neighbours' labels. Tokens of kind -1 are left out.

        A sixth of the tokens, at random, hide their features, so links learn to tell what a
        token is where its look doesn't, and a sixth what stands before them; a third are shown
        without their neighbours' labels, so looks learn to tell it where links don't.
        """
        n = len(graph.doc)
        kind = np.array(graph.kind, np.int64)
        known, y = kind >= 0, np.maximum(kind, 0)
        x = np.zeros((n, FEATURES))
        for i, own in enumerate(graph.shape):
            x[i, own] = 1
        draw = np.array([hashlib.blake2b(f"{d}:{s}".encode(), digest_size=1).digest()[0] for d, s in zip(graph.doc, graph.span, strict=True)])
        x[draw < 43] = 0
        x[draw >= 213, CONTEXT:] = 0
        alone = (43 <= draw) & (draw < 128)
        x[~known] = 0
        links = [np.array(own, np.int64).reshape(-1, 2) for own in graph.links]
        links = [e[known[e].all(axis=1)] for e in links]
        node, link = np.zeros((FEATURES, LABELS)), np.zeros((len(links), LABELS, LABELS))
        steps = [np.zeros_like(node), np.zeros_like(link), np.zeros_like(node), np.zeros_like(link)]
        one_hot = np.eye(LABELS)[y]
        for t in range(1, rounds + 1):
            score = x @ node
            for k, e in enumerate(links):
                np.add.at(score, e[:, 0], link[k].T[y[e[:, 1]]])
                np.add.at(score, e[:, 1], link[k][y[e[:, 0]]])
            score[alone] = (x @ node)[alone]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            off = (p / p.sum(axis=1, keepdims=True) - one_hot) * known[:, None]
            g_node, g_link = x.T @ off + ridge * node, ridge * link
            off[alone] = 0
            for k, e in enumerate(links):
                np.add.at(g_link[k].T, y[e[:, 1]], off[e[:, 0]])
                np.add.at(g_link[k], y[e[:, 0]], off[e[:, 1]])
            for w, g, m, v in ((node, g_node, steps[0], steps[2]), (link, g_link, steps[1], steps[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        # Skip links have no direction.
        link[1:] = (link[1:] + link[1:].transpose(0, 2, 1)) / 2
        return Field(node, link)

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Each token's chances of the labels, by loopy sum-product with observed tokens held.

        Only messages whose inputs changed are sent again, until all have settled, so a label
        crosses a chain of any length and costs no more than the links it passes.
        """
        n, kind = len(graph.doc), np.array(graph.kind, np.int64)
        look = np.zeros((n, LABELS))
        for i, own in enumerate(graph.shape):
            look[i] = self.node[own].sum(axis=0)
        seen = kind >= 0
        look[seen] = np.where(np.eye(LABELS)[kind[seen]] > 0, 0.0, -50.0)
        links = [np.array(own, np.int64).reshape(-1, 2) for own in graph.links]
        e = np.concatenate(links)
        table = np.repeat(self.link, [len(x) for x in links], axis=0)
        source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        table, m = np.concatenate([table, table.transpose(0, 2, 1)]), len(e)
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        sent, total = np.zeros((2 * m, LABELS)), look.copy()
        order = np.argsort(source, kind="stable")
        first = np.searchsorted(source[order], np.arange(n + 1))
        live, left = np.arange(2 * m), ROUNDS + n
        while len(live) and left:
            left -= 1
            own = (total[source[live]] - sent[back[live]])[:, :, None] + table[live]
            top = own.max(axis=1, keepdims=True)
            new = np.log(np.exp(own - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            new = DAMPING * sent[live] + (1 - DAMPING) * new
            change = new - sent[live]
            sent[live] = new
            np.add.at(total, target[live], change)
            moved = np.abs(change).max(axis=1) > SETTLED
            at = np.unique(target[live[moved]])
            # What a moved token sends, and the moved messages themselves, as damping holds part of them back.
            size = first[at + 1] - first[at]
            out = order[np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            live = np.union1d(out, live[moved])
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def find(texts: list[str], field: Field | None) -> list[tuple[list[list], list[list]]]:
    """For each text the pattern spans, by kind, and all spans, by kind too; without a field the same."""
    base = [patterns(t) for t in texts]
    every = [[*([*own] for own in b), []] for b in base]
    graph = Graph()
    for k, (t, b) in enumerate(zip(texts, base, strict=True)):
        if field is not None:
            graph.add(k, t, b)
    if graph.doc and -1 in graph.kind:
        p = field.beliefs(graph)
        kind = p.argmax(axis=1)
        chosen = (np.array(graph.kind) < 0) & (kind > 0) & (p.max(axis=1) >= BELIEF)
        # The parts of one phone number are neighbours and become one span.
        goes_on = {b: a for a, b in graph.links[0] if chosen[a] and chosen[b] and kind[a] == kind[b] == 4}
        for i in np.flatnonzero(chosen).tolist():
            own = every[graph.doc[i]][kind[i] - 1]
            start = own.pop()[0] if i in goes_on else graph.span[i][0]
            own.append((start, graph.span[i][1]))
    return [(b, [sorted(own) for own in e]) for b, e in zip(base, every, strict=True)]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(EVERY, spans) for a, b in own)


def around(text: str, most: int) -> str:
    """The tokens of a text with a digit or @ and what stands before them, as many as ``most`` code points hold."""
    out, end, held = [], 0, 0
    for m in TOKEN.finditer(text):
        if TELLS.search(m[0]):
            start = max(end, m.start() - BEFORE)
            piece = (" | " if start > end else "") + text[start : m.end()]
            if held + len(piece) > most:
                break
            out.append(piece)
            end, held = m.end(), held + len(piece)
    return "".join(out)


def mentions(text: str, number: int) -> tuple[str, list[list[tuple[int, int]]]]:
    """A training text with further mentions at its end, and all spans by kind. number decides the forms."""
    spans = [*patterns(text), secrets(text)]
    rng, out = np.random.default_rng(number), [text, "\n"]
    size = len(text) + 1
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def put(before: str, token: str, kind: int | None) -> None:
        nonlocal size
        if kind is not None:
            spans[kind].append((size + len(before), size + len(before) + len(token)))
        out.append(f"{before}{token}, ")
        size += len(before) + len(token) + 2

    def form(d: str) -> str:
        return (f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"{d[-7:-4]}-{d[-4:]}", d[-10:])[rng.integers(5)]

    found = [[text[a:b] for a, b in own] for own in spans]
    if rng.integers(2):
        for own in found[3][:8]:
            d = re.sub("[^0-9]", "", own)
            for _ in range(2 if len(d) >= 10 else 0):
                put("again at ", form(d), 3)
        for own in found[2][:8]:
            d = re.sub("[^0-9]", "", own)
            put("paid with ", "./_"[rng.integers(3)].join(d[i : i + 4] for i in range(0, len(d), 4)), 2)
        for own in found[4][:8]:
            put("used ", own, 4)
    # National forms of numbers that the text has nowhere else, and what only looks alike.
    d = "2345678"[rng.integers(7)] + digits(2) + "555" + digits(4)
    put("ring ", (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}")[rng.integers(2)], 3)
    card = digits(15)
    card += next(c for c in "0123456789" if luhn(card + c))
    put("paid with ", "./_"[rng.integers(3)].join(card[i : i + 4] for i in range(0, 16, 4)), 2)
    wrong = card[:15] + str((int(card[15]) + 5) % 10)
    alike = (
        ("part ", digits(3) + "-" + digits(4)), ("part ", digits(7)), ("part ", digits(10)), ("part ", ".".join(wrong[i : i + 4] for i in range(0, 16, 4))), ("part ", wrong),
        ("on ", f"20{digits(2)}-0{digits(1)}-1{digits(1)}"), ("in ", digits(4)), ("no ", digits(rng.integers(1, 5)) + "." + digits(1)), ("row ", "(" + digits(3) + ")"),
        ("commit ", hashlib.sha1(str(number).encode()).hexdigest()), ("checksum: ", hashlib.md5(str(number).encode()).hexdigest()),
    )
    for k in rng.permutation(len(alike))[:4]:
        put(*alike[k], None)
    return "".join(out), [sorted(own) for own in spans]


def train(docs: DataFrame, most: int = MOST_DOCS) -> tuple[np.ndarray, np.ndarray] | None:
    """A field's weights, from about ``most`` documents at most of all that have pattern matches or named secrets, however rare these are; None without any."""
    likely = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").filter(F.col("text").rlike("[0-9@]"))
    has = lambda t: any(patterns(t)) or bool(secrets(t))

    def mark(part):
        return {"h": [h for h, t in zip(part.column("h").to_pylist(), part.column("text").to_pylist(), strict=True) if has(t)]}

    n = stored(map_slices(likely, mark, "h bigint"), "marked").count()
    share = min(1.0, most / max(1, n))

    def cut(part):
        rows = [(h, around(t, MOST_CHARS)) for h, t in zip(part.column("h").to_pylist(), part.column("text").to_pylist(), strict=True) if has(t)]
        return {"h": [h for h, _ in rows], "text": [t for _, t in rows]}

    rows = map_slices(likely.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)), cut, "h bigint, text string").toPandas()
    graph = Graph()
    for k, (h, t) in enumerate(sorted(zip(rows["h"], rows["text"]))):
        before = len(graph.doc)
        graph.add(k, *mentions(t, h % (1 << 32)))
        graph.kind[before:] = [max(x, 0) for x in graph.kind[before:]]
    if not any(k > 0 for k in graph.kind):
        return None
    field = Field.fit(graph)
    return field.node, field.link


def annotate(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, the number of pattern spans of each kind, base_sha256 of them, all spans, and how many the field added.

    A null text counts as empty and has none; texts of any length are searched whole. Rows are judged by themselves, so repeated rows
    are alike and an empty table gives no rows; other columns, whatever their names, are not read. Added spans have
    the listed kinds or are secrets and never overlap a pattern's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(part, field):
        found = find([t or "" for t in part.column("text").to_pylist()], field)
        out = {"doc_id": part.column("doc_id")}
        for k, kind in enumerate(KINDS):
            out[f"n_{kind}"] = [len(b[k]) for b, _ in found]
        count = lambda spans: sum(map(len, spans))
        return out | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(e) for _, e in found], "n_added": [count(e) - count(b) for b, e in found]}

    # Broadcasts hold arrays: executors may lack the classes of this package.
    start = lambda: Field(*sent.value) if sent.value else None
    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA, start=start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return annotate(docs, train(docs))
