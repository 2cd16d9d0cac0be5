"""Operators for training text against SQL, libraries and brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import DATA, table
from pyspark.sql import functions as F

from tessera.llm import _fit, bpe, exact_dedup, fingerprints, line_dedup, mixing, near_dedup, pii, quality, registry, toxicity, warc
from tessera.llm._common import scratch

ODD = [
    (1, "Some text here that repeats", "a", "x"), (2, None, None, "x"), (3, "", "a", "x"), (1, "Some text here that repeats", "a", "x"),
    (None, "no id", "b", None), (4, " Some text\there that repeats\n", "b", "x"), (5, "long " * 30_000, "a", "x"), (6, "one", "c", "x"),
]
SCHEMA = "doc_id long, text string, source string, node string"
LONG = " ".join(f"word{i}" for i in range(40))


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name operators use."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, oracle, name):
    assert table(registry.QUERIES[name](spark, DATA).toPandas()) == table(oracle.sql(registry.SQL[name]).df())


def test_exact_dedup_of_odd_rows_and_batches(spark):
    path = scratch(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    rows = exact_dedup.deduplicate(odd(spark), index, "first").collect()
    assert len(rows) == len(ODD) and sum(r["kept"] for r in rows) == 5
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 4)} == {4}
    # A batch whose result was lost runs again, with other partitions, by an index opened anew.
    index.drop()
    index = exact_dedup.DigestIndex(spark, path, 4)
    retried = exact_dedup.deduplicate(odd(spark).repartition(3, "text"), index, "first").collect()
    assert sorted(map(str, retried)) == sorted(map(str, rows)) and index.table().count() == 5
    again = exact_dedup.deduplicate(odd(spark), index, "second").collect()
    assert all(r["seen_before"] and not r["kept"] for r in again) and index.table().count() == 5
    assert exact_dedup.deduplicate(odd(spark).limit(0), index, "third").count() == 0


def brute_patterns(t):
    out = []
    for kind, p in zip(pii.KINDS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"), strict=True):
        own = []
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            weights = [(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(d))]
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and sum(weights) % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]:
                own.append(m.span())
        out.append(own)
    return out


def test_pii_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789999....--- ++()@@ab_%x\n٣é") for _ in range(rng.randint(0, 40)))
        assert pii.patterns(t) == brute_patterns(t)
    for t in ("1" * 50_000, "a" * 50_000, "@" * 50_000, "+1" + " " * 50_000, "$" * 50_000 + " a@b.c", "0" * 6_000 + ".1.1.1"):
        assert len(pii.find([t], None)) == 1


def number(rng, n):
    return "".join(str(rng.randrange(10)) for _ in range(n))


def card_number(rng):
    d = number(rng, 15)
    return d + next(c for c in "0123456789" if pii.luhn(d + c))


@pytest.fixture(scope="module")
def field(spark):
    """A field trained on texts with phone and card numbers, addresses and named secrets."""
    rng, texts = random.Random(11), ["nothing here", "", None]
    for i in range(300):
        d = number(rng, 7)
        texts.append(f"Call +1 (415) {d[:3]}-{d[3:]} soon, or write to user{i}@example.org from 10.0.{i % 256}.1 in room {i}.")
        texts.append(f'paid {card_number(rng)} in {1900 + i % 120}, token = "{rng.getrandbits(160):040x}" and version {i % 9}.0.')
    return pii.Field(*pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))


def test_pii_field_finds_planted_mentions(field):
    """Mentions that the patterns miss, among numbers and hashes that are no personal data: precision and recall of the added spans."""
    rng, tp, fp, fn = random.Random(5), 0, 0, 0
    for n in range(300):
        d, secret = number(rng, 10), f"{rng.getrandbits(160):040x}"
        forms = (f"{d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}")
        dotted = card_number(rng)
        planted = [
            [(f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", None)] + [(rng.choice(forms), "phone") for _ in range(rng.choice([1, 3, 50]))],
            [(rng.choice("./_").join(dotted[i : i + 4] for i in range(0, 16, 4)), "card")],
            [(f'api_key: "{secret}"', None)] + [(secret, "secret") for _ in range(rng.choice([1, 5]))],
        ][n % 3]
        planted += [(number(rng, 3) + "-" + number(rng, 4), None), (f"commit {rng.getrandbits(160):040x}", None), (number(rng, 16), None), (str(rng.randrange(1900, 2030)), None)]
        text, want = "", set()
        for token, kind in planted:
            text += " ".join(rng.choice(["the", "of", "room", "later"]) for _ in range(4)) + " "
            if kind:
                want.add((kind, len(text), len(text) + len(token)))
            elif token.startswith("api"):
                want.add(("secret", len(text) + 10, len(text) + len(token) - 1))
            text += token + " "
        (base, every), = pii.find([text], field)
        got = {(kind, *x) for kind, own, known in zip(pii.EVERY, every, [*base, []], strict=True) for x in own if x not in known}
        assert all(set(b) <= set(e) for b, e in zip(base, every))
        tp, fp, fn = tp + len(got & want), fp + len(got - want), fn + len(want - got)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.85, (tp, fp, fn)


def test_pii_rows(spark, field):
    weights = field.node, field.link
    rows = pii.annotate(odd(spark), weights).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.annotate(odd(spark).limit(0), weights).count() == 0
    text = "mail a@b.org then +1 415 555 1234 x"
    (row,) = pii.annotate(spark.createDataFrame([(1, text, 7, 8)], "doc_id long, text string, spans int, n_email int"), weights).collect()
    assert row["spans"].startswith("email:5:12,") and row["n_email"] == row["n_phone"] == 1 and row["base_sha256"] == hashlib.sha256(b"email:5:12,phone:18:33").hexdigest()
    # Without personal data to learn from, the patterns alone.
    assert pii.train(odd(spark)) is None and pii.train(odd(spark).limit(0)) is None
    assert pii.annotate(spark.createDataFrame([(1, text)], "doc_id long, text string"), None).first()["n_added"] == 0


def test_pii_training_does_not_depend_on_how_rare_matches_are(spark):
    docs = [(i, f"call +1 (415) 555-{i:04d} soon") for i in range(60)] + [(1000 + i, f"row {i} of 12") for i in range(3000)]
    assert pii.train(spark.createDataFrame(docs, "doc_id long, text string"), 30) is not None


def test_pii_field_reaches_all_mentions(field):
    graph = pii.Graph()
    graph.add(0, "+1 415 555 1234 5551234" + " and 5551234" * 50, [[], [], [], [(0, 15)]])
    chain = [(i, i + 1) for i in range(len(graph.doc) - 1)]
    # Only the first token tells anything: its label has to cross all links.
    graph.links, graph.kind = ([], chain, []), [4] + [-1] * len(chain)
    graph.shape = [[] for _ in graph.shape]
    n = pii.LABELS
    strong = pii.Field(np.zeros_like(field.node), np.array([np.zeros((n, n)), 8 * np.eye(n), np.zeros((n, n))]))
    p = strong.beliefs(graph)
    exact = np.eye(n)[4]
    step = np.exp(8 * np.eye(n)) / np.exp(8 * np.eye(n)).sum(axis=0)
    for own in p:
        assert own == pytest.approx(exact, abs=1e-2)
        exact = step @ exact
    assert (p[:, 4] > 0.85).all()
    plain = " then ".join(["(415) 555-1234"] * 3)
    calls = []

    class Seen(pii.Field):
        def beliefs(self, graph):
            calls.append(len(graph.doc))
            return super().beliefs(graph)

    pii.find([plain], Seen(field.node, field.link))
    assert calls == [6]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    with open(bpe.vocabulary_path(), "rb") as f:
        own = bpe.WordBPE(f.read())
    rng = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts += ["", " ", "<|endoftext|> a<|startoftext|>", "don't 123 ΑΣ Σ İ \x1c\x1f  日本語 é é \U0001f600", "x" * 3000, " a\u0085b"]
    texts += ["".join(rng.choice("abcthe 'st12é日!?\n<|>") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == t.decode(want, skip_special_tokens=False), text


def test_warc_of_odd_rows(spark):
    page = "<p>" + "a" * 1200
    rows = [(1, "u\r\nx", page), (2, None, page), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", page), (5, "u", "é" * 400)]
    archive = warc.Archive(spark, scratch(spark, "warc"), 4)
    total = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), archive)
    found = warc.read(archive, total).collect()
    assert len(found) == len(rows) and all(r["verified"] for r in found)
    assert {(r["page_id"], r["refers_to"]) for r in found if r["record_type"] == "revisit"} == {(1, 2), (None, 2)}
    full = next(r for r in found if r["page_id"] == 2)["record"]
    assert bytes(full).endswith(page.encode() + b"\r\n\r\n") and archive.payloads().count() == 3
    archive.drop()
    # A store whose bytes were changed: no record of them is verified, revisits included.
    bad = warc.Archive(spark, scratch(spark, "warc"), 4)
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, digest string")
    warc.write(pages, bad)
    spoiled = bad.payloads().withColumn("payload", F.when(F.col("n") > 1000, F.lit(b"other")).otherwise(F.col("payload")))
    bad.payloads = lambda: spoiled
    found = warc.read(bad, total).collect()
    assert len(found) == len(rows) and {r["page_id"] for r in found if not r["verified"]} == {1, 2, None}
    empty = warc.Archive(spark, scratch(spark, "warc"), 4)
    assert warc.write(pages.limit(0), empty) == 0 and warc.read(empty, 0).count() == 0


@pytest.mark.parametrize(("module", "column", "mod", "rest"), [(toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)])
def test_scores(spark, module, column, mod, rest):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(spark, docs, labels)
    scored = module.score(docs, *model).join(labels.groupBy("doc_id").agg(F.max(column).alias("y")), "doc_id").toPandas()
    held = scored[scored.held_out]
    good, bad = held[held.y == 1].score.to_numpy(), held[held.y == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.8
    rows = module.score(odd(spark), *model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(odd(spark).limit(0), *model).count() == 0
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in rows if r["doc_id"] is not None)


def test_toxicity_counts_are_exact(spark):
    import zlib
    from collections import Counter

    seen, pairs = {}, []
    for i in range(20_000):  # pairs of words whose short hashes are equal
        w = f"{chr(97 + i % 26)}{i}"
        if (other := seen.setdefault(zlib.crc32(w.encode()) % (1 << 20), w)) != w:
            pairs.append((other, w))
    rng = random.Random(4)
    rare = [w for p in pairs[:40] for w in p]
    rows = [(" ".join(rng.choice(rare + ["common", "commonly", "comma"]) for _ in range(30)), rng.choice([0, 1, None])) for _ in range(300)]
    rows += [(f"{a} {a}", 1) for a, _ in pairs[:20]] * 6 + [(f"{b} x", 0) for _, b in pairs[:20]] * 6
    docs = spark.createDataFrame(rows, "text string, y int")
    cut = lambda w, n: w[:n] if n else w
    every = [[Counter(), Counter(), Counter()] for _ in toxicity.LEVELS]
    for t, y in rows:
        for k, n in enumerate(toxicity.LEVELS):
            for form in {cut(w, n) for w in t.split()}:
                every[k][2][form] += 1
                if y is not None:
                    every[k][y][form] += 1
    for k in (1, 2):  # prefixes count their continuations
        for c in (0, 1, 2):
            longer = {form for t, y in rows if c == 2 or y == c for form in (cut(w, toxicity.LEVELS[k - 1]) for w in t.split())}
            every[k][c] = Counter(cut(form, toxicity.LEVELS[k]) for form in longer)
    ask, want = sorted({w for t, _ in rows for w in t.split()}), []
    for w in ask:
        p = []
        for c in (0, 1):
            share = lambda k: (every[k][2][cut(w, toxicity.LEVELS[k])] + 0.1) / (sum(every[k][2].values()) + 0.1 * len(every[k][2]))
            q = share(2)
            for k in (2, 1, 0):
                own = every[k][c]
                one, two = (sum(x == toxicity.LEAST + i for x in own.values()) for i in (0, 1))
                d, total = min(0.95, max(0.5, one / max(1, one + 2 * two))), sum(own.values()) + 1.0
                left = {f: x - d for f, x in own.items() if x >= toxicity.LEAST}
                q = left.get(cut(w, toxicity.LEVELS[k]), 0) / total + (total - sum(left.values())) / total * q
                if k:
                    q *= min(share(k - 1) / share(k), 1)
            p.append(q)
        want.append(np.log(p[1]) - np.log(p[0]))
    for words in (toxicity.Words(), toxicity.Words(10)):
        got = toxicity.Models(toxicity.fitted(toxicity.counted(docs))).features(ask, words)[:, 0]
        assert got == pytest.approx(want, abs=1e-5)
    assert toxicity.Models(toxicity.fitted(toxicity.counted(docs.limit(0)))).features(["a b", ""], toxicity.Words()).tolist() == [[0, 0, 0, 0]] * 2


def test_logistic_of_one_class():
    w = _fit.logistic(np.ones((3, 2)), np.zeros(3))
    assert (_fit.chance(np.ones((3, 2)), w) < 0.3).all()


def brute_runs(docs, least):
    """The lines that go, of documents in order, by comparing all pairs of positions."""
    gone = [set() for _ in docs]
    for x, y in ((x, y) for x in range(len(docs)) for y in range(x + 1)):
        own, of = docs[x], docs[y]
        for i, j in ((i, j) for i in range(len(own)) for j in range(i if x == y else len(of))):
            if own[i] != of[j] or (i and j and own[i - 1] == of[j - 1]):
                continue
            k = 0
            while i + k < len(own) and j + k < len(of) and own[i + k] == of[j + k]:
                k += 1
            full = [t for t in range(i, i + k) if own[t].split()]
            if sum(len(own[t].split()) for t in full) >= least:
                gone[x].update(range(full[0], full[-1] + 1))
    return gone


def test_line_dedup_deletes_longest_runs():
    rng = random.Random(1)
    for _ in range(2000):
        docs = [[rng.choice(["a", "a b", "c", "", "", "d e f", " ", "g h i j"]) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 4))]
        least, at, got = rng.choice([3, 5, 6]), [], [set() for _ in docs]
        for x, own in enumerate(docs):
            at += [(gram, x, a, b) for found in line_dedup.anchors("\n".join(own), least).values() for a, b, gram in found]
        first = {}
        for gram, x, a, _ in at:
            first[gram] = min(first.get(gram, (x, a)), (x, a))
        for gram, x, a, b in at:
            if (x, a) != first[gram]:
                got[x].update(range(a, b + 1))
        assert got == brute_runs(docs, least), (docs, least)


def test_line_dedup_of_odd_rows(spark):
    tail = " ".join(f"tail{i}" for i in range(20))
    rows = [(1, f"a\n{LONG}\nb", "s", 5), (2, f"{LONG}\nc", "s", 5), (3, LONG, "s", 5), (4, "short\nshort", "s", 5), (5, "x y z\n" * 40, "s", 5), (None, LONG, "s", 5), (6, None, "s", 5), (6, None, "s", 5), (7, "", "s", 5)]
    rows += [(8, f"p\n{tail} x\n{LONG} y\n{tail}\nq", "s", 5), (9, f"r\n{tail} x\n{LONG} y\n{tail}\nz", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, deleted_lines string, runs long")
    found = {r["doc_id"]: r for r in line_dedup.cut(docs).collect()}
    assert found[None]["text"] == LONG and found[1]["text"] == "a\nb" and found[2]["text"] == "c" and found[3]["text"] == ""
    assert found[4]["text"] == "short\nshort" and found[5]["text"] == "x y z\n" and found[6]["text"] is None and found[7]["deleted_lines"] == 0
    # The run goes with both its ends, which are too short to be found by themselves.
    assert found[8]["text"] == rows[9][1] and found[9]["text"] == "r\nz" and found[9]["deleted_lines"] == 3
    kept = line_dedup.stage(spark, docs.withColumn("line_count", F.lit("mine")), "")
    assert kept.columns == [*docs.columns, "line_count"] and {(r["deleted_lines"], r["runs"], r["line_count"]) for r in kept.collect()} == {("s", 5, "mine")}
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 6, 7, 8, 9]
    assert line_dedup.cut(docs.limit(0)).count() == 0


def test_mixing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = mixing.mix(docs).toPandas()
    assert (out.taken <= 2 * out["size"]).all() and (out.taken % out["size"].where(out["size"] > 0, 1) == 0).all()
    by = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()
    assert by.target.sum() == pytest.approx(1.5 * out["size"].sum())
    assert table(mixing.mix(docs).toPandas()) == table(out)
    # Targets by pouring what is left over again, source by source.
    sizes, weights = docs.groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).toPandas().sort_values("source"), {}
    own = dict(zip(sizes["source"], sizes["n"]))
    weights, aim, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(own)}, dict.fromkeys(own, 0.0), 1.5 * sum(own.values())
    while left > 1e-9:
        free = {s: w for s, w in weights.items() if aim[s] < 2 * own[s] - 1e-9}
        step = min(left / sum(free.values()), min((2 * own[s] - aim[s]) / w for s, w in free.items()))
        for s, w in free.items():
            aim[s] += step * w
        left -= step * sum(free.values())
    assert by.target.to_dict() == pytest.approx(aim)
    assert mixing.mix(odd(spark)).count() == len(ODD) and mixing.mix(odd(spark).limit(0)).count() == 0


def test_mixing_stage_keeps_columns(spark):
    rows = [(i % 40, f"{'w ' * (i % 7 + 1)}", "ab"[i % 2], i, "x", None, 1) for i in range(80)] + [(None, f"{i} a b", "a", i, "y", None, 2) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long, copies string, m_id long, times int")
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    found = out.collect()
    assert {tuple(r) for r in found} <= set(rows) and len({r["copy"] for r in found}) > 20
    taken = mixing.mix(docs).toPandas()
    assert len(found) == taken.copies.sum()
    free = taken[taken.doc_id.isna()]
    assert free.copies.nunique() > 1  # rows without an id are drawn one by one
    assert mixing.stage(spark, docs.limit(0), "").count() == 0


def test_pivot_keeps_words_and_expectations():
    import pandas as pd

    rng = np.random.default_rng(0)
    n = 500
    pdf = pd.DataFrame({"source": "a", "unit": np.arange(n), "block": 0, "size": rng.integers(1, 900, n), "whole": 0, "part": 0.3, "open": True})
    out = mixing.pivot(pdf, 0, False)
    assert out.open.sum() <= 1 and (out["size"] * out.part).sum() == pytest.approx((pdf["size"] * 0.3).sum())


@pytest.mark.parametrize("plain", [False, True])
def test_near_dedup_equals_brute_force(spark, plain):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 200))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(rng.randint(1, 6)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c))
    texts += ["", " ", None, "a b", "a b", "a c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in (fingerprints.similar if plain else near_dedup.near_duplicates)(docs).collect()}
    sampler = fingerprints.Sets() if plain else near_dedup.Sampler(near_dedup.idf_table(docs))
    sets = sampler.weighted([t or "" for t in texts])
    own = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if near_dedup.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((own[a], own[b]))
                own = [low if x == high else x for x in own]
    assert got == dict(enumerate(own))
    if not plain:
        kept = near_dedup.stage(spark, docs, "").collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(set(own))


def test_near_dedup_counts_words_exactly(spark, monkeypatch):
    rng, texts = random.Random(6), []
    vocabulary = [f"w{i}" for i in range(30_000)]
    for _ in range(600):
        texts.append(" ".join(rng.choice(vocabulary[: rng.choice([50, 30_000])]) for _ in range(rng.randint(0, 80))))
    texts += [None, "", "a b", "a c", "a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    of = {}
    for t in texts:
        for w in set((t or "").split()):
            of[w] = of.get(w, 0) + 1
    for frequent in (near_dedup.FREQUENT, 1000):
        monkeypatch.setattr(near_dedup, "FREQUENT", frequent)
        floor = sum(of.values()) / frequent
        sampler = near_dedup.Sampler(near_dedup.idf_table(docs))
        assert len(sampler.table[0]) == sum(n > floor for n in of.values()) < frequent
        words = sorted(of)
        got = sampler.idf(np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words], np.uint64))
        assert got.tolist() == pytest.approx([np.log1p(len(texts) / (1.0 + max(of[w], floor))) for w in words], rel=1e-6)


def test_near_dedup_of_odd_rows(spark):
    rows = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD) and len({r["class_id"] for r in rows if r["doc_id"] in (1, 4)}) == 1
    assert near_dedup.stage(spark, odd(spark), "").count() == len({(r["class_id"], r["class_size"]) for r in rows})
    assert near_dedup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_near_dedup_keeps_unlike_texts_without_own_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c")), (None, text("c")), (7, text("d")), (7, text("e")), (7, text("e") + " more"), (8, text("f"))]
    kept = near_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in kept) == [(0, "a"), (0, "b"), (0, "c"), (7, "d"), (7, "e"), (8, "f")]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)]
    df = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in links], "a binary, b binary")
    own = {x: x for p in links for x in p}
    for _ in range(60):
        for a, b in links:
            own[a] = own[b] = min(own[a], own[b])
    got = {int.from_bytes(r["node"]): int.from_bytes(r["label"]) for r in near_dedup.components(df, "links").collect()}
    assert got == {x: y for x, y in own.items() if any(a != b and x in (a, b) for a, b in links)}


def test_fingerprints(spark):
    rows = fingerprints.edited(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    h = fingerprints.MinHash()
    want = {}
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        s = h.signatures([t, e, after])
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.hexed(s[0]), fingerprints.hexed(s[1]), float(np.mean((s[0] & 0xFFFF) == (s[1] & 0xFFFF))), float(np.mean((s[0] & 0xFFFF) == (s[2] & 0xFFFF))))
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want
    assert fingerprints.edited(odd(spark)).count() == len(ODD) and fingerprints.edited(odd(spark).limit(0)).count() == 0


def test_bpe_of_odd_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    docs = odd(spark).withColumns({"ids": F.lit("mine"), "n_tokens": F.lit(1), "decoded": F.lit(None).cast("string")})
    rows = bpe.encode(docs, bpe.vocabulary_path(), keep_ids=True).collect()
    assert len(rows) == len(ODD) and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    want = {hashlib.sha256(np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for _, x, *_ in ODD}
    assert {r["ids_sha256"] for r in rows} == want and {r["decoded_sha256"] for r in rows} == {hashlib.sha256(t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest() for _, x, *_ in ODD}
    assert bpe.encode(docs.limit(0), bpe.vocabulary_path()).count() == 0
    assert sorted(r["n_tokens"] for r in bpe.stage(spark, docs, "").collect()) == sorted(r["n_tokens"] for r in rows)


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores_without_labels(spark, module, column):
    labels = spark.createDataFrame([], f"doc_id long, {column} int")
    for docs in (odd(spark), odd(spark).limit(0)):
        scored = module.score(docs, *module.train(spark, docs, labels)).collect()
        assert len(scored) == docs.count() and all(r["predicted"] == 0 for r in scored)


def test_toxicity_stage_of_odd_rows(spark):
    docs = odd(spark).withColumns({"score": F.lit("mine"), "y": F.lit(None).cast("int"), "predicted": F.lit(7)})
    kept = toxicity.stage(spark, docs, DATA)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    assert kept.filter("text IS NULL OR text = ''").count() == 2 and toxicity.stage(spark, docs.limit(0), DATA).count() == 0


def test_near_dedup_stage_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 5, "b"), (1, text, 6, "a"), (2, text + " more", 7, "c"), (3, "other", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, node string")
    kept = [tuple(r) for r in near_dedup.stage(spark, docs, "").collect()]
    assert len(kept) == 2 and set(kept) <= set(rows) and rows[3] in kept
    # Rows alike in id and text: the choice does not depend on their order.
    assert set(kept) == {tuple(r) for r in near_dedup.stage(spark, docs.orderBy(F.col("_id").desc()).repartition(3), "").collect()}


def brute_classes(sets, ids):
    """The smallest id of each one's class, by comparing all pairs."""
    own = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if own[a] != own[b] and near_dedup.similarity(sets[a], sets[b]) >= near_dedup.SIMILAR:
                low, high = sorted((own[a], own[b]))
                own = [low if x == high else x for x in own]
    least = {}
    for x, i in zip(own, ids, strict=True):
        least[x] = min(least.get(x, i), i)
    return [least[x] for x in own]


def test_pipeline(spark):
    """Each stage against brute force on all that the one before it kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        kept[name] = docs
    read = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    before = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = toxicity.score(before, *toxicity.train(spark, before, spark.read.parquet(f"{DATA}/labels.parquet")))
    clean = {r["doc_id"] for r in scores.filter("predicted = 0").collect()}
    assert read(kept["toxicity"]) == [x for x in read(before) if x[0] in clean]
    rows = read(kept["toxicity"])
    lines, want = [t.split("\n") for _, t in rows], []
    for (i, _), own, gone in zip(rows, lines, brute_runs(lines, line_dedup.LEAST), strict=True):
        left = "\n".join(x for k, x in enumerate(own) if k not in gone)
        if not gone or left.split():
            want.append((i, left))
    assert read(kept["line_dedup"]) == want
    sets = near_dedup.Sampler(near_dedup.idf_table(kept["line_dedup"])).weighted([t for _, t in want])
    classes = brute_classes(sets, [i for i, _ in want])
    assert read(kept["near_dedup"]) == [x for x, c in zip(want, classes, strict=True) if x[0] == c]
    mixed = mixing.mix(kept["near_dedup"]).toPandas()
    assert read(kept["mixing"]) == sorted(x for x in read(kept["near_dedup"]) for _ in range(int(mixed.copies[mixed.doc_id == x[0]].iloc[0])))
    of = mixed.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((of.taken - of.target).abs() <= of.most).all()
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    found = corpus_pipeline.STAGES[-1][1](spark, kept["mixing"], DATA).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in found) == sorted((i, t.encode(x, add_special_tokens=False).ids) for i, x in read(kept["mixing"]))


def test_executors_need_not_have_the_package(tmp_path):
    """All queries in a process whose workers start in another folder and have no path to the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
conf = {{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": "w", "spark.checkpoint.dir": "c"}}
spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def missing(batches):
    import importlib.util
    assert importlib.util.find_spec("tessera") is None
    yield from batches
spark.range(4).mapInArrow(missing, "id long").collect()
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    # The pipeline runs the operators 3, 5, 6, 8 and 9; 1 and 4 have no Python.
    if name in ("pipeline", "op2_pii", "op7_quality", "op10_fingerprints", "knn_ann", "generate", "ingest_pages", "embedding_cache"):
        assert query(spark, {DATA!r}).count(), name
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONSTARTUP")}
    (tmp_path / "run.py").write_text(script)
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
