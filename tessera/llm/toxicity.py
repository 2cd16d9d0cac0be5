"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled texts, give each word its likelihood by
interpolated Kneser-Ney smoothing over growing prefixes: the word itself, its first six letters, its
first four. Words count the documents that have them, so a word that one text repeats counts once;
a prefix counts its continuations, the different longer forms that the class has of it. Each level is discounted and backs off to the
shorter one, and the shortest to continuation counts shared by both classes, of all documents of the corpus,
labelled or not. A text's features are differences of
its two length-normalised log-likelihoods, as a whole and in its most toxic windows; a
logistic curve, fitted on labelled rows that the models have not seen, makes them a score.

Words and prefixes are counted exactly, by 64-bit hash, in a DataFrame that grows with the corpus. The
models look up the shared counts of what a class counts at least LEAST times: those of all else cancel out of the ratio.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _fit
from ._common import map_slices, ship, slices, stored

ship(__name__)
WINDOWS = (24, 6, 1)
#: Letters of each level of the backoff; 0: the whole word.
LEVELS = (0, 6, 4)
#: Labelled rows of each class used for training, about; a quarter calibrates.
MOST_ROWS = 12_000
#: A class's counts below this are left to the backoff wholly.
LEAST = 3
GROUPS = ("shared", "of_0", "of_1")
WORD = re.compile(r"\w+")
COUNTS = pa.schema([("level", pa.int32()), ("key", pa.int64()), ("up", pa.int64()), ("shared", pa.int64()), ("of_0", pa.int64()), ("of_1", pa.int64())])


class Words:
    """Numbers the lower-cased words of texts; ``ids`` holds, for each number, the numbers of its forms at all levels, ``keys`` the hashes of each level's forms, ``up`` those of the next shorter ones."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known, self.ids, self.rated = {}, np.zeros((len(LEVELS), 0), np.int64), np.zeros(0)
        self.forms, self.keys, self.up = [{} for _ in LEVELS], [np.zeros(0, np.int64) for _ in LEVELS], [np.zeros(0, np.int64) for _ in LEVELS]

    def full(self) -> bool:
        return len(self.known) > self.most

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, and how many words each text has."""
        split = [WORD.findall(t.lower()) for t in texts]
        known = self.known
        if fresh := [w for w in set().union(*split) if w not in known]:
            rows = [[]] * len(LEVELS)
            for k in range(len(LEVELS) - 1, -1, -1):
                n, forms = LEVELS[k], self.forms[k]
                own = [w[:n] for w in fresh] if n else fresh
                new = [w for w in dict.fromkeys(own) if w not in forms]
                forms.update(zip(new, range(len(forms), len(forms) + len(new)), strict=True))
                hashes = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in new)
                self.keys[k] = np.concatenate([self.keys[k], np.frombuffer(hashes, "<i8")])
                if k + 1 < len(LEVELS):
                    shorter, m = self.forms[k + 1], LEVELS[k + 1]
                    self.up[k] = np.concatenate([self.up[k], self.keys[k + 1][[shorter[w[:m]] for w in new]]])
                else:
                    self.up[k] = np.zeros(len(self.keys[k]), np.int64)
                rows[k] = [forms[w] for w in own]
            self.ids = np.concatenate([self.ids, np.array(rows, np.int64)], axis=1)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        size = np.array([len(x) for x in split], np.int64)
        return np.fromiter((known[w] for x in split for w in x), np.int64, int(size.sum())), size


def counted(docs: DataFrame) -> DataFrame:
    """Counts over docs (text, y: 0, 1 or null) of all words and prefixes: level, key, the documents with it in all and of
    each class, and the same three of its continuations, the forms of the level before that begin with it.

    A task adds up its rows and sends each form once, or once for each time its words fill its table.
    """

    def run(batches):
        words, sums = Words(), [np.zeros((3, 0), np.int64) for _ in LEVELS]

        def sent():
            for k, x in enumerate(sums):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(x.shape[1], k, np.int32)), *map(pa.array, (words.keys[k], words.up[k], *x))], schema=COUNTS)

        for part in slices(batches):
            w, size = words.numbers([t or "" for t in part.column("text").to_pylist()])
            doc = np.repeat(np.arange(len(size), dtype=np.int64), size)
            y = np.array([-1 if y is None else y for y in part.column("y").to_pylist()], np.int64)
            once = np.unique(doc << 32 | w)
            for k in range(len(LEVELS)):
                key = np.unique(once >> 32 << 32 | words.ids[k][once & 0xFFFFFFFF])
                own, of, n = key & 0xFFFFFFFF, y[key >> 32], len(words.keys[k])
                sums[k] = np.pad(sums[k], ((0, 0), (0, n - sums[k].shape[1])))
                for row, got in enumerate((own, own[of == 0], own[of == 1])):
                    sums[k][row] += np.bincount(got, minlength=n)
            if words.full():
                yield from sent()
                words.clear()
                sums = [np.zeros((3, 0), np.int64) for _ in LEVELS]
        yield from sent()

    pieces = docs.select("text", "y").mapInArrow(run, "level int, key bigint, up bigint, shared bigint, of_0 bigint, of_1 bigint")
    forms = stored(pieces.groupBy("level", "key").agg(F.first("up").alias("up"), *[F.sum(c).alias(c) for c in GROUPS]), "forms")
    none = F.lit(0).cast("bigint")
    seen = forms.select("level", "key", "up", *GROUPS, *[none.alias(f"then_{c}") for c in GROUPS])
    longer = forms.filter(F.col("level") < len(LEVELS) - 1).select(
        (F.col("level") + 1).alias("level"), F.col("up").alias("key"), F.lit(None).cast("bigint").alias("up"), *[none.alias(c) for c in GROUPS], *[(F.col(c) > 0).cast("bigint").alias(f"then_{c}") for c in GROUPS]
    )
    return stored(seen.unionByName(longer).groupBy("level", "key").agg(F.max("up").alias("up"), *[F.sum(c).alias(c) for c in seen.columns[3:]]), "counts")


def discount(one: int, two: int) -> float:
    """The absolute discount n1 / (n1 + 2 n2) of the numbers of forms counted LEAST and LEAST + 1 times; lower counts are discounted wholly."""
    return min(0.95, max(0.5, one / max(1, one + 2 * two)))


def fitted(counts: DataFrame) -> tuple[list, list, list, list]:
    """Both models as arrays: for each level the hashes of held forms, their shared chances, and by class their own shares and what backs off.

    Held are the forms that a class counts at least LEAST times, by documents at the level of
    words and by continuations at those of prefixes, and what these begin with; they are as many as the labelled sample has.
    The shared chance of any other form is the same factor of both classes' likelihoods and is taken as 1.
    """
    used = counts.select("level", "key", "up", *[F.when(F.col("level") == 0, F.col(c)).otherwise(F.col(f"then_{c}")).alias(c) for c in GROUPS])
    low = lambda c, n: F.count(F.when(F.col(c) == n, 1)).alias(f"{c}_{n}")
    kept = lambda c: F.sum(F.when(F.col(c) >= LEAST, F.col(c)).otherwise(0)).alias(f"{c}_kept")
    many = lambda c: F.count(F.when(F.col(c) >= LEAST, 1)).alias(f"{c}_many")
    per_class = [f(c) for c in ("of_0", "of_1") for f in (lambda c: F.sum(c).alias(c), kept, many, lambda c: low(c, LEAST), lambda c: low(c, LEAST + 1))]
    sums = {r["level"]: r for r in used.groupBy("level").agg(F.sum("shared").alias("shared"), F.count("*").alias("n"), *per_class).collect()}
    enough, chosen = (F.col("of_0") >= LEAST) | (F.col("of_1") >= LEAST), []
    for k in range(len(LEVELS)):
        own = used.filter(F.col("level") == k)
        if chosen:
            begun = chosen[-1].select(F.col("up").alias("key")).distinct().withColumn("begun", F.lit(True))
            own = own.join(begun, "key", "left").filter(enough | F.col("begun")).select(used.columns)
        else:
            own = own.filter(enough)
        chosen.append(own)
    held = reduce(DataFrame.unionByName, chosen).toArrow()
    level = held.column("level").to_numpy()
    keys, shared, every, back = [], [], [[], []], [[], []]
    for k in range(len(LEVELS)):
        r, at = sums.get(k), np.flatnonzero(level == k)
        at = at[np.argsort(held.column("key").to_numpy()[at])]
        keys.append(held.column("key").to_numpy()[at])
        total = r["shared"] + 0.1 * r["n"] if r else 1.0
        shared.append(np.append((held.column("shared").to_numpy()[at] + 0.1) / total, 1.0))
        for c in ("of_0", "of_1"):
            own = held.column(c).to_numpy()[at]
            d = discount(r[f"{c}_{LEAST}"], r[f"{c}_{LEAST + 1}"]) if r else 0.0
            total = (r[c] if r else 0) + 1.0
            left = r[f"{c}_kept"] - d * r[f"{c}_many"] if r else 0.0
            # The last entry is of all forms that are not held.
            every[c == "of_1"].append(np.append(np.where(own >= LEAST, own - d, 0.0) / total, 0.0))
            back[c == "of_1"].append((total - left) / total)
    return keys, shared, every, back


class Models:
    """Both classes' interpolated models, from what ``fitted`` returns; each word's likelihood is made of its forms at all levels."""

    def __init__(self, arrays: tuple[list, list, list, list]):
        self.keys, self.shared, self.own, self.back = arrays

    def found(self, k: int, keys: np.ndarray) -> np.ndarray:
        """The places of hashes among the held ones of a level; of others the last."""
        held = self.keys[k]
        if not len(held):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        return np.where(held[at] == keys, at, len(held))

    def ratio(self, keys: list[np.ndarray]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) for words' hashes at each level."""
        at, p = [self.found(k, x) for k, x in enumerate(keys)], []
        for c in (0, 1):
            # From the shortest prefix to the word; the shared counts divide a prefix's mass among what it begins.
            q = self.shared[-1][at[-1]]
            for k in range(len(LEVELS) - 1, -1, -1):
                q = self.own[c][k][at[k]] + self.back[c][k] * q
                if k:
                    part = np.minimum(self.shared[k - 1][at[k - 1]] / self.shared[k][at[k]], 1)
                    q = q * np.where(at[k - 1] < len(self.keys[k - 1]), part, 1.0)
            p.append(q)
        return np.log(p[1]) - np.log(p[0])

    def features(self, texts: list[str], words: Words) -> np.ndarray:
        """The mean ratio of each text, and the largest mean of its windows of 24, 6 and 1 words; 0 without words.

        A text shorter than a window counts as if words that tell nothing filled it.
        """
        if words.full():
            words.clear()
        w, size = words.numbers(texts)
        if len(words.rated) < len(words.known):
            words.rated = np.append(words.rated, self.ratio([x[i] for x, i in zip(words.keys, words.ids[:, len(words.rated) :], strict=True)]))
        r = np.append(0, np.cumsum(words.rated[w]))
        end = np.cumsum(size)
        start, full = end - size, size > 0
        out = [(r[end] - r[start]) / np.maximum(size, 1)]
        at, doc_end = np.arange(len(w)), np.repeat(end, size)
        for n in WINDOWS:
            inside, most = at + n <= doc_end, np.full(len(w), -np.inf)
            most[inside] = (r[at[inside] + n] - r[at[inside]]) / n
            best = np.zeros(len(size))
            if full.any():
                short = np.where(size < n, (r[end] - r[start]) / n, -np.inf)
                best[full] = np.maximum(np.maximum.reduceat(most, start[full]), short[full])
            out.append(best)
        return np.column_stack(out)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> tuple[tuple, np.ndarray]:
    """Models, as arrays, and curve from at most about ``most`` labelled rows of each class and the shared counts of all of docs."""
    chosen = _fit.sample(spark, labels.select("doc_id", "toxic"), "toxic", _fit.held_out(4, 2), most)
    chosen = chosen.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    fit = slim.join(F.broadcast(chosen.filter(~F.col("calibrates"))), "doc_id", "left").select("text", "y")
    arrays = fitted(counted(fit))
    # Broadcasts hold arrays: executors may lack the classes of this package.
    sent = spark.sparkContext.broadcast(arrays)

    def rate(part, own):
        x = own[0].features([t or "" for t in part.column("text").to_pylist()], own[1])
        return {"y": part.column("y"), "x": list(x)}

    rows = map_slices(slim.join(F.broadcast(chosen.filter("calibrates")), "doc_id").select("text", "y"), rate, "y int, x array<double>", start=lambda: (Models(sent.value), Words())).toPandas()
    return arrays, _fit.logistic(np.array([*rows["x"]], np.float64).reshape(-1, 1 + len(WINDOWS)), rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, arrays: tuple, curve: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; null texts count as empty and get the curve's value without evidence.

    Texts of any length are judged whole. Repeated rows are scored alike; an empty table gives no
    rows; without labels every score is below the threshold; labels, lang, source and columns of any other name are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((arrays, curve))

    def rate(part, own):
        p = _fit.chance(own[0].features([t or "" for t in part.column("text").to_pylist()], own[1]), sent.value[1])
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _fit.held_out(4, 2).alias("held_out"))
    return map_slices(slim, rate, "doc_id bigint, held_out boolean, score double, predicted int", start=lambda: (Models(sent.value[0]), Words()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, *train(spark, docs, labels))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """docs without those that score at least the threshold. Texts decide, so equal texts share a fate.

    A null or empty text has no evidence and stays; texts of any length are judged whole; repeated rows stay or go
    together; all columns of docs stay, whatever their names; an empty table gives no rows.
    """
    arrays, curve = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sent = spark.sparkContext.broadcast((arrays, curve))
    types = docs.schema

    def keep(batches):
        models, words = Models(sent.value[0]), Words()
        for part in slices(batches):
            p = _fit.chance(models.features([t or "" for t in part.column("text").to_pylist()], words), sent.value[1])
            yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(keep, types)
