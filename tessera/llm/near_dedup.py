"""Near-dedup by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words, weighted by how often a text has them times the mean IDF of
their words. The documents with a word are counted exactly, by 64-bit hash, over all documents. The
IDF is ln(1 + documents / (1 + documents with the word)) and saturates for rare words: a word
in no more documents than the 2**-20th part of all (document, word) pairs counts as if it were
in so many. Fewer than 2**20 words can be in more, so the table that tasks look up is
bounded at any input size, exact, and the same rule holds at every size. The IDF is of words, not of shingles: a text copied a
thousand times would make its own shingles common and its near copies unlike, and counting
shingles takes two shuffles of all of them. Sixty consistent samples make each text's
signature; equal samples are as likely as two texts' weighted Jaccard similarity. Twelve
bands of five samples put like texts into common buckets, and every link that counts is
verified by the weighted Jaccard similarity of the two whole texts.

Exact copies are one node from the start. Buckets are never expanded to pairs: first each
member meets its bucket's representative, another one in each band; then what representatives
did not join is compared in tiles of bounded size that are spread over tasks, by signatures
and, where these look alike and are not joined yet, by the texts. Classes are the components of the verified links, by contraction on the executors.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lookup, map_slices, ship, slices, stored, text_or_empty

ship(__name__)
SHINGLE, SAMPLES, ROWS, SIMILAR = 5, 60, 5, 0.8
#: Bands that meet in the first round; in the second all do.
FIRST_BANDS = 3
#: More words than this can't be in over a 1/FREQUENT of all (document, word) pairs; rarer ones share the largest IDF.
FREQUENT = 1 << 20
#: Share of equal samples from which a pair of a tile is verified: 3.5 standard deviations below SIMILAR.
LOOKS_ALIKE, TILE, FAN = 0.62, 512, 512


def node() -> Column:
    """128 bits that stand for a text."""
    return F.substring(F.unhex(F.sha2(text_or_empty().cast("binary"), 256)), 1, 16)


class Words:
    """Numbers words; ``hash`` holds each number's 64-bit hash."""

    def __init__(self, most: int = 300_000):
        self.most, self.known, self.hash, self.idf = most, {}, np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def numbers(self, split: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words of texts, one after the other."""
        if len(self.known) > self.most:
            self.known, self.hash, self.idf = {}, self.hash[:0], self.idf[:0]
        known = self.known
        if fresh := [w for w in set().union(*split) if w not in known]:
            new = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in fresh), "<u8")
            self.hash = np.concatenate([self.hash, new])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        return np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))


def split_words(text: str | None) -> list[bytes]:
    """Stretches without ASCII white space, in UTF-8; bytes know no other white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_counts(docs: DataFrame) -> DataFrame:
    """key and n: how many rows of docs (text) have a word, by its 64-bit hash. A task counts its rows first and sends each word once, or once for each time its table is full."""

    def run(batches):
        words, sums = Words(1 << 62), np.zeros(0, np.int64)

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(words.hash.view(np.int64)), pa.array(sums)], names=["key", "n"])

        for part in slices(batches):
            once = words.numbers([[*set(split_words(t))] for t in part.column("text").to_pylist()])
            sums = np.pad(sums, (0, len(words.hash) - len(sums))) + np.bincount(once, minlength=len(words.hash))
            if len(sums) > 400_000:
                yield sent()
                words, sums = Words(1 << 62), np.zeros(0, np.int64)
        yield sent()

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def idf_of(total: int, counts: np.ndarray) -> np.ndarray:
    """ln(1 + documents / (1 + documents with the word))."""
    return np.log1p(total / (1.0 + counts)).astype(np.float32)


def idf_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent words of docs and their IDF; one more value at the end is that of all others."""
    counts = stored(word_counts(docs), "counts")
    floor = (counts.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    rows = counts.filter(F.col("n") > floor).toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], idf_of(docs.count(), np.append(rows.column("n").to_numpy()[order], floor))


class Sampler:
    """Weighted shingles and signatures of texts, for an IDF table."""

    def __init__(self, idf: tuple[np.ndarray, np.ndarray]):
        self.table, self.words = idf, Words()
        rng = np.random.default_rng(20240229)
        self.a = rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
        # Quantiles of the gamma distribution with shape 2, 1 - (1 + x) exp(-x), which the method draws r and c from.
        x = np.concatenate([np.linspace(0, 0.05, 20_000, endpoint=False), np.linspace(0.05, 30, 400_000)])
        cdf = -np.expm1(-x) - x * np.exp(-x)
        quantile = lambda bits: np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), cdf, x)
        self.r, self.log_c = quantile(14).astype(np.float32), np.log(quantile(16)).astype(np.float32)

    def idf(self, hashes: np.ndarray) -> np.ndarray:
        """The IDF of words' hashes."""
        keys, values = self.table
        if not len(keys):
            return np.full(len(hashes), values[-1], np.float32)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], values[-1])

    def weighted(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its different shingles' hashes, sorted, and their weights. A text of fewer than five words is one shingle."""
        words = self.words
        split = [split_words(t) for t in texts]
        every = words.numbers(split)
        if len(words.idf) < len(words.hash):
            words.idf = np.append(words.idf, self.idf(words.hash[len(words.idf) :]))
        out, end = [], 0
        for n in map(len, split):
            own, end = every[end : end + n], end + n
            if not n:
                out.append((np.zeros(0, np.uint64), np.zeros(0, np.float32)))
                continue
            k = min(SHINGLE, n)
            h, idf = words.hash[own], words.idf[own]
            x, w = np.zeros(n - k + 1, np.uint64), np.zeros(n - k + 1, np.float32)
            for i in range(k):
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(x)]
                w += idf[i : i + len(x)]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x, first, times = np.unique(x, return_index=True, return_counts=True)
            out.append((x, w[first] * times.astype(np.float32) / np.float32(k)))
        return out

    def signatures(self, texts: list[str]) -> np.ndarray:
        """A row of SAMPLES 32-bit values for each text; equal values mean the same sample. Texts without words have all bits set."""
        sets = self.weighted(texts)
        out = np.full((len(texts), SAMPLES), 0xFFFFFFFF, np.uint32)
        full = [i for i, (x, _) in enumerate(sets) if len(x)]
        at = 0
        while at < len(full):
            upto, held = at, 0
            while upto < len(full) and (upto == at or held + len(sets[full[upto]][0]) <= 1 << 15):
                held += len(sets[full[upto]][0])
                upto += 1
            rows, at = full[at:upto], upto
            x = np.concatenate([sets[i][0] for i in rows])
            log_w = np.log(np.concatenate([sets[i][1] for i in rows]))
            start = np.cumsum([0] + [len(sets[i][0]) for i in rows[:-1]])
            for k in range(SAMPLES):
                z = x * self.a[k] + self.b[k]
                z ^= z >> np.uint64(32)
                z *= np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(29)
                r = self.r[(z >> np.uint64(50)).astype(np.int64)]
                c = self.log_c[((z >> np.uint64(34)) & np.uint64(0xFFFF)).astype(np.int64)]
                b = ((z >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
                # ln a = ln c - ln y - r with ln y = r (t - b) and t = floor(ln S / r + b); the value tells the shingle and t.
                t = np.floor(log_w / r + b)
                out[rows, k] = np.minimum.reduceat(c - r * (t - b + np.float32(1)), start).view(np.uint32)
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of the smaller weights over that of the larger ones; 1 for two texts without words."""
    (x, v), (y, w) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = float(np.minimum(v[i], w[j]).sum(dtype=np.float64))
    every = float(v.sum(dtype=np.float64) + w.sum(dtype=np.float64)) - both
    return both / every if every else 1.0


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row, different from band to band."""
    n = signatures.shape[1] // ROWS
    out = np.tile(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(signatures), 1))
    for i in range(ROWS):
        out = (out ^ signatures[:, i : n * ROWS : ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def components(links: DataFrame, name: str) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes of links (a, b).

    Each round every node takes its smallest neighbour's name, chains are shortened, and links
    between the new names make the next, smaller graph; at least half of its nodes go.
    """
    edges, maps = stored(links.filter("a <> b").select("a", "b").distinct(), name), []
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("to")).filter(F.col("to") < F.col("a")), name)
        short = hook
        for _ in range(2):
            then = short.select(F.col("a").alias("to"), F.col("to").alias("then"))
            short = short.join(then, "to", "left").select("a", F.coalesce("then", "to").alias("to"))
        short = stored(short, name)
        maps.append(short)
        renamed = edges.join(short.select("a", F.col("to").alias("na")), "a", "left").select("b", F.coalesce("na", "a").alias("a"))
        renamed = renamed.join(short.select(F.col("a").alias("b"), F.col("to").alias("nb")), "b", "left").select("a", F.coalesce("nb", "b").alias("b"))
        # Where a chain is still longer, its rest stays a link.
        rest = short.select("to").distinct().join(short.select(F.col("a").alias("to"), F.col("to").alias("b")), "to").select(F.col("to").alias("a"), "b")
        edges = stored(renamed.union(rest).filter("a <> b").distinct(), name)
    out = nodes.withColumn("label", F.col("node"))
    for m in maps:
        out = out.join(m.select(F.col("a").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stored(out, name)


def hooked(links: DataFrame, jumps: int, name: str) -> DataFrame:
    """node and label by a few steps towards small neighbours: enough to see that most linked nodes are joined."""
    own = stored(links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(links.select("b", "a")).groupBy("node").agg(F.min("label").alias("label")).select("node", F.least("node", "label").alias("label")), name)
    for _ in range(jumps):
        then = own.select(F.col("node").alias("label"), F.col("label").alias("then"))
        own = own.join(then, "label", "left").select("node", F.coalesce("then", "label").alias("label"))
    return stored(own, name)


class Finder:
    """The steps of one search; ``classes`` runs them all."""

    def __init__(self, docs: DataFrame, make=None, samples: int = SAMPLES):
        """make: called in tasks, gives an object with signatures() of so many samples and weighted(); else a Sampler for the IDF of docs."""
        self.spark, self.samples, self.bands = docs.sparkSession, samples, samples // ROWS
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", node().alias("node"))
        if make is None:
            idf = self.spark.sparkContext.broadcast(idf_table(self.docs))  # at most FREQUENT words
            make = lambda: Sampler(idf.value)
        self.make = make

        def sign(part, sampler):
            s = sampler.signatures([t or "" for t in part.column("text").to_pylist()])
            # 16 bits of each sample are enough to compare signatures.
            short = ((s * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")
            return {"doc_id": part.column("doc_id"), "node": part.column("node"), "keys": list(bands(s)), "sig": [x.tobytes() for x in short]}

        self.rows = stored(map_slices(self.docs, sign, "doc_id bigint, node binary, keys array<bigint>, sig binary", start=make), "signatures")
        self.nodes = stored(self.rows.groupBy("node").agg(F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "nodes")
        every = self.nodes.select("node", F.posexplode("keys").alias("band", "key"))
        full = stored(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "full")
        self.total = self.nodes.count() * (self.bands)
        self.members = stored(lookup(every, full, "key", "n", self.total).select("key", "band", "node"), "buckets")
        asked = self.members.select("node").distinct()
        self.texts = stored(self.docs.groupBy("node").agg(F.first("text").alias("text")).join(asked, "node", "left_semi"), "texts")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b, fan), those whose texts are similar. fan: over how many copies of b's text its pairs are spread."""
        pairs = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.col("fan")))
        right = pairs.select("b", "fan").distinct().join(self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fan") - 1)))
        held = pairs.join(right, ["b", "fan", "part"]).select("a", "b", "text_b")
        held = held.join(self.texts.select(F.col("node").alias("a"), "text"), "a").select("a", "b", "text", "text_b")
        make = self.make

        def check(batches):
            sampler, known = make(), {}
            for part in slices(batches):
                rows = part.to_pylist()
                good = []
                for r in rows:
                    if r["b"] not in known:
                        if len(known) > 64:
                            known.clear()
                        known[r["b"]] = sampler.weighted([r["text_b"] or ""])[0]
                    if similarity(sampler.weighted([r["text"] or ""])[0], known[r["b"]]) >= SIMILAR:
                        good.append((r["a"], r["b"]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in good], pa.binary()) for k in (0, 1)], names=["a", "b"])

        return stored(held.mapInArrow(check, "a binary, b binary"), name)

    def labelled(self, labels: DataFrame | None, below: int) -> DataFrame:
        """Members of the first bands with their labels so far; a node without links is its own."""
        own = self.members.filter(F.col("band") < below)
        if labels is None:
            return own.withColumn("label", F.col("node"))
        return own.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))

    def meet(self, labels: DataFrame | None, below: int, name: str) -> DataFrame:
        """Links of members with their bucket's representative, where these are not joined yet."""
        own = self.labelled(labels, below)
        if labels is not None:
            own = stored(own, "labelled")
        chosen = F.min(F.struct(F.xxhash64("node", "key").alias("draw"), F.col("node").alias("b"), F.col("label").alias("b_label")))
        heads = own.groupBy("key").agg(chosen.alias("head"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
        met = lookup(own, stored(heads.select("key", "head.b", "head.b_label", "n"), "heads"), "key", "n", self.total)
        pairs = met.filter("label <> b_label").groupBy(F.col("node").alias("a"), "b").agg(F.max("n").alias("n"))
        return self.verified(pairs.select("a", "b", F.ceil(F.col("n") / FAN).alias("fan")), name)

    def compare(self, labels: DataFrame) -> DataFrame:
        """Links of members of one bucket that representatives did not join.

        Of a bucket, members outside its commonest label are compared with each other and
        with all the rest, in tiles of about TILE members, whatever the bucket's size. A tile
        compares signatures first and verifies what looks alike and is not joined yet, so it
        returns fewer links than it has members.
        """
        own = stored(self.labelled(labels, self.bands), "labelled")
        by_label = own.groupBy("key", "label").agg(F.count("*").alias("n"))
        mixed = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).filter("n > top.n")
        mixed = mixed.select("key", F.col("top.label").alias("common"), F.col("n"), F.ceil((F.col("n") - F.col("top.n")) / TILE).alias("odd"), F.ceil(F.col("top.n") / TILE).alias("even"))
        held = lookup(own, stored(mixed, "mixed"), "key", "n", self.total)
        held = held.withColumn("tile", F.when(F.col("label") != F.col("common"), F.pmod(F.xxhash64("node"), F.col("odd"))).otherwise(F.col("odd") + F.pmod(F.xxhash64("node"), F.col("even"))))
        span = lambda a, b: F.when(F.lit(a) <= b, F.sequence(F.lit(a).cast("bigint"), b)).otherwise(F.array().cast("array<bigint>"))
        before = F.transform(span(0, F.least(F.col("tile"), F.col("odd")) - 1), lambda i: F.struct(i.alias("i"), F.col("tile").alias("j")))
        after = F.transform(F.when(F.col("tile") < F.col("odd"), F.sequence(F.col("tile"), F.col("odd") + F.col("even") - 1)).otherwise(F.array().cast("array<bigint>")), lambda j: F.struct(F.col("tile").alias("i"), j.alias("j")))
        held = held.withColumn("at", F.explode(F.concat(before, after))).select("key", "at.i", "at.j", "tile", "node", "label")
        held = held.join(self.nodes.select("node", "sig"), "node").join(self.texts, "node")
        make, made, samples = self.make, [], self.samples

        def alike(key, table):
            if not made:  # once in each task
                made.append(make())
            i, j, sampler, sets = key[1].as_py(), key[2].as_py(), made[0], {}
            tile = np.array(table.column("tile").to_pylist())
            nodes, texts = table.column("node").to_pylist(), table.column("text")
            number: dict[bytes, int] = {}
            group = np.array([number.setdefault(x, len(number)) for x in table.column("label").to_pylist()])
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, samples)
            left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)

            def shingles(x):
                if x not in sets:
                    sets[x] = sampler.weighted([texts[x].as_py() or ""])[0]
                return sets[x]

            links = []
            for x in left.tolist():
                others = right[right > x] if i == j else right
                others = others[group[others] != group[x]]
                if len(others):
                    for y in others[(sig[others] == sig[x]).mean(axis=1) >= LOOKS_ALIKE].tolist():
                        if group[x] != group[y] and similarity(shingles(x), shingles(y)) >= SIMILAR:
                            links.append((nodes[x], nodes[y]))
                            group[group == group[y]] = group[x]
            return pa.table({"a": pa.array([p[0] for p in links], pa.binary()), "b": pa.array([p[1] for p in links], pa.binary())})

        return stored(held.groupBy("key", "i", "j").applyInArrow(alike, "a binary, b binary").distinct(), "links")

    def classes(self) -> DataFrame:
        """node, label (of its class), class_id (its smallest doc_id), class_size (documents) and copies of all nodes."""
        links = self.meet(None, FIRST_BANDS, "links")
        links = links.union(self.meet(hooked(links, 1, "first"), self.bands, "links"))
        links = links.union(self.compare(hooked(links, 3, "second")))
        labels = components(links, "labels")
        own = self.nodes.select("node", "doc_id", "copies").join(labels, "node", "left").select("node", "doc_id", "copies", F.coalesce("label", "node").alias("label"))
        own = stored(own, "own")
        of_label = own.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n"))
        return stored(lookup(own, stored(of_label, "classes"), "label", "n", self.total).select("node", "label", "class_id", "class_size", "copies"), "node_classes")


def near_duplicates(docs: DataFrame, make=None, samples: int = SAMPLES) -> DataFrame:
    """doc_id, node, label, class_id, class_size and kept of each row of docs (doc_id, text).

    Documents are in one class if a chain of links of similarity 0.8 or more joins them. A
    class's id is its smallest doc_id, and documents with this id are kept; null doc_ids come
    last. Classes without ids, or that share one, have the same id; the label tells them apart. A null text counts as empty; texts without words are one class; a text of one to
    four words is one shingle. Equal texts and repeated rows share a class. An empty table
    gives no rows. Other columns are not read.
    """
    finder = Finder(docs, make, samples)
    out = lookup(finder.rows.select("doc_id", "node"), finder.classes(), "node", "copies", finder.total)
    return out.select("doc_id", "node", "label", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node", "label")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: of those with its smallest doc_id, that with the smallest text hash; of rows alike in both, the one whose other columns have the smallest hash.

    All columns of docs stay, whatever their names; an empty table gives no rows; a null text counts as empty.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("least")
    kept = stored(near_duplicates(docs).groupBy("label").agg(least).select("least.doc_id", "least.node"), "kept")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"), node().alias("node"))
    held = packed.join(kept, packed["id"].eqNullSafe(kept["doc_id"]) & (packed["node"] == kept["node"])).select(packed["row"], packed["id"], packed["node"])
    one = held.groupBy("id", "node").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return one.select("row.*")
