"""Document fingerprints by MinHash.

Each of K universal hash functions permutes the word shingles of a text; the smallest
values, 16 bits of each, are its fingerprint, and the share of equal places estimates
Jaccard similarity. All texts of a slice are hashed together in numpy. Bands of the same
fingerprints, joined in Spark, bring like texts together, and their links are verified by the
Jaccard similarity of the whole texts' shingles (``similar``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_dedup
from ._common import ship, slices, stored

ship(__name__)
K, SHINGLE = 128, 5


class MinHash:
    """K hash functions (a x + b) mod 2**64, high bits, over 64-bit shingle hashes; words are stretches without ASCII white space."""

    def __init__(self, k: int = K, shingle: int = SHINGLE):
        rng = np.random.default_rng(20240117)
        self.k, self.shingle = k, shingle
        self.a = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, dtype=np.uint64)
        self.known: dict[bytes, int] = {}

    def word_hashes(self, text: str) -> np.ndarray:
        words, known = text.encode("utf-8", "surrogatepass").split(), self.known  # bytes know ASCII white space only
        if len(known) > 300_000:
            known.clear()
        try:
            out = [known[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            out = [known[w] for w in words]
        return np.array(out, np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """A hash of each run of 5 words; of all words if there are fewer; none for a text without words."""
        words = self.word_hashes(text)
        n = min(self.shingle, len(words))
        out = np.zeros(max(0, len(words) - n + 1) if n else 0, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def signatures(self, texts: list[str]) -> np.ndarray:
        """A row of k 32-bit minima for each text; all bits set if it has no words."""
        every = [self.shingles(t) for t in texts]
        size = np.array([len(x) for x in every])
        out = np.full((len(texts), self.k), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(size)
        if len(full):
            x = np.concatenate(every)
            start = np.append(0, np.cumsum(size[full])[:-1])
            for k in range(self.k):
                out[full, k] = np.minimum.reduceat(x * self.a[k] + self.b[k], start) >> np.uint64(32)
        return out


def hexed(signature: np.ndarray) -> str:
    return (signature & 0xFFFF).astype("<u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places; 0 between a text without words and one with words."""
    return float(np.mean((a & 0xFFFF) == (b & 0xFFFF)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]):
        h = MinHash()
        for part in slices(batches):
            rows = [hexed(s) for s in h.signatures([t or "" for t in part.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


class Sets:
    """Fingerprints for the search of near_dedup: plain sets of shingles, so every weight is 1."""

    def __init__(self):
        self.hash = MinHash()

    def signatures(self, texts: list[str]) -> np.ndarray:
        return self.hash.signatures(texts)

    def weighted(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        sets = [np.unique(self.hash.shingles(t)) for t in texts]
        return [(x, np.ones(len(x), np.float32)) for x in sets]


def similar(docs: DataFrame) -> DataFrame:
    """Classes of documents linked by Jaccard similarity 0.8 or more: bands of the fingerprints are joined, links verified on whole texts; rows as of near_dedup.near_duplicates.

    25 bands of 5 of the 128 places miss a pair at similarity 0.8 with a chance of 5 in 100,000.
    """
    return near_dedup.near_duplicates(docs, Sets, K)


EDIT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next document.

    The edited text is the text with its last floor(n/2) code points replaced by the first
    as many (or all) of the next row's, in ascending doc_id, after the last the first. Null
    doc_ids come first; rows that share a doc_id are ordered by a hash of their text, wholly equal ones are
    next to each other. A null text counts as empty, texts of any length are signed whole; a table of one row follows itself, an
    empty one gives no rows. Other columns are not read.

    Texts are dealt once, by range of doc_id and that hash, so one doc_id, or null, may hold any share of the rows. In
    each partition every text is signed once and rows meet their next; what is left are
    the partitions' edges, one text each, joined in a second small step.
    """

    def compare(rows: list[tuple], h: MinHash):
        """rows: (doc_id, sig, text, next sig, next text)."""
        texts = []
        for _, _, text, _, after in rows:
            half = len(text) // 2
            texts.append(text[: len(text) - half] + after[:half])
        new = h.signatures(texts)
        out = []
        for (doc_id, sig, text, next_sig, _), t, s in zip(rows, texts, new, strict=True):
            out.append((doc_id, len(text), hashlib.sha256(t.encode()).hexdigest(), hexed(sig), hexed(s), likeness(sig, s), likeness(sig, next_sig)))
        return out

    names = [x.split()[0] for x in EDIT.split(", ")]

    def batch(out: list[tuple], edges: list[tuple] = ()):
        """out: complete rows; edges: (role, partition, doc_id, sig, packed)."""
        rows = [(*x, None, None, None, None) for x in out] + [(e[2], None, None, None, None, None, None, e[0], e[1], e[3], e[4]) for e in edges]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*names, "role", "part", "sig", "packed"])

    def meet(batches):
        from pyspark import TaskContext

        here, h, held = TaskContext.get().partitionId(), MinHash(), None
        edge = lambda role, row: (role, here, row[0], row[1].tobytes(), zstandard.compress(row[2].encode()))
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            rows = list(zip(part.column("doc_id").to_pylist(), h.signatures(texts), texts, strict=True))
            if held is None:
                yield batch([], [edge("head", rows[0])])
            else:
                rows.insert(0, held)
            held = rows[-1]
            yield batch(compare([(*x, *y[1:]) for x, y in zip(rows, rows[1:])], h) if len(rows) > 1 else [])
        if held is not None:
            yield batch([], [edge("tail", held)])

    def join(batches):
        h = MinHash()
        value = lambda sig, packed: (np.frombuffer(sig, np.uint32), zstandard.decompress(packed).decode() if packed else "")
        for part in batches:
            rows = [(x["doc_id"], *value(x["sig"], x["packed"]), *value(x["next_sig"], x["next_packed"])) for x in part.to_pylist()]
            yield batch(compare(rows, h)).select(names) if rows else batch([]).select(names)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    met = slim.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(meet, f"{EDIT}, role string, part int, sig binary, packed binary")
    met = stored(met, "met")
    edges = met.filter("role IS NOT NULL").select("role", "part", "doc_id", "sig", "packed")
    heads, tails = edges.filter("role = 'head'"), edges.filter("role = 'tail'")
    parts = [r[0] for r in heads.select("part").orderBy("part").collect()]  # one number for each partition
    order = docs.sparkSession.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next_part int")
    pairs = tails.join(order, "part").join(heads.select(F.col("part").alias("next_part"), F.col("sig").alias("next_sig"), F.col("packed").alias("next_packed")), "next_part")
    tail = pairs.select("doc_id", "sig", "packed", "next_sig", "next_packed").mapInArrow(join, EDIT)
    return met.filter("role IS NULL").select(*names).unionByName(tail)


def classes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints' other half over all documents: doc_id, class_id, class_size, kept."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node", "label")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
