"""Dense vectors: norms, similarities, exact and approximate nearest neighbours.

Pair functions are built-in expressions; searches multiply blocks in numpy, keep each
batch's best and merge them by a window, so only k rows of each query and batch move. Queries come in blocks of bounded size, however many they are.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical import rank

#: Queries that go through the corpus together.
BLOCK = 4096
#: Vectors, about, that an index's cells are fitted on; all are indexed.
MOST_SAMPLE = 20_000
#: Scores that a task holds at once, whatever the number of queries and the size of its batches.
TILE = 1 << 20
FOUND = "qid bigint, vec_id bigint, score double"
ROWS = "vec_id bigint, embedding array<float>, cell int"


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def checked(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions")).cast("array<double>")).otherwise(doubles(a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(checked(a, b), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(doubles(v), lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(checked(a, b), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1))


def _blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries (qid, embedding) in blocks of ids and unit vectors; no more than one is held at a time."""
    ids, rows = [], []
    for r in queries.select("qid", "embedding").toLocalIterator():
        ids.append(r["qid"])
        rows.append(r["embedding"])
        if len(ids) == size:
            yield np.array(ids, np.int64), _unit(np.array(rows, np.float64))
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), _unit(np.array(rows, np.float64))


def _best(s: np.ndarray, own: np.ndarray, vec: np.ndarray, k: int, exclude_self: bool) -> pa.RecordBatch:
    """The k best of each row of scores and all that tie with the k-th; the window decides by id."""
    if exclude_self:
        s[own[:, None] == vec[None, :]] = -np.inf
    s = np.round(s, 9)
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(own), -np.inf)
    i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(vec[j]), pa.array(s[i, j])], names=["qid", "vec_id", "score"])


def _tiles(q: np.ndarray, own: np.ndarray, x: np.ndarray, vec: np.ndarray, k: int, exclude_self: bool, metric: str = "cosine") -> Iterator[pa.RecordBatch]:
    """``_best`` of queries against a batch of vectors, so many queries at a time that their scores fill a tile."""
    step = max(1, TILE // max(1, len(x)))
    for at in range(0, len(q), step):
        s = q[at : at + step] @ x.T
        if metric == "euclidean":
            s = -np.sqrt(np.maximum(2 - 2 * s, 0))
        yield _best(s, own[at : at + step], vec, k, exclude_self)


def _merged(parts: list[DataFrame], spark: SparkSession, k: int) -> DataFrame:
    found = parts[0] if parts else spark.createDataFrame([], FOUND)
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumn("rank", rank("score", "vec_id", by=["qid"])).filter(F.col("rank") < k)


def knn(queries: DataFrame, corpus: DataFrame, k: int = 10, allowed: DataFrame | None = None, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """qid, vec_id, score, rank of the k most similar vectors (vec_id, embedding) of each query (qid, embedding), exactly.

    Filters come first, so that k are found where there are k. metric euclidean scores by the negative distance.
    """
    if allowed is not None:
        corpus = corpus.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi")
    spark, parts = corpus.sparkSession, []
    for block in _blocks(queries):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK vectors

        def search(batches, sent=sent):
            own, q = sent.value
            for part in batches:
                if part.num_rows:
                    yield from _tiles(q, own, _matrix(part.column("embedding")), part.column("vec_id").to_numpy(zero_copy_only=False), k, exclude_self, metric)

        parts.append(corpus.select("vec_id", "embedding").mapInArrow(search, FOUND))
    return _merged(parts, spark, k)


def cell_count(n: int) -> int:
    """How many cells so many vectors are put into: the square root of their number, within the fitting sample's means."""
    return int(max(1, min(round(n**0.5), MOST_SAMPLE // 8)))


def cells(vectors: DataFrame, n: int | None = None, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Unit centroids of n cells, else ``cell_count`` of them, by spherical k-means on a bounded sample of about MOST_SAMPLE vectors."""
    count = vectors.count()
    n = n or cell_count(count)
    share = min(1.0, MOST_SAMPLE / max(1, count))
    rows = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share * (1 << 30)).select("vec_id", "embedding").orderBy("vec_id").collect()
    if not rows:
        return np.zeros((1, 1))
    x = _unit(np.array([r["embedding"] for r in rows], np.float64))
    c = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=len(c)) > 0
        c = _unit(np.where(full[:, None], sums, c))
    return c


def assign(vectors: DataFrame, centroids: np.ndarray, copies: int = 2) -> DataFrame:
    """Every vector (vec_id, embedding) with each of its ``copies`` nearest cells, so one near a border is found from both sides."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    copies = min(copies, len(centroids))

    def run(batches):
        for part in batches:
            if part.num_rows:
                s = _matrix(part.column("embedding")) @ sent.value.T
                near = np.argpartition(-s, copies - 1, axis=1)[:, :copies]
                rows = pa.array(np.repeat(np.arange(part.num_rows), copies))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(rows), part.column("embedding").take(rows), pa.array(near.ravel().astype(np.int32))], names=["vec_id", "embedding", "cell"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, ROWS)


class Cells(NamedTuple):
    """An index: rows (vec_id, embedding, cell), the cells' centroids, and how many cells a search looks into."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int = 8


def enough_probes(vectors: DataFrame, rows: DataFrame, centroids: np.ndarray, target: float = 0.95, k: int = 10, asked: int = 256) -> tuple[int, float]:
    """The fewest cells with which about ``asked`` of the vectors find the target share of their k exact neighbours, and that share.

    One exact search of the sample tells it for every effort: a neighbour is found once the first of its cells is probed.
    """
    share = min(1.0, asked / max(1, vectors.count()))
    chosen = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(99)), F.lit(1 << 30)) < share * (1 << 30)).select(F.col("vec_id").alias("qid"), "embedding")
    near = {i: np.argsort(np.argsort(-(x @ centroids.T), kind="stable")) for own, q in _blocks(chosen) for i, x in zip(own.tolist(), q, strict=True)}
    exact = knn(chosen, vectors, k, exclude_self=True).select("qid", "vec_id")
    met = exact.join(rows.select("vec_id", "cell"), "vec_id").collect()  # k neighbours of the sample, in a few cells each
    first: dict[tuple, int] = {}
    for r in met:
        at = int(near[r["qid"]][r["cell"]])
        first[r["qid"], r["vec_id"]] = min(at, first.get((r["qid"], r["vec_id"]), at))
    needed = np.sort(np.array([*first.values()], np.int64))
    if not len(needed):
        return 1, 1.0
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1
    return probes, float((needed < probes).mean())


def write_ann(vectors: DataFrame, path: str, n: int | None = None, copies: int = 2, target: float = 0.95) -> None:
    """The index: vectors in folders by cell, of which a search reads those it probes, the centroids, and how many cells reach the target recall."""
    spark, centroids = vectors.sparkSession, cells(vectors, n)
    placed = assign(vectors, centroids, copies)
    placed.repartition("cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    probes = enough_probes(vectors, spark.read.schema(ROWS).parquet(f"{path}/cells"), centroids, target)
    spark.createDataFrame([probes], "probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")


def read_ann(spark: SparkSession, path: str) -> Cells:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # as many as cells
    return Cells(spark.read.schema(ROWS).parquet(f"{path}/cells"), np.array([r["centroid"] for r in rows], np.float64), spark.read.parquet(f"{path}/probes").first()["probes"])


def ann(queries: DataFrame, index: Cells, k: int = 10, probes: int | None = None, allowed: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    """As knn, but each query looks only into the cells nearest to it; probes, else the index's own number, trades effort for recall.

    Vectors outside ``allowed`` (vec_id) are left out before the best are taken, so a filter never costs results that its cells hold.
    """
    indexed, centroids, probes = index.rows, index.centroids, probes or index.probes
    if allowed is not None:
        indexed = indexed.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi")
    spark, parts = indexed.sparkSession, []
    for own, q in _blocks(queries):
        if centroids.shape == (1, 1):  # of no vectors
            break
        near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes]
        sent = spark.sparkContext.broadcast((own, q, near))  # at most BLOCK vectors

        def search(batches, sent=sent):
            own, q, near = sent.value
            for part in batches:
                vec, cell = part.column("vec_id").to_numpy(zero_copy_only=False), part.column("cell").to_numpy(zero_copy_only=False)
                x = _matrix(part.column("embedding"))
                for c in np.unique(cell):
                    who, here = np.flatnonzero((near == c).any(axis=1)), np.flatnonzero(cell == c)
                    if len(who):
                        yield from _tiles(q[who], own[who], x[here], vec[here], k, exclude_self)

        probed = indexed.filter(F.col("cell").isin(np.unique(near).tolist()))
        parts.append(probed.select("vec_id", "embedding", "cell").mapInArrow(search, FOUND))
    found = parts[0] if parts else spark.createDataFrame([], FOUND)
    for p in parts[1:]:
        found = found.unionByName(p)
    # A vector may be met in each of its cells.
    return _merged([found.dropDuplicates(["qid", "vec_id"])], spark, k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """qid and the share of the exact neighbours that were found."""
    hit = exact.select("qid", "vec_id").join(found.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def latencies(search, queries: DataFrame, most: int = 20) -> DataFrame:
    """Seconds of single searches: one row each of at most ``most`` of the queries, timed on the driver."""
    took = []
    for r in queries.select("qid").orderBy("qid").limit(most).collect():
        began = time.perf_counter()
        search(queries.filter(F.col("qid") == r["qid"])).collect()
        took.append((r["qid"], time.perf_counter() - began))
    return queries.sparkSession.createDataFrame(took, "qid bigint, seconds double")


def recall_curve(queries: DataFrame, vectors: DataFrame, index: Cells, probes=(1, 2, 4, 8), k: int = 10, timed: int = 0) -> DataFrame:
    """probes and mean recall over all queries, one row for each effort; with timed > 0 also the median and 95th percentile of so many searches' seconds, and how much faster than exact search the median is."""
    exact, out = knn(queries, vectors, k), None
    base = latencies(lambda q: knn(q, vectors, k), queries, timed).agg(F.median("seconds").alias("exact_p50")) if timed else None
    for p in probes:
        row = recall(exact, ann(queries, index, k, p)).agg(F.lit(p).alias("probes"), F.avg("recall").alias("recall"))
        if timed:
            took = latencies(lambda q, p=p: ann(q, index, k, p), queries, timed).agg(F.percentile("seconds", 0.5).alias("p50"), F.percentile("seconds", 0.95).alias("p95"))
            row = row.crossJoin(took).crossJoin(base).withColumn("speedup", F.col("exact_p50") / F.col("p50")).drop("exact_p50")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
