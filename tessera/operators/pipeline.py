"""Indexes and searches end to end: build an index from documents, ask it, and compare configurations.

An index is a folder of tables: chunks, postings, terms, stats, vectors by cell with their centroids, and meta.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from . import chunking, embedding, fusion, generation, lexical, metrics, vectors

RETRIEVALS = ("vector", "bm25", "hybrid")


class Index(NamedTuple):
    """Opened tables. vectors: rows (vec_id, embedding, id of the chunk); ann: the same by cell."""

    chunks: DataFrame
    tables: dict[str, DataFrame]
    vectors: DataFrame
    ann: vectors.Cells
    meta: DataFrame


def build(docs: DataFrame, path: str, chunker: str = "structural", model: str = "hashing", lang: str | None = None, field: str = "text", encode=None, cache: str | None = None, n_cells: int | None = None, **options) -> Index:
    """Chunks documents, embeds one of their fields, indexes both ways and writes everything below path; returns it opened.

    field: text or text_norm, what is embedded; BM25 always takes text_norm. lang keeps one language's chunks.
    Each step reads what the step before has written, so a lost executor costs no finished step.
    """
    spark, began = docs.sparkSession, time.time()
    chunks = chunking.STRATEGIES[chunker](docs, **options)
    if lang:
        chunks = chunks.filter(F.col("lang") == lang)
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    numbered = chunks.select(F.xxhash64("id").alias("vec_id"), "id", F.col(field).alias("text"))
    embedded = embedding.embed(numbered.select("id", "text"), cache or f"{path}/cache", model, "document", encode)
    embedded.select(F.xxhash64("id").alias("vec_id"), "id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    vectors.write_ann(stored, f"{path}/ann", n_cells)
    # Texts of chunks are in normal form already.
    lexical.write(chunks, path, "text_norm", "id", normalize=False)
    terms = spark.read.parquet(f"{path}/terms")
    dim = stored.select(F.size("embedding").alias("dim")).limit(1).collect()
    meta = readers.index_meta(chunks, terms, chunker=chunker, model=model, lang=lang, embed_field=field, dim=dim[0]["dim"] if dim else 0, seconds=round(time.time() - began, 1))
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/chunks"), readers.read_index(spark, path), spark.read.parquet(f"{path}/vectors"), vectors.read_ann(spark, f"{path}/ann"), spark.read.parquet(f"{path}/meta"))


def retrieve(index: Index, questions: DataFrame, method: str = "rrf", pool: int = 30, allowed: DataFrame | None = None, weights: Sequence[float] | None = None, model: str = "hashing", encode=None, probes: int | None = None, exact: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, score, rank of the ``pool`` best chunks of each question (qid bigint, question) by rrf, weighted, vector or bm25.

    Both engines are asked for twice the pool. allowed: ids of chunks that may be found, for both engines. probes: as of ``vectors.ann``; exact searches all vectors.
    asked: the questions' vectors (qid, embedding), where they are known.
    """
    lexical_found = dense = None
    if method != "vector":
        lexical_found = lexical.search(index.tables, questions, 2 * pool, allowed, key="id").withColumnRenamed("id", "chunk_id")
    if method != "bm25":
        start = embedding.prefix(model, "query")
        run = encode or embedding.hashing(embedding.MODELS[model]["dim"])
        asked = asked if asked is not None else questions.select("qid", run(F.concat(F.lit(start), F.col("question"))).alias("embedding"))
        may = None if allowed is None else index.vectors.join(allowed, "id", "left_semi").select("vec_id")
        found = vectors.knn(asked, index.vectors, 2 * pool, may) if exact else vectors.ann(asked, index.ann, 2 * pool, probes, may)
        dense = found.join(index.vectors.select("vec_id", F.col("id").alias("chunk_id")), "vec_id").select("qid", "chunk_id", "score", "rank")
    if method in ("vector", "bm25"):
        one = dense if method == "vector" else lexical_found
        return one.filter(F.col("rank") < pool).select("qid", "chunk_id", "score", "rank")
    return fusion.hybrid(dense, lexical_found, method, pool, weights)


def candidates(index: Index, questions: DataFrame, found: DataFrame) -> DataFrame:
    return found.join(index.chunks.select(F.col("id").alias("chunk_id"), "text", "source_id", "unit_ref", "lang"), "chunk_id").join(questions.select("qid", "question"), "qid")


class Answered(NamedTuple):
    """rows: qid, question, answer, refused, citations, prompt; sources: what was cited from; latency_ms by stage; degraded: the reranker failed."""

    rows: DataFrame
    sources: DataFrame
    latency_ms: dict[str, float]
    degraded: bool


def answer(index: Index, questions: DataFrame, folder: str, method: str = "rrf", use_rerank: bool = True, pool: int = 30, top: int = 5, scorer=fusion.overlap_score, complete=generation.extract, **options) -> Answered:
    """The whole chain: retrieve, rerank, generate, check citations. Each stage is written below folder, read by the next and timed.

    If the reranker fails, the fused order answers, in degraded mode.
    """
    spark, took, degraded = questions.sparkSession, {}, False

    def stage(name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        took[name] = (time.perf_counter() - began) * 1000
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    found = stage("retrieve", candidates(index, questions, retrieve(index, questions, method, pool, **options)))
    best = found.select("qid", "chunk_id", "score", "rank")
    if use_rerank:
        try:
            best = stage("rerank", fusion.rerank(found, top, scorer))
        except Exception:  # whatever a model's server does
            degraded = True
    sources = best.filter(F.col("rank") < top).join(found.select("qid", "chunk_id", "text", "source_id", "unit_ref", "lang"), ["qid", "chunk_id"])
    rows = stage("generate", generation.generate(questions, sources, complete))
    return Answered(rows, sources, took, degraded)


def grid(docs: DataFrame, questions: DataFrame, judge: Callable[[Index], DataFrame], folder: str, chunkers: Sequence[str] = ("fixed", "sentence", "structural"), retrievals: Sequence[str] = RETRIEVALS, reranking: Sequence[bool] = (False, True), pool: int = 10, options: dict | None = None) -> DataFrame:
    """The master table: metrics of every combination of chunker, retrieval and reranking, with its columns chunker, retrieval and rerank.

    judge: judgements (qid, chunk_id, gain) for an index, since chunk ids depend on the chunker. options: of each chunker, by name.
    """
    out = None
    for chunker in chunkers:
        index = build(docs, f"{folder}/{chunker}", chunker, **(options or {}).get(chunker, {}))
        judged, runs = judge(index), None
        for retrieval, rerank in itertools.product(retrievals, reranking):
            found = retrieve(index, questions, "rrf" if retrieval == "hybrid" else retrieval, pool)
            if rerank:
                found = fusion.rerank(candidates(index, questions, found), pool)
            run = found.select(F.lit(f"{chunker}/{retrieval}/{'rerank' if rerank else 'plain'}").alias("config"), "qid", "chunk_id", "rank")
            runs = run if runs is None else runs.unionByName(run)
        runs.write.mode("overwrite").parquet(f"{folder}/{chunker}/runs")
        runs = questions.sparkSession.read.parquet(f"{folder}/{chunker}/runs")
        every = [f"{chunker}/{r}/{'rerank' if k else 'plain'}" for r, k in itertools.product(retrievals, reranking)]
        asked = questions.select("qid", F.explode(F.array(*map(F.lit, every))).alias("config"))
        table = metrics.compare(runs, judged, asked=asked)
        out = table if out is None else out.unionByName(table)
    parts = F.split("config", "/")
    return out.select(parts[0].alias("chunker"), parts[1].alias("retrieval"), (parts[2] == "rerank").alias("rerank"), *[c for c in out.columns if c != "config"])


def precision_latency_curve(index: Index, questions: DataFrame, judged: DataFrame, folder: str, pools: Sequence[int] = (10, 30, 100), k: int = 5, scorer=fusion.overlap_score) -> DataFrame:
    """pool, precision at k after reranking that many candidates, and the seconds that all questions took."""
    spark, out = questions.sparkSession, []
    for pool in pools:
        began = time.perf_counter()
        run = fusion.rerank(candidates(index, questions, retrieve(index, questions, "rrf", pool)), k, scorer).withColumn("config", F.lit(str(pool)))
        run.write.mode("overwrite").parquet(f"{folder}/pool={pool}")
        seconds = time.perf_counter() - began
        stored = spark.read.schema(run.schema).parquet(f"{folder}/pool={pool}")
        row = metrics.per_query(stored, judged, (k,), asked=metrics.asked_of(stored, questions)).agg(F.avg(f"precision_{k}").alias("p")).first()
        out.append((pool, row["p"], seconds))
    return spark.createDataFrame(out, f"pool int, precision_{k} double, seconds double")


def benchmark_models(texts: DataFrame, questions: DataFrame, judged: DataFrame, models: dict[str, Callable], folder: str, k: int = 5) -> DataFrame:
    """One row for each model (name: its column function) over texts (id bigint, text) and questions (qid, question, lang): recall at k, also of questions by language, seconds of embedding and searching, and dimensions."""
    spark, out = texts.sparkSession, []
    for name, encode in models.items():
        began = time.perf_counter()
        texts.select(F.col("id").alias("vec_id"), encode(F.col("text")).alias("embedding")).write.mode("overwrite").parquet(f"{folder}/{name}")
        corpus, embedded = spark.read.parquet(f"{folder}/{name}"), time.perf_counter() - began
        began = time.perf_counter()
        found = vectors.knn(questions.select("qid", encode(F.col("question")).alias("embedding")), corpus, k)
        found.write.mode("overwrite").parquet(f"{folder}/{name}_found")
        searched = time.perf_counter() - began
        run = spark.read.parquet(f"{folder}/{name}_found").select(F.lit(name).alias("config"), "qid", F.col("vec_id").alias("chunk_id"), "rank")
        rows = metrics.per_query(run, judged, (k,), asked=metrics.asked_of(run, questions)).join(questions.select("qid", "lang"), "qid")
        by_lang = {r["lang"]: r["r"] for r in rows.groupBy("lang").agg(F.avg(f"recall_{k}").alias("r")).collect()}
        dim = corpus.select(F.size("embedding").alias("dim")).first()
        out.append((name, rows.agg(F.avg(f"recall_{k}")).first()[0], by_lang, embedded, searched, dim["dim"] if dim else 0))
    return spark.createDataFrame(out, f"model string, recall_{k} double, by_lang map<string,double>, embed_seconds double, search_seconds double, dim int")


def by_number(index: Index, n: int = 20, model: str = "hashing", encode=None) -> DataFrame:
    """The demonstration of lexical against dense search on "article N": num, and whether each engine's best and best five have that article's chunk.

    Numbers are an even sample of those of French articles.
    """
    number = F.regexp_extract("unit_ref", r"^article (\d+)$", 1)
    articles = index.chunks.filter((F.col("lang") == "fr") & F.col("unit_ref").rlike(r"^article \d+$")).select(number.cast("bigint").alias("qid"))
    questions = metrics.systematic(articles, "qid", n).withColumn("question", F.concat(F.lit("article "), F.col("qid").cast("string")))
    units = index.chunks.select(F.col("id").alias("chunk_id"), "unit_ref")
    out = questions.select(F.col("qid").alias("num"))
    for name, method in (("vector", "vector"), ("bm25", "bm25")):
        found = retrieve(index, questions, method, 5, model=model, encode=encode, exact=True).join(units, "chunk_id")
        right = F.col("unit_ref") == F.concat(F.lit("article "), F.col("qid").cast("string"))
        hit = found.groupBy(F.col("qid").alias("num")).agg(F.bool_or(right & (F.col("rank") < 1)).alias(f"{name}_top1"), F.bool_or(right).alias(f"{name}_top5"))
        out = out.join(hit, "num", "left")
    return out.select("num", *[F.coalesce(c, F.lit(False)).alias(c) for c in out.columns if c != "num"])


def figures(curve: DataFrame, by_type: DataFrame, pools: DataFrame) -> dict[str, DataFrame]:
    """The frames of the three figures: recall against latency, hits by type of question and configuration, precision against latency."""
    return {
        "recall_vs_latency": curve.select("probes", "recall", "p50").orderBy("probes"),
        "hybrid_comparison": by_type.groupBy("type").pivot("configuration").agg(F.first("hit@5")).orderBy("type"),
        "precision_vs_latency": pools.orderBy("pool"),
    }
