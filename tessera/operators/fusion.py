"""Fusion of ranked lists, quotas, conflict resolution and reranking.

A ranked list is rows (qid, list_id, chunk_id, score, rank), rank from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .lexical import rank


def weight(weights: Sequence[float] | None, n: int) -> Column:
    """Of each list, by its number; all 1 if none are given."""
    if not weights:
        return F.lit(1.0)
    if len(weights) != n:
        raise ValueError(f"{n} lists need {n} weights, not {len(weights)}")
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("list_id") + 1).cast("int"))


def fused(lists: DataFrame, part: Column, top: int) -> DataFrame:
    """Sums of part over lists; ties go to what comes first in the lists."""
    place = F.min(F.struct("list_id", F.col("rank").alias("at")))
    found = lists.groupBy("qid", "chunk_id").agg(F.sum(part).alias("score"), place.alias("place"))
    by = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "place.list_id", "place.at", "chunk_id")
    return found.withColumn("rank", F.row_number().over(by) - 1).filter(F.col("rank") < top).select("qid", "chunk_id", "score", "rank")


def rrf(lists: DataFrame, n_lists: int, k: int = fixed.RRF_K, top: int = 30, weights: Sequence[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion. A list of weight 0 still brings in its members."""
    return fused(lists, weight(weights, n_lists) / (k + F.col("rank") + 1), top)


def min_max(lists: DataFrame) -> DataFrame:
    """Scores of each list from 0 to 1; 1 where all are equal."""
    own = Window.partitionBy("qid", "list_id")
    low, spread = F.min("score").over(own), F.max("score").over(own) - F.min("score").over(own)
    return lists.withColumn("score", F.when(spread < 1e-12, 1.0).otherwise((F.col("score") - low) / spread))


def weighted(lists: DataFrame, n_lists: int, weights: Sequence[float], top: int = 30) -> DataFrame:
    """Weighted sum of scores brought to one scale."""
    return fused(min_max(lists), weight(weights, n_lists) * F.col("score"), top)


def stack(*lists: DataFrame) -> DataFrame:
    out = None
    for k, one in enumerate(lists):
        own = one.select("qid", F.lit(k).alias("list_id"), "chunk_id", "score", "rank")
        out = own if out is None else out.unionByName(own)
    return out


def hybrid(dense: DataFrame, lexical: DataFrame, method: str = "rrf", top: int = 30, weights: Sequence[float] | None = None) -> DataFrame:
    """One of rrf, weighted, vector, bm25; an engine that the method does not use is never run."""
    if method == "rrf":
        return rrf(stack(dense, lexical), 2, top=top, weights=weights)
    if method == "weighted":
        return weighted(stack(dense, lexical), 2, weights or (0.5, 0.5), top)
    if method in ("vector", "bm25"):
        return (dense if method == "vector" else lexical).filter(F.col("rank") < top).select("qid", "chunk_id", "score", "rank")
    raise ValueError(f"no method {method}")


def balanced(ranked: DataFrame, group: str, total: int = 30, least: int = 2) -> DataFrame:
    """The best ``total`` chunks with at least ``least`` of each group, groups in order of their best; what is left is filled by rank.

    Rows: qid, chunk_id, score, rank and the group's column. A chunk in several groups counts once.
    """
    own = Window.partitionBy("qid", group).orderBy("rank", "chunk_id")
    rows = ranked.withColumns({"pos": F.row_number().over(own), "order": F.min("rank").over(Window.partitionBy("qid", group))})
    quota = F.col("pos") <= least
    key = F.struct(
        F.when(quota, 0).otherwise(1).alias("step"), F.when(quota, F.col("order")).otherwise(F.col("rank")).alias("first"),
        F.when(quota, F.col("pos")).otherwise(F.col("order")).alias("second"), F.when(quota, 0).otherwise(F.col("pos")).alias("third"),
    )
    best = rows.groupBy("qid", "chunk_id").agg(F.min(F.struct(key.alias("key"), "score", F.col(group).alias("of"))).alias("x"))
    by = Window.partitionBy("qid").orderBy("x.key", "chunk_id")
    return best.withColumn("place", F.row_number().over(by) - 1).filter(F.col("place") < total).select("qid", "chunk_id", F.col("x.score").alias("score"), F.col("x.of").alias(group), F.col("place").alias("rank"))


def resolve(passages: DataFrame, topic: str, authority: str, published: str, key: str) -> DataFrame:
    """Of each topic the passage that holds: most authority, then latest, then smallest key; how many give way, and whether they conflict.

    Partial maxima are merged, so no topic is sorted whole. ``set_aside`` has those that give way.
    """
    best = F.max(F.struct(F.col(authority).alias("authority"), F.col(published).alias("published"), (-F.col(key)).alias("back"), F.col(key).alias("kept")))
    found = passages.groupBy(topic).agg(best.alias("best"), F.count("*").alias("n"), F.min(authority).alias("low"), F.max(authority).alias("high"))
    return found.select(topic, F.col("best.kept").alias("kept"), (F.col("n") - 1).alias("n_set_aside"), (F.col("low") < F.col("high")).alias("conflict"))


def set_aside(passages: DataFrame, topic: str, authority: str, published: str, key: str) -> DataFrame:
    """The passages that give way, all their columns, with ``kept``, the key of the one that holds instead of them."""
    held = resolve(passages, topic, authority, published, key).select(topic, "kept")
    return passages.join(held, topic).filter(F.col(key) != F.col("kept"))


def metadata(chunks: DataFrame, sources=None, langs=None, min_authority=None, after=None) -> DataFrame:
    """Chunks that a search may use. Conditions are on columns, so they reach the scan."""
    for name, values in (("source_id", sources), ("lang", langs)):
        if values is not None:
            chunks = chunks.filter(F.col(name).isin([*values]))
    if min_authority is not None:
        chunks = chunks.filter(F.col("authority") >= min_authority)
    return chunks if after is None else chunks.filter(F.col("published") > F.lit(after))


def overlap_score(question: Column, passage: Column) -> Column:
    """Share of a question's content words that a passage has: the scorer used where no model is given."""
    asked = text.content_words(question)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, text.content_words(passage))) / F.size(asked)).otherwise(0.0)


def rerank(candidates: DataFrame, top: int = 5, scorer=overlap_score) -> DataFrame:
    """The best by a second scorer, a function of two columns or a pandas UDF, of candidates (qid, chunk_id, question, text) only."""
    scored = candidates.select("qid", "chunk_id", scorer(F.col("question"), F.col("text")).alias("score"))
    return scored.withColumn("rank", rank("score", "chunk_id", by=["qid"])).filter(F.col("rank") < top)
