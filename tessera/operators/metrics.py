"""Retrieval metrics. A run is rows (config, qid, chunk_id, rank); judgements are rows (qid, chunk_id, gain).

Where gains follow from a rule, most pairs of a question and a chunk may be judged. Then no pairs need be listed: a run
whose rows have their gain (null where not judged) takes judgements that are counted, rows (qid, gain, n).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def asked_of(run: DataFrame, questions: DataFrame) -> DataFrame:
    """Every configuration of a run with every question (qid): what ``asked`` is where all were put to all."""
    return run.select("config").distinct().crossJoin(questions.select("qid").distinct())  # configurations are few


def counted(judged: DataFrame) -> DataFrame:
    """How many judgements of each gain a question has: qid, gain, n."""
    return judged.groupBy("qid", "gain").agg(F.count("*").alias("n"))


def per_query(run: DataFrame, judged: DataFrame, ks: Sequence[int] = KS, by: Sequence[str] = ("config",), asked: DataFrame | None = None) -> DataFrame:
    """Metrics of each configuration and question that has judgements: n_relevant, recall, hit and precision at ks, mrr, ndcg at the largest k.

    asked: the questions put to each configuration (config, qid); one that was answered by nothing counts as a
    failure. Without it those with an answer count. Judgements with gain above 0 are relevant. A run's repeated chunks count once for recall.
    """
    k_most = max(ks)
    # Gains are counted by value first, so that no list of a question's judgements is held. An ideal list needs
    # the k largest gains only; dcg of them is the divisor. A value's places follow from how many gains are larger.
    counts = judged.select("qid", "gain", "n") if "gain" in run.columns else counted(judged)
    larger = Window.partitionBy("qid").orderBy(F.col("gain").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(larger), F.lit(0)))
    places = F.when((F.col("before") < k_most) & F.col("gain").isNotNull(), F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k_most)))).otherwise(F.array().cast("array<bigint>"))
    part = F.aggregate(places, F.lit(0.0), lambda s, i: s + F.col("gain") / F.log2(i + 1))
    relevant = counts.withColumn("part", part).groupBy("qid").agg(F.coalesce(F.sum(F.when(F.col("gain") > 0, F.col("n"))), F.lit(0)).alias("n_relevant"), F.sum("part").alias("ideal"))
    rows = run if "gain" in run.columns else run.join(judged, ["qid", "chunk_id"], "left")
    hit = F.col("gain") > 0
    at = lambda k: F.countDistinct(F.when(hit & (F.col("rank") < k), F.col("chunk_id")))
    found = rows.groupBy(*by, "qid").agg(
        (1.0 / (F.min(F.when(hit, F.col("rank"))) + 1)).alias("mrr"),
        F.sum(F.when(F.col("rank") < k_most, F.col("gain") / F.log2(F.col("rank") + 2))).alias("dcg"),
        *[at(k).alias(f"hits_{k}") for k in ks],
    )
    if asked is not None:
        found = asked.select(*by, "qid").distinct().join(found, [*by, "qid"], "left")
    found = found.join(relevant, "qid").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mrr", "dcg", *[f"hits_{k}" for k in ks])})
    none, n = F.col("n_relevant") == 0, F.col("n_relevant")
    return found.select(
        *by, "qid", "n_relevant",
        *[F.when(none, 1.0).otherwise(F.col(f"hits_{k}") / n).alias(f"recall_{k}") for k in ks],
        *[F.when(none | (F.col(f"hits_{k}") > 0), 1.0).otherwise(0.0).alias(f"hit_{k}") for k in ks],
        *[(F.col(f"hits_{k}") / F.lit(float(k))).alias(f"precision_{k}") for k in ks],
        F.col("mrr").cast("double").alias("mrr"), F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias(f"ndcg_{k_most}"),
    )


def macro(queries: DataFrame, ks: Sequence[int] = KS) -> list[Column]:
    """Averages over questions, as aggregate columns; deviations are of the population."""
    k = max(ks)
    out = [F.count("*").alias("n_queries"), F.avg("n_relevant").alias("relevant_per_query")]
    out += [F.avg(f"{m}_{x}").alias(f"{m}_{x}") for m in ("recall", "hit", "precision") for x in ks]
    return [*out, F.avg("mrr").alias("mrr"), F.avg(f"ndcg_{k}").alias(f"ndcg_{k}"), F.stddev_pop(f"recall_{k}").alias("recall_std"), F.stddev_pop("mrr").alias("mrr_std")]


def diagnosis(hit_most: Column, hit_one: Column) -> Column:
    """Where a configuration fails: relevant chunks are not found, found but ranked low, or neither."""
    return F.when(hit_most < 0.5, "representation").when(hit_most - hit_one > 0.15, "classement").otherwise("sain")


def compare(run: DataFrame, judged: DataFrame, ks: Sequence[int] = KS, asked: DataFrame | None = None) -> DataFrame:
    """One row for each configuration with its averages and diagnosis."""
    out = per_query(run, judged, ks, asked=asked).groupBy("config").agg(*macro(run, ks))
    one = F.col("hit_1") if 1 in ks else F.lit(0.0)
    return out.withColumn("diagnosis", diagnosis(F.col(f"hit_{max(ks)}"), one))


def breakdown(run: DataFrame, judged: DataFrame, questions: DataFrame, column: str, ks: Sequence[int] = KS, all_name: str = "TOUS", asked: DataFrame | None = None) -> DataFrame:
    """Averages of each configuration by a property of questions (qid, column), and over all."""
    rows = per_query(run, judged, ks, asked=asked).join(questions.select("qid", column), "qid")
    out = rows.groupingSets([["config"], ["config", column]], "config", column).agg(*macro(run, ks), F.grouping(column).alias("_all"))
    return out.withColumn(column, F.when(F.col("_all") == 1, all_name).otherwise(F.col(column))).drop("_all")


def report(run: DataFrame, judged: DataFrame, questions: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The retrieval report, with the columns of ``readers.REPORT``, by type of question (qid, type) and over all."""
    rows = breakdown(run, judged, questions, "type", asked=asked)
    named = {"type": "type", "config": "configuration", "n_queries": "n_requetes", "relevant_per_query": "pertinents_par_requete", "mrr": "mrr", "recall_10": "recall@10"}
    named |= {f"hit_{k}": f"hit@{k}" for k in KS}
    return rows.select(*[F.col(a).alias(b) for a, b in named.items()], diagnosis(F.col("hit_10"), F.col("hit_1")).alias("diagnostic"))


def percentages(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the percentage of true values of each boolean column."""
    return rows.agg(*[(100 * F.avg(F.col(c).cast("double"))).alias(c) for c in columns])


def systematic(numbers: DataFrame, column: str, n: int = 20) -> DataFrame:
    """About n different values of a column, evenly spread over their order: every step-th, the first n of these."""
    every = numbers.select(column).filter(F.col(column).isNotNull()).distinct()
    step = max(1, every.count() // n)
    # Places come from sorted partitions and their sizes, so no task sees all values.
    spread = every.repartitionByRange(column).sortWithinPartitions(column).withColumns({"_id": F.monotonically_increasing_id()})
    spread = spread.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # one row for each partition
    placed = spread.join(F.broadcast(before), "_part").withColumn("_place", F.col("_before") + F.col("_at"))
    return placed.filter((F.col("_place") % step == 0) & (F.col("_place") < n * step)).select(column)


def mcnemar(hits: DataFrame) -> DataFrame:
    """Exact two-sided test of two configurations on rows (qid, a, b: hit or not): only_a, only_b, p."""
    n = hits.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    # Binomial terms follow from the one before: choose(n, i) = choose(n, i - 1) (n - i + 1) / i. Large ones are
    # scaled down by a power of two, which loses no digit, as doubles end below 2**1024.
    few, every = F.least("only_a", "only_b"), F.col("only_a") + F.col("only_b")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), F.lit(0.0).alias("scaled"))

    def step(s: Column, i: Column) -> Column:
        by = F.when(s["sum"] > 2.0**500, F.lit(2.0**-500)).otherwise(F.lit(1.0))
        term = s["term"] * by * (every - i + 1) / i
        return F.struct(term.alias("term"), (s["sum"] * by + term).alias("sum"), (s["scaled"] + F.when(by < 1, 500.0).otherwise(0.0)).alias("scaled"))

    terms = F.when(few > 0, F.sequence(F.lit(1).cast("bigint"), few)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, start, step, lambda s: s["sum"] * F.pow(F.lit(2.0), s["scaled"] - every))
    return n.withColumn("p", F.when(every == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))
