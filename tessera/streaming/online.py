"""Online statistics of a query log, drift against a question set, and a response cache; each for batch and stream alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import vectors

LATE = "10 minutes"


#: Groups of at most as many rows are sorted by themselves; what a sketch may be off, as a share of a group, and how far from a quantile it is asked.
SMALL, ACCURACY, APART = 10_000, 10_000, 5e-4


def exact_percentiles(rows: DataFrame, by: list[str], column: str, ps: tuple[float, ...]) -> DataFrame:
    """by, n and p (one exact, interpolated percentile each), however hot a group is.

    A large group's percentiles lie between two values that a sketch names, with a thousandth of the rows between
    them: rows below are counted, and only those between are put in order.
    """
    sizes = rows.groupBy(*by).agg(F.count(column).alias("n"))
    sorted_whole = lambda df: df.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(column, p).alias(f"p{k}") for k, p in enumerate(ps)])
    if sizes.filter(F.col("n") > SMALL).isEmpty():
        return sorted_whole(rows)
    few = sorted_whole(rows.join(sizes.filter(F.col("n") <= SMALL), by, "left_semi"))
    large = rows.join(sizes.filter(F.col("n") > SMALL).drop("n"), by, "left_semi")
    around = [x for p in ps for x in (max(0.0, p - APART), min(1.0, p + APART))]
    bounds = large.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(column, F.array(*map(F.lit, around)), ACCURACY).alias("at"))
    held, out = large.join(bounds, by), bounds.select(*by, "n")
    for k, p in enumerate(ps):
        low, high = F.col("at")[2 * k], F.col("at")[2 * k + 1]
        below = held.groupBy(*by).agg(F.count_if(F.col(column) < low).alias("below"))
        inner = held.filter(F.col(column).between(low, high)).groupBy(*by, column).agg(F.count("*").alias("times"))
        upto = F.sum("times").over(Window.partitionBy(*by).orderBy(column))
        place = (F.col("n") - 1) * p
        placed = inner.join(below, by).join(bounds.select(*by, "n"), by).withColumns({"end": F.col("below") + upto, "place": place})
        value = lambda at: F.min(F.when(F.col("end") > at, F.col(column)))
        got = placed.groupBy(*by).agg(value(F.floor("place")).alias("x"), value(F.ceil("place")).alias("y"), (F.first("place") - F.floor(F.first("place"))).alias("part"))
        out = out.join(got.select(*by, (F.col("x") + F.col("part") * (F.col("y") - F.col("x"))).alias(f"p{k}")), by)
    return few.unionByName(out)


def query_stats(log: DataFrame, every: str = "1 hour", exact: bool = True) -> DataFrame:
    """n, p50 and p95 of value for each window and event type. exact: in order, else by a sketch, which streams take."""
    named = log.select(F.window("ts", every)["start"].alias("window_start"), "event_type", "value")
    if exact:
        return exact_percentiles(named, ["window_start", "event_type"], "value", (0.5, 0.95)).withColumnsRenamed({"p0": "p50", "p1": "p95"})
    rows = log.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), *[F.percentile_approx("value", q, 1000).alias(c) for c, q in (("p50", 0.5), ("p95", 0.95))])
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "p50", "p95")


def stream_stats(log: DataFrame, every: str = "1 hour", late: str = LATE) -> DataFrame:
    return query_stats(log.withWatermark("ts", late), every, exact=False)


def service_stats(log: DataFrame, *key: str) -> DataFrame:
    """One row about a query log (ts, value: latency, tokens): requests, latency p50 and p95 by a sketch, the share that a response cache answers, tokens in all.

    A request with the key of an earlier one is answered by the cache and takes no tokens; of each key one request, the first, takes any.
    """
    first = log.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("ts", F.col("tokens").alias("took"))).alias("first"))
    by_key = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), (1 - F.count("*") / F.greatest(F.sum("n"), F.lit(1))).alias("cache_rate"), F.coalesce(F.sum("first.took"), F.lit(0)).alias("tokens"))
    p = log.agg(F.percentile_approx("value", 0.5, 10_000).alias("p50"), F.percentile_approx("value", 0.95, 10_000).alias("p95"))
    return by_key.crossJoin(p)  # one row each


def cache_hits(log: DataFrame, *key: str) -> DataFrame:
    """Requests and hits of a response cache for each event type: a request hits if an earlier one had its key.

    Of each key all but one hit, so counting needs no order and no window.
    """
    return log.groupBy("event_type", *[k for k in key if k != "event_type"]).agg(F.count("*").alias("n")).groupBy("event_type").agg(F.sum("n").alias("requests"), F.sum(F.col("n") - 1).alias("hits"))


def stream_first(log: DataFrame, *key: str, late: str = LATE) -> DataFrame:
    """The requests that a response cache can't answer: the first of each key within the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark([*key])


def drift(recent: DataFrame, golden: DataFrame) -> DataFrame:
    """Mean cosine similarity of recent query vectors to a question set's.

    The mean over all pairs is the dot product of the two mean unit vectors, so no pairs are made.
    """
    unit = lambda df: df.select(F.posexplode(vectors.normalize(F.col("embedding"))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    both = unit(recent).join(unit(golden).withColumnRenamed("x", "y"), "i")
    return both.agg(F.sum(F.col("x") * F.col("y")).alias("drift"))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, below spark.checkpoint.dir where it is set; it goes when the application ends."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_streams"
    path = f"{top}/tessera-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def run_available(stream: DataFrame, mode: str = "append", key: tuple[str, ...] = ()) -> DataFrame:
    """All that a stream has now, written as Parquet with its own checkpoint and read back.

    mode update also has what is still open, windows that the watermark has not passed: of rows with the same key the
    last batch's holds.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    if not key:
        return rows.select(stream.columns)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return last.select("row.*")


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
