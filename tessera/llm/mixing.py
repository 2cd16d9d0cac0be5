"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target of words makes a copy count for its documents, whole copies plus a
fraction. Fractions become whole by pairs: words move at random from one document of the
pair to the other, in proportion so that no expectation changes, until one has a whole
count. Blocks of some thousand documents leave one undecided document each; those meet in
blocks again, level by level, until one for each source is left, which is rounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ship, stored, text_or_empty, unused

ship(__name__)
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, FAN = 4096, 256
UNIT = "source string, unit bigint, block bigint, size bigint, whole bigint, part double, open boolean"


def n_words(text="text"):
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target of each source; sizes has one row for each source (source, source_size).

    Sources by code point, null last, take the weights in turn and share ``share`` of all
    sizes; none gets over ``most`` times its size, what is over is shared again by weight.
    A source stops where its limit over its weight is below the common level, so the level
    follows from running sums in that order: sorted sources, no rounds. The windows see one
    row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumns({"limit": most * F.col("source_size").cast("double"), "ratio": most * F.col("source_size") / F.col("weight")})
    s = s.withColumns(
        {
            "left": share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "shared": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # The first source, in order of ratio, that stays below its limit sets the level.
    s = s.withColumns({"at": F.row_number().over(by), "level": F.col("left") / F.col("shared")})
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("at", "level"))).over(every)["level"]
    return s.select("source", "source_size", F.when(level.isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * level)).alias("target"))


def pivot(pdf: pd.DataFrame, height: int, last: bool) -> pd.DataFrame:
    """Rounds one block of the tree at this height, largest documents first; all but at most one come back decided, with last that one too."""
    pdf = pdf.sort_values(["size", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
    size, part = pdf["size"].to_numpy(np.float64), pdf["part"].to_numpy(np.float64).copy()
    # Chances come from the ids and the height, so reruns agree and heights draw anew.
    x = pdf["unit"].to_numpy(np.int64).view(np.uint64) + np.uint64((height + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    chance = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    size_, part_, a = size.tolist(), part.tolist(), -1
    for b, u in enumerate(chance.tolist()):
        if not 0.0 < part_[b] < 1.0:
            continue
        if a < 0:
            a = b
            continue
        wa, wb, pa, pb = size_[a], size_[b], part_[a], part_[b]
        up, down = min(wa * (1 - pa), wb * pb), min(wa * pa, wb * (1 - pb))
        move = up if u * (up + down) < down else -down
        pa, pb = pa + move / wa, pb - move / wb
        pa, pb = (p if 1e-12 < p < 1 - 1e-12 else float(round(p)) for p in (pa, pb))
        part_[a], part_[b] = pa, pb
        a = a if 0 < pa < 1 else b if 0 < pb < 1 else -1
    if a >= 0 and last:
        part_[a] = float(part_[a] >= 0.5)
    pdf["part"] = part_
    pdf["open"] = [0.0 < p < 1.0 for p in part_]
    pdf["block"] //= FAN
    return pdf


def rounding(height: int, last: bool):
    return lambda pdf: pivot(pdf, height, last)


def unit() -> Column:
    """What is drawn as one: a doc_id's rows; rows without one by their text."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(text_or_empty()))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, unit, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source).

    size is the number of words (null text: 0). Rows that share doc_id and source, or without a doc_id text and source, null
    being a source like others, are one document to the draw and get equal copies; a size of
    0 takes nothing. Texts of any length are counted whole. An empty table gives no rows. Other columns are not read.
    """
    rows = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), unit().alias("unit"), F.col("source").cast("string").alias("source"), n_words().alias("size")), "sizes")
    aim = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    units = rows.groupBy("source", "unit").agg(F.sum("size").alias("size"))
    count = units.groupBy("source").agg(F.count("*").alias("units"))
    aim = stored(aim.join(count, aim["source"].eqNullSafe(count["source"])).drop(count["source"]), "aim")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = units.join(aim.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    level = aimed.select(
        "source", "unit",
        F.pmod(F.xxhash64("unit"), F.ceil(F.col("units") / BLOCK)).alias("block"),
        "size", F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("part"), F.lit(True).alias("open"),
    )
    most_blocks = -(-(aim.agg(F.max("units")).first()[0] or 0) // BLOCK)
    decided, height = [], 0
    while True:
        last = most_blocks <= 1
        todo = level.filter((F.col("size") > 0) & (F.col("part") > 0))
        decided.append(level.filter((F.col("size") == 0) | (F.col("part") == 0)))
        done = stored(todo.groupBy("source", "block").applyInPandas(rounding(height, last), UNIT), "pivot")
        decided.append(done.filter(~F.col("open")))
        if last:
            break
        level, most_blocks, height = done.filter("open"), -(-most_blocks // FAN), height + 1
    rounded = decided[0]
    for d in decided[1:]:
        rounded = rounded.unionByName(d)
    rounded = rounded.select(F.col("source").alias("r_source"), F.col("unit").alias("r_unit"), F.when(F.col("size") > 0, F.col("whole") + F.col("part").cast("bigint")).otherwise(0).alias("copies"))
    out = rows.join(rounded, (rows["unit"] == F.col("r_unit")) & rows["source"].eqNullSafe(F.col("r_source")))
    out = out.join(aim.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "unit", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row as often as the mix takes it; rows of one document that repeat count alike.

    All columns of docs stay, whatever their names; null, empty and repeated rows are as in ``mix``.
    """
    of_unit, of_source, times, copy = (unused(x, docs.columns) for x in ("of_unit", "of_source", "times", "copy"))
    copies = mix(docs).groupBy("unit", "source").agg(F.max("copies").alias("copies")).filter("copies > 0")
    took = copies.select(F.col("unit").alias(of_unit), F.col("source").alias(of_source), F.col("copies").alias(times))
    joined = docs.join(took, (unit() == F.col(of_unit)) & F.col("source").cast("string").eqNullSafe(F.col(of_source)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(of_unit, of_source, times, copy)
