"""Helpers that the operators of this subpackage share.

Executors may lack this package, so everything a Python worker runs is
pickled by value (see ``ship``); no file has to be installed or copied.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more rows than this share of all rows, or than HOT_ROWS, are joined by broadcast.
#: At most MOST_HOT keys can have so many, which bounds the broadcast.
HOT_SHARE, HOT_ROWS, MOST_HOT = 1024, 1_000_000, 200_000
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def ship(module: str) -> None:
    """Let functions of the module reach executors that can't import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """The name, or one made of it that no column has; Spark does not tell cases apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one set here."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        at = "/tmp/checkpoints" if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; its parent goes when the application ends."""
    sc = spark.sparkContext
    top = f"{shared_dir(spark)}/tessera-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later steps survive lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(probe: DataFrame, dim: DataFrame, key: str | list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """probe joined with dim, which has one row for each key and in ``weight`` how many rows of probe have it.

    Keys that hold over 1/HOT_SHARE of the ``total`` rows, or over HOT_ROWS, are fewer than MOST_HOT, so their
    rows of dim are broadcast and hot probe rows stay where they are. All others are
    joined by sort-merge and no partition gets a hot key. Keys must not be null.
    """
    cut = max(1000, min(total // HOT_SHARE, max(HOT_ROWS, total // MOST_HOT)))
    hot, cold = dim.filter(F.col(weight) > cut), dim.filter(F.col(weight) <= cut)
    keys = [key] if isinstance(key, str) else key
    here = probe.join(F.broadcast(hot), keys)
    rest = probe.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how)
    return here.unionByName(rest.select(here.columns))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut to SLICE_ROWS rows and, but for single rows, SLICE_BYTES of text."""
    for batch in batches:
        n, start = batch.num_rows, 0
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        while start < n:
            end, held = start, 0
            while end < n and end - start < SLICE_ROWS and (end == start or held + sizes[end] <= SLICE_BYTES):
                held += sizes[end]
                end += 1
            yield batch.slice(start, end - start)
            start = end


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text", start: Callable | None = None) -> DataFrame:
    """df through f, slice by slice. start(), called once in each task, makes f's second argument."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        state = (start(),) if start else ()
        for part in slices(batches, text):
            out = f(part, *state)
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in types], schema=types)

    return df.mapInArrow(run, schema)
