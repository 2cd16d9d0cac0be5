import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, table
from tessera.operators import metrics, vectors
from tessera.plans import queries
from tessera.plans.queries import QUERIES, SQL
from tessera.sources import readers


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    out = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert table(out) == table(oracle.sql(SQL[name]).df())
    else:
        assert len(out)


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["qid", "doc_id", "score", "rank"] and found.count() > 0
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01"), DATA.replace("0.001", "0.1")])
def test_ann_recall(spark, folder):
    """Recall of the stored index against exact search, for all vectors whose id is divisible by 50."""
    read = lambda name: readers.table(spark, folder, name)
    asked = queries.asked_vectors(read)
    found = vectors.ann(asked, queries.stored_cells(read, spark, folder))
    assert vectors.recall(vectors.knn(asked, read("embeddings")), found).agg({"recall": "avg"}).first()[0] >= 0.9


def test_negative_zero(spark, oracle):
    """A small negative number rounds to the zero that SQL rounds it to."""
    import struct

    rows = spark.createDataFrame([(-4e-7,), (4e-7,), (-0.0,), (-6e-7,)], "x double")
    bits = lambda values: [struct.pack(">d", v) for v in values]
    found = [r[0] for r in rows.select(queries.signed_round(F.col("x"))).collect()]
    assert bits(found) == bits(r[0] for r in oracle.sql("SELECT round(x, 6) FROM (VALUES (1, -4e-7::DOUBLE), (2, 4e-7), (3, -0.0::DOUBLE), (4, -6e-7)) t(i, x) ORDER BY i").fetchall())
    assert str(found[0]) == "-0.0"


def test_judgements_counted(spark, tmp_path):
    """Judgements by label are counted without making pairs, as all pairs would have it, for odd rows too."""
    rng, labels = np.random.default_rng(5), [0, 1, 1, 2, 2, 2, 4, None, 7]
    rows = [(i, rng.normal(size=64).tolist(), labels[i // 25 % len(labels)]) for i in range(400)]
    rows += [(50, rows[7][1], 1), (100, rows[9][1], None), (120, rows[8][1], 2)]  # ids that repeat
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    read = lambda name: readers.table(spark, str(tmp_path), name)
    run, counts = queries.run_and_judged(read)
    made = metrics.per_query(run, counts, asked=queries.asked_all(read))
    assert not re.search("NestedLoop|Cartesian", run.join(counts, "qid")._jdf.queryExecution().executedPlan().toString())
    e = read("embeddings").select("vec_id", "label").collect()
    pairs = [(q.vec_id, c.vec_id, 3.0 if q.label == c.label else 1.0) for q in e for c in e if q.vec_id % 50 == 0 and q.vec_id != c.vec_id and None not in (q.label, c.label) and abs(q.label - c.label) <= 1]
    listed = metrics.per_query(queries.two_runs(read), spark.createDataFrame(pairs, "qid bigint, chunk_id bigint, gain double"), asked=queries.asked_all(read))
    places = lambda df: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()])
    assert places(made) == places(listed) and made.count() > 8
