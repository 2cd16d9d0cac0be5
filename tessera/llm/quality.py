"""Quality by compression: zstandard with dictionaries made from good and from bad labelled text.

Text is compressed in blocks, so that the dictionary counts however long the text is. The
difference of the two compressed sizes over the text's size becomes a score by a logistic
curve fitted on labelled rows that made no dictionary.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _fit
from ._common import map_slices, ship

ship(__name__)
BLOCK, DICTIONARY, LEVEL = 1024, 112_640, 3
#: Labelled rows of each class, about, and bytes of each of them, in blocks spread over the text, that make a dictionary.
MOST_ROWS, MOST_BYTES = 3_000, 4_096


def blocks(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Sizes:
    """The feature of a text: (compressed size with the bad dictionary - with the good one) / size, and both over size."""

    def __init__(self, good: bytes, bad: bytes):
        self.pack = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def feature(self, text: str) -> tuple[float, float]:
        parts = blocks(text)
        if not parts:
            return 0.0, 0.0
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.pack)
        size = sum(map(len, parts)) + 8 * len(parts)
        return (bad - good) / size, (bad - good) / max(1, min(bad, good))

    def features(self, texts: list[str]) -> np.ndarray:
        return np.array([self.feature(t) for t in texts], np.float64).reshape(-1, 2)


def spread(text: str) -> list[bytes]:
    own = blocks(text)
    return own[:: max(1, -(-len(own) * BLOCK // MOST_BYTES))]


def dictionary(parts: list[bytes]) -> bytes:
    """Raw content where there is too little text to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-DICTIONARY:]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> tuple[bytes, bytes, np.ndarray]:
    """Both dictionaries and the curve, from at most about 2 * ``most`` labelled rows of each class: half make dictionaries, half calibrate."""
    chosen = _fit.sample(spark, labels.select("doc_id", "quality"), "quality", _fit.held_out(5, 0), 2 * most)
    chosen = chosen.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == 0)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def cut(part):
        out = [spread(t or "") for t in part.column("text").to_pylist()]
        return {"y": part.column("y"), "parts": out, "doc_id": part.column("doc_id")}

    rows = map_slices(slim.join(F.broadcast(chosen.filter("NOT calibrates")), "doc_id").select("doc_id", "text", "y"), cut, "doc_id bigint, y int, parts array<binary>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    made = []
    for y in (1, 0):
        parts = [bytes(p) for x in rows.loc[rows["y"] == y, "parts"] for p in x]
        made.append(dictionary(parts))
    model = spark.sparkContext.broadcast(tuple(made))

    def rate(part, sizes):
        x = sizes.features([t or "" for t in part.column("text").to_pylist()])
        return {"y": part.column("y"), "a": x[:, 0], "b": x[:, 1]}

    rows = map_slices(slim.join(F.broadcast(chosen.filter("calibrates")), "doc_id").select("text", "y"), rate, "y int, a double, b double", start=lambda: Sizes(*model.value)).toPandas()
    return made[0], made[1], _fit.logistic(rows[["a", "b"]].to_numpy(np.float64).reshape(-1, 2), rows["y"].to_numpy(np.float64), 1e-4)


def score(docs: DataFrame, good: bytes, bad: bytes, curve: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; null texts count as empty, whose size difference is 0.

    Texts of any length are compressed whole. Repeated rows are scored alike; an empty table gives no rows; without labels every
    score is below the threshold; labels, lang, source and columns of any other name are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast((good, bad))

    def rate(part, sizes):
        p = _fit.chance(sizes.features([t or "" for t in part.column("text").to_pylist()]), curve)
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _fit.held_out(5, 0).alias("held_out"))
    return map_slices(slim, rate, "doc_id bigint, held_out boolean, score double, predicted int", start=lambda: Sizes(*model.value))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, *train(spark, docs, labels))
