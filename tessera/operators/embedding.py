"""Texts to vectors through a cache, with a prefix for each role and any model."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import text as T
from ..sources.readers import exists

# Models with their dimensions and the prefixes of queries and documents.
MODELS = {
    "bge-m3": {"name": "BAAI/bge-m3", "dim": 1024, "query": "", "document": ""},
    "e5-base": {"name": "intfloat/multilingual-e5-base", "dim": 768, "query": "query: ", "document": "passage: "},
    "paraphrase": {"name": "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", "dim": 384, "query": "", "document": ""},
}
#: The stand-in where no model is on disk.
MODELS["hashing"] = {"name": "signed hashing of words", "dim": 64, "query": "", "document": ""}
CACHE = "key string, embedding array<float>"


def hashing(dim: int = 64, batch: int = 32):
    """The model that needs no weights: signed word counts by hash, as unit vectors, in batches."""

    def encode(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), dim), np.float64)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                x[i, h % dim] += 1.0 if h >> 63 else -1.0
        return x

    return udf_of(encode, batch)


def udf_of(encode, batch: int = 32):
    """A column function of a model: encode takes a list of texts and returns a matrix; vectors are normalised."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(text: pd.Series) -> pd.Series:
        texts, out = text.fillna("").tolist(), []
        for i in range(0, len(texts), batch):
            x = np.asarray(encode(texts[i : i + batch]), np.float64)
            out += list((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32))
        return pd.Series(out, dtype=object)

    return run


def prefix(model: str, role: str) -> str:
    if model not in MODELS:
        raise ValueError(f"no model {model}; there are {', '.join(MODELS)}")
    return MODELS[model][role]


def cache(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that a cache folder has, one row for each key."""
    rows = spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)
    return rows.dropDuplicates(["key"])


def embed(texts: DataFrame, path: str, model: str = "hashing", role: str = "document", encode=None, key: str = "id") -> DataFrame:
    """key and embedding of texts (key, text): what the cache at path lacks is computed, once for each different text, and appended to it.

    encode: a column function of the model, else the hashing stand-in. A retry computes again only what was not appended.
    """
    spark = texts.sparkSession
    start = prefix(model, role)
    encode = encode or hashing(MODELS[model]["dim"])
    keyed = texts.select(key, F.concat(F.lit(start), F.coalesce("text", F.lit(""))).alias("full"), T.cache_key(start, F.coalesce("text", F.lit(""))).alias("key"))
    missing = keyed.select("key", "full").join(cache(spark, path).select("key"), "key", "left_anti").dropDuplicates(["key"])
    missing.select("key", encode(F.col("full")).alias("embedding")).write.mode("append").parquet(path)
    return keyed.select(key, "key").join(cache(spark, path), "key").select(key, "embedding")
