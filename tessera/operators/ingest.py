"""From files or pages to documents: the source's configuration, cleaning, filters, language, search form and units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

REGISTRY = "source_id string, label string, authority int, unit string, langs array<string>, priority int"


def with_source(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files (file) with source_id: the nearest folder that the registry, which is small, names. A file below none of them is an error when it is read."""
    known = registry.agg(F.collect_set("source_id").alias("_known"))
    folders = F.slice(F.split("file", "/"), 1, F.greatest(F.size(F.split("file", "/")) - 1, F.lit(0)))
    nearest = F.try_element_at(F.filter(folders, lambda x: F.array_contains("_known", x)), F.lit(-1))
    missing = F.raise_error(F.concat(F.lit("no folder of a known source: "), F.col("file"))).cast("string")
    return files.crossJoin(F.broadcast(known)).withColumn("source_id", F.coalesce(nearest, missing)).drop("_known")  # known is one row


def sources(files: DataFrame, registry: DataFrame) -> DataFrame:
    """file and source_id of all files."""
    return with_source(files.select("file").distinct(), registry)


def pages(raw: DataFrame, registry: DataFrame, chosen: list[str] | None = None, priority: int | None = None) -> DataFrame:
    """Pages (file, page, text) ready for chunking: doc_id, file, page, lang, text, text_norm, unit_refs and the source's source_id, source_label, authority and unit.

    Files come from the ``chosen`` sources, or those of at most this ``priority``. Pages that are blank once cleaned and tables of contents go.
    raw may have a source_id already; else it is that of the file's nearest folder.
    """
    if "source_id" not in raw.columns:
        raw = with_source(raw, registry)
    if chosen is not None:
        registry = registry.filter(F.col("source_id").isin([*chosen]))
    if priority is not None:
        registry = registry.filter(F.col("priority") <= priority)
    about = registry.select("source_id", F.col("label").alias("source_label"), "authority", "unit")
    # Files may have few row groups: texts are dealt evenly before the costly steps.
    raw = raw.join(F.broadcast(about), "source_id").repartition(F.xxhash64("file", "page"))
    # Exploding what is kept cleans a text once; a filter would do so again for its condition.
    kept = F.filter(F.array(T.clean(F.col("text"))), lambda t: (t != "") & ~T.is_contents(t))
    text = raw.select(*[c for c in raw.columns if c != "text"], F.explode(kept).alias("text"))
    text = text.withColumn("lang", T.detect_lang(F.col("text")))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return text.select(
        F.concat_ws("::", "source_id", stem).alias("doc_id"), "file", F.col("page").cast("int").alias("page"), "lang", "text", T.normalize_for_search(F.col("text")).alias("text_norm"),
        T.extract_unit_refs(F.col("text"), F.col("unit"), F.col("lang")).alias("unit_refs"), "source_id", "source_label", "authority", "unit",
    )


def documents(pages: DataFrame) -> DataFrame:
    """Pages nested into one row for each document, with its languages in order, and the numbers of its pages and units."""
    own = F.struct("page", "lang", "text", "text_norm", "unit_refs")
    # Pages and units are counted for themselves, so that a reader of the numbers only has no texts collected.
    numbers = [F.count("*").cast("int").alias("n_pages"), F.sum(F.size("unit_refs")).cast("int").alias("n_unit_refs")]
    counted = pages.groupBy("doc_id", "source_id", "source_label", "authority", "unit", "file").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.array_sort(F.collect_list(own)).alias("pages"), *numbers)
    return counted.select("doc_id", "source_id", "source_label", "authority", "unit", "file", "langs", "n_pages", "n_unit_refs", "pages")


def totals(docs: DataFrame) -> DataFrame:
    """One row: documents, pages and units."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return docs.agg(F.count("*").alias("n_docs"), n("n_pages"), n("n_unit_refs"))
