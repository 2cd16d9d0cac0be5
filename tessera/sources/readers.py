"""Readers and writers: pages, documents, chunks, question sets, index tables and reports."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIDDEN = ("script", "style", "nav", "footer", "header", "aside")
PAGE = "file string, page int, text string"
CHUNK = "id string, text string, text_norm string, doc_id string, source_id string, authority int, lang string, page int, position int, unit_ref string, n_tokens int, metadata map<string,string>"
QUESTION = (
    "qid string, type string, lang string, question string, expected_answer string, answerable boolean, article int, article_ref string, evidence string, evidence_verified boolean, "
    "absent_terms array<string>, source_expected array<string>, relevant_chunk_ids array<string>, relevant_langs array<string>, lexical_overlap double, trap string, authority_expected string"
)
DOCUMENT = (
    "doc_id string, source_id string, source_label string, authority int, unit string, file string, langs array<string>, n_pages int, n_unit_refs int, "
    "pages array<struct<page:int,lang:string,text:string,text_norm:string,unit_refs:array<struct<ref:string,num:string,start:int>>>>"
)
REPORT = ("type", "configuration", "n_requetes", "pertinents_par_requete", "hit@1", "hit@3", "hit@5", "hit@10", "mrr", "recall@10", "diagnostic")
INDEX = ("chunks", "postings", "terms", "stats")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def detag(html: Column) -> Column:
    """Visible text of HTML by built-in expressions: hidden elements and tags go, white space becomes single spaces."""
    for tag in HIDDEN:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"\s+", " "))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hidden, self.parts, self.rows = 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            (self.rows or self.rows.append([]) or self.rows)[-1].append("")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.rows is not None:
            self.parts.append("\n".join(" | ".join(c.strip() for c in row) for row in self.rows))
            self.rows = None

    def handle_data(self, data):
        if self.hidden:
            return
        if self.rows is None:
            self.parts.append(data)
        elif self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def html_text(html: str) -> str:
    """Visible text with one line for each piece and table rows as cells between bars."""
    reader = _Text()
    reader.feed(html)
    reader.close()
    return "\n".join(reader.parts)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def kind(path: Column) -> Column:
    """Which extractor reads a file; others are skipped."""
    return F.when(suffix(path).isin(".html", ".htm"), "html").when(suffix(path) == ".pdf", "pdf").otherwise("skipped")


def extracted(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """file, page (from 1), text of files (path, content) that an extractor knows by suffix; others are skipped.

    An extractor takes bytes and returns the texts of the pages. HTML is built in; a PDF
    extractor is for the caller to give, since none comes with Spark.
    """
    html = lambda b: [html_text(b.decode("utf-8", "ignore"))]
    known = {".html": html, ".htm": html} | (extractors or {})

    def extract(batches):
        for pdf in batches:
            rows = [(f, k + 1, t) for f, s, b in zip(pdf["path"], pdf["suffix"], pdf["content"], strict=True) for k, t in enumerate(known[s](bytes(b)))]
            yield pd.DataFrame(rows, columns=["file", "page", "text"])

    return files.select("path", suffix(F.col("path")).alias("suffix"), "content").filter(F.col("suffix").isin([*known])).mapInPandas(extract, PAGE)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_pages(spark: SparkSession, root: str, sources: list[str] | None = None, extractors: dict | None = None) -> DataFrame:
    """Pages of the files below root, or below its folders of these sources; a folder that is missing has none."""
    folders = [p for p in ([root] if sources is None else [f"{root}/{x}" for x in sources]) if exists(spark, p)]
    if not folders:
        return spark.createDataFrame([], PAGE)
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders), extractors)


def read_corpus(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Ingested documents, one JSON each; the source is a folder name or in the file."""
    docs = spark.read.schema(DOCUMENT).json(path)
    return docs.filter(F.col("source_id").isin(sources)) if sources else docs


def write_corpus(docs: DataFrame, path: str) -> None:
    """Documents as JSON, in folders by source, which readers of one source prune."""
    docs.write.mode("overwrite").partitionBy("source_id").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select(*[c.split()[0] for c in CHUNK.split(", ")]).write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(QUESTION).json(path).filter(F.col("qid").isNotNull())


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """The retrieval report's columns as CSV with a header; other columns are ignored."""
    report.select(*[F.col(f"`{c}`") for c in REPORT]).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)  # some rows for each configuration


def index_path(root: str, chunker: str, model: str, lang: str | None = None, field: str | None = None) -> str:
    return f"{root}/{chunker}_{model}" + (f"_{lang}" if lang else "") + (f"_emb-{field}" if field else "")


def write_tables(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Index tables as Parquet, postings and terms clustered by term, so that searches read few row groups; returns them as read back."""
    out = {}
    for name, df in tables.items():
        by_term = "term" in df.columns
        (df.repartitionByRange("term").sortWithinPartitions("term") if by_term else df).write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
        tables = tables | {name: out[name]}
    return out


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that an index has."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in INDEX if exists(spark, f"{path}/{name}")}


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """name of the complete indexes below root: those with a meta table, old versions (_v1) last."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    found = [(n,) for n in names if exists(spark, f"{root}/{n}/meta")]
    return spark.createDataFrame(found, "name string").orderBy(F.endswith("name", F.lit("_v1")), "name")


def index_meta(chunks: DataFrame, n_terms: DataFrame | None = None, **given) -> DataFrame:
    """One row about an index: what was given, its sources, its terms, and statistics of its chunks."""
    from ..operators import chunking

    about = chunks.agg(F.array_sort(F.collect_set("source_id")).alias("sources"), F.countDistinct("doc_id").alias("n_docs"))
    out = about.crossJoin(chunking.statistics(chunks))  # one row each
    if n_terms is not None:
        out = out.crossJoin(n_terms.agg(F.count("*").alias("n_terms")))
    return out.select(*[F.lit(v).alias(k) for k, v in given.items()], *out.columns)


def write_checked(golden: DataFrame, failures: DataFrame, path: str) -> int:
    """Writes the question set only if no failure is blocking; returns how many are."""
    n = failures.count()
    if not n:
        golden.write.mode("overwrite").json(path)
    return n


def write_run(ranked: DataFrame, path: str) -> None:
    """A run as JSON: for each configuration and question its chunk ids in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    ranked.groupBy("config", "qid").agg(ids.alias("chunk_ids")).write.mode("overwrite").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """config, qid, chunk_id, rank of a run."""
    rows = spark.read.schema("config string, qid string, chunk_ids array<string>").json(path)
    return rows.select("config", "qid", F.posexplode("chunk_ids").alias("rank", "chunk_id"))
