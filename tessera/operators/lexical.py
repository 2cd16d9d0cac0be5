"""Lexical search: an inverted index as tables, inverse document frequencies and BM25.

Index tables: ``postings`` (term, key, tf, len: the tokens of the document), ``terms`` (term, df) and
``stats`` (one row: n_docs, avgdl). A search joins the query's terms with postings, which have
all it needs of a document, so it reads no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources import readers


def rank(score: Column | str, *ties: str, by: list[str]) -> Column:
    """0-based place by falling score, rounded so that sums in any order agree, then by ties."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), *ties)) - 1


def tokens(docs: DataFrame, column: str = "text", key: str = "doc_id", normalize: bool = True) -> DataFrame:
    return docs.select(key, text.tokenize(F.col(column), normalize).alias("tokens"))


def terms_of(docs: DataFrame, column: str = "text", key: str = "doc_id", normalize: bool = True) -> DataFrame:
    """key and term, one row for each token. Stop-words go by a set lookup in generated code after the texts are taken apart."""
    words = docs.select(key, F.explode(text.words_of(F.col(column), normalize)).alias("word"))
    return words.select(key, F.lower("word").alias("term")).filter(~F.col("term").isin(fixed.STOPWORDS))


def postings(docs: DataFrame, column: str = "text", key: str = "doc_id", normalize: bool = True) -> DataFrame:
    """term, key, tf and len. Texts are dealt by document once; counting terms and the document's length then needs no shuffle of tokens."""
    searched = docs.select(key, (text.searchable(F.col(column)) if normalize else F.col(column)).alias("text")).repartition(key)
    counted = terms_of(searched, "text", key, normalize=False).groupBy(key, "term").agg(F.count("*").alias("tf"))
    return counted.withColumn("len", F.sum("tf").over(Window.partitionBy(key))).select("term", key, "tf", "len")


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def statistics(posted: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_docs and avgdl over all documents, empty ones too."""
    n = docs.agg(F.count("*").alias("n_docs"))
    return n.crossJoin(posted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))).select("n_docs", (F.col("n_tokens") / F.greatest("n_docs", F.lit(1))).alias("avgdl"))  # one row each


def idf(terms: DataFrame, stats: DataFrame, variant: str = "lucene") -> DataFrame:
    """term, df, idf of terms (term, df); variant robertson may be negative."""
    if variant not in ("lucene", "robertson"):
        raise ValueError(f"no variant {variant}")
    n, df = F.col("n_docs"), F.col("df")
    odds = (n - df + 0.5) / (df + 0.5)
    return terms.crossJoin(F.broadcast(stats)).select("term", "df", F.log(odds + 1 if variant == "lucene" else odds).alias("idf"))  # stats is one row


def index(docs: DataFrame, column: str = "text", key: str = "doc_id", normalize: bool = True) -> dict[str, DataFrame]:
    """The index tables of documents, unwritten; ``readers.write_tables`` stores them."""
    posted = postings(docs, column, key, normalize)
    return {"postings": posted, "terms": document_frequencies(posted), "stats": statistics(posted, docs, key)}


def write(docs: DataFrame, path: str, column: str = "text", key: str = "doc_id", normalize: bool = True) -> dict[str, DataFrame]:
    """The index of documents, written; terms and statistics come from the postings as stored, so texts are dealt and taken apart once."""
    posted = readers.write_tables({"postings": postings(docs, column, key, normalize)}, path)
    return posted | readers.write_tables({"terms": document_frequencies(posted["postings"]), "stats": statistics(posted["postings"], docs, key)}, path)


def search(tables: dict[str, DataFrame], queries: DataFrame, k: int = 10, allowed: DataFrame | None = None, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, variant: str = "lucene", key: str = "doc_id", normalize: bool = True) -> DataFrame:
    """qid, key, score, rank of the k best documents of an index for each query (qid, question).

    A token that a query repeats counts each time; documents outside ``allowed`` (key) are left
    out before the best are taken, but count in the statistics.
    """
    asked = terms_of(queries, "question", "qid", normalize).groupBy("qid", "term").agg(F.count("*").alias("times"))
    found = asked.join(tables["terms"], "term").crossJoin(F.broadcast(tables["stats"]))  # stats is one row
    odds = (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    weighed = found.select("qid", "term", "avgdl", (F.col("times") * F.log(odds + 1 if variant == "lucene" else odds)).alias("weight"))
    posted = tables["postings"]
    if allowed is not None:
        posted = posted.join(allowed.select(key).distinct(), key, "left_semi")
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest("avgdl", F.lit(1e-9))))
    scored = posted.join(weighed, "term").groupBy("qid", key).agg(F.sum(part).alias("score")).filter("score > 0")
    return scored.withColumn("rank", rank("score", key, by=["qid"])).filter(F.col("rank") < k)


def asked_index(docs: DataFrame, queries: DataFrame, column: str = "text", key: str = "doc_id", normalize: bool = True) -> dict[str, DataFrame]:
    """The index tables of documents, of those terms only that queries ask; document lengths and statistics are of all tokens.

    Texts stay where they are: only asked terms and documents' lengths are dealt.
    """
    asked = F.broadcast(terms_of(queries, "question", "qid", normalize).select("term").distinct())  # the words of questions
    counted = terms_of(docs, column, key, normalize).join(asked, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"))
    own = docs.select(key, F.size(text.tokenize(F.col(column), normalize)).cast("bigint").alias("len")).groupBy(key).agg(F.sum(F.greatest("len", F.lit(0))).alias("len"), F.count("*").alias("rows"))
    posted = counted.join(own.select(key, "len"), key).select("term", key, "tf", "len")
    stats = own.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("n_tokens"))
    return {"postings": posted, "terms": document_frequencies(counted), "stats": stats.select("n_docs", (F.col("n_tokens") / F.greatest("n_docs", F.lit(1))).alias("avgdl"))}


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None, **options) -> DataFrame:
    """search of documents (doc_id, text) that have no index."""
    return search(asked_index(docs, queries, key=options.get("key", "doc_id"), normalize=options.get("normalize", True)), queries, k, allowed, **options)
