"""Chunking of documents into traceable pieces: windows of tokens, sentences, meaning, or units of the text.

A document is one row with its pages nested (doc_id, source_id, authority, pages: array of page,
lang, text and, for structural chunking, unit_refs), as ``ingest.documents`` makes it; ``nested`` makes it of
page rows. All its chunks are made within the row by array functions, so numbering them needs no
shuffle. Tokens are words unless other column functions are given: ``split`` from a text to its
tokens with ``glue`` between them, ``count`` from a text to their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let

LEAST_CHARS, LEAST_PREAMBLE = 20, 50
PIECE = "struct<page:int,lang:string,k:int,unit_ref:string,text:string>"
REFS = "array<struct<ref:string,num:string,start:int>>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def nested(pages: DataFrame) -> DataFrame:
    """Documents of page rows (doc_id, page, lang, text and, where there are, source_id, authority, unit_refs)."""
    has = set(pages.columns)
    own = [F.col("page").cast("int").alias("page"), "lang", "text", (F.col("unit_refs") if "unit_refs" in has else F.lit(None)).cast(REFS).alias("unit_refs")]
    about = [F.first(c).alias(c) if c in has else F.lit(v).alias(c) for c, v in (("source_id", None), ("authority", 0))]
    return pages.groupBy("doc_id").agg(*[c for c in about], F.array_sort(F.collect_list(F.struct(*own))).alias("pages"))


def single(docs: DataFrame, text: Column | str = "text", refs: Column | None = None) -> DataFrame:
    """Documents of one page each, without a shuffle, of rows doc_id, lang, source, text."""
    has = set(docs.columns)
    page = F.struct(F.lit(1).alias("page"), F.col("lang"), F.col(text).alias("text") if isinstance(text, str) else text.alias("text"), (F.lit(None) if refs is None else refs).cast(REFS).alias("unit_refs"))
    return docs.select("doc_id", (F.col("source") if "source" in has else F.lit(None)).cast("string").alias("source_id"), F.lit(0).alias("authority"), F.array(page).alias("pages"))


def piece(page: Column, text: Column, k: Column | None = None, ref: Column | None = None) -> Column:
    return F.struct(page["page"].cast("int").alias("page"), page["lang"].alias("lang"), (F.lit(None) if k is None else k).cast("int").alias("k"), (F.lit(None) if ref is None else ref).cast("string").alias("unit_ref"), text.alias("text"))


def chunked(docs: DataFrame, of_page: Callable[[Column], Column], count: Callable) -> DataFrame:
    """The pieces of all pages with their fields. position counts a document's chunks; a piece's own number k, where it has one, makes its id."""
    has = set(docs.columns)
    given = lambda c, value, kind: (F.col(c) if c in has else F.lit(value)).cast(kind).alias(c)
    pieces = F.flatten(F.transform("pages", of_page))
    rows = docs.select("doc_id", given("source_id", None, "string"), given("authority", 0, "int"), given("metadata", None, "map<string,string>"), F.posexplode(pieces).alias("position", "c"))
    number = F.coalesce("c.k", "position").cast("string")
    return rows.select(
        F.concat_ws("::", F.col("doc_id").cast("string"), F.concat(F.lit("p"), F.col("c.page").cast("string")), F.concat(F.lit("c"), number)).alias("id"),
        "c.text", T.normalize_for_search(F.col("c.text")).alias("text_norm"), "doc_id", "source_id", "authority", "c.lang", "c.page", "position", "c.unit_ref", count(F.col("c.text")).alias("n_tokens"), "metadata",
    )


def fixed_windows(docs: DataFrame, most: int = 400, overlap: int = 60, split: Callable = words, glue: str = " ", count: Callable | None = None) -> DataFrame:
    """Windows of ``most`` tokens that overlap; those under 20 characters are dropped. The last window is the first to reach the end."""
    step = max(1, most - overlap)

    def cut(page):
        def windows(w):
            starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - most) / step), F.lit(0)).cast("int"))
            texts = F.transform(starts, lambda k: T.strip(F.array_join(F.slice(w, k * step + 1, most), glue)))
            return F.transform(F.filter(texts, lambda t: F.char_length(t) >= LEAST_CHARS), lambda t: piece(page, t))

        return let(split(page["text"]), windows)

    return chunked(docs, cut, count or (lambda t: F.size(split(t))))


def packed(sentences: Column, most: int, overlap: int, count: Callable) -> Column:
    """Sentences packed greedily into texts of at most ``most`` tokens; the next text begins with the last ``overlap`` sentences.

    The fold sees the sentences' sizes only and yields first and last numbers; texts are joined once.
    """
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("out"), F.lit(0).alias("a"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def texts(s):
        def spans(sizes):
            def step(acc, n):
                full = (acc["i"] > acc["a"]) & (acc["n"] + n > most)
                first = F.greatest(acc["i"] - overlap, acc["a"])
                kept = F.aggregate(F.slice(sizes, first + 1, acc["i"] - first), F.lit(0), lambda x, y: x + y) if overlap else F.lit(0)
                return F.struct(
                    F.when(full, F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), (acc["i"] - 1).alias("b"))))).otherwise(acc["out"]).alias("out"),
                    F.when(full, first).otherwise(acc["a"]).alias("a"),
                    F.when(full, kept + n).otherwise(acc["n"] + n).alias("n"),
                    (acc["i"] + 1).alias("i"),
                )

            return F.aggregate(sizes, start, step, lambda acc: F.when(acc["i"] > acc["a"], F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), (acc["i"] - 1).alias("b"))))).otherwise(acc["out"]))

        return F.transform(let(F.transform(s, count), spans), lambda x: F.array_join(F.slice(s, x["a"] + 1, x["b"] - x["a"] + 1), " "))

    return let(sentences, texts)


def _sentences(page: Column, most: int, overlap: int, count: Callable) -> Column:
    return F.transform(packed(T.split_sentences(page["text"]), most, overlap, count), lambda t, k: piece(page, t, k))


def by_sentence(docs: DataFrame, most: int = 400, overlap: int = 1, count: Callable = count_words) -> DataFrame:
    return chunked(docs, lambda page: F.transform(_sentences(page, most, overlap, count), lambda c: c.withField("k", F.lit(None).cast("int"))), count)


def semantic(docs: DataFrame, embed: Callable, most: int = 600, spread: float = 0.25, count: Callable = count_words) -> DataFrame:
    """Cuts where neighbouring sentences are less alike than the page's mean less ``spread`` deviations, or where a text would be too long.

    embed: a column function or pandas UDF from text to a vector; it sees one sentence a row.
    """
    about = [c for c in ("source_id", "authority", "metadata") if c in docs.columns]
    pages = docs.select("doc_id", F.posexplode("pages").alias("p", "page"))
    s = pages.select("doc_id", "p", F.posexplode(T.split_sentences(F.col("page.text"))).alias("k", "s")).withColumn("v", embed(F.col("s")).cast("array<double>"))
    s = s.groupBy("doc_id", "p").agg(F.array_sort(F.collect_list(F.struct("k", "s", "v"))).alias("s"))
    s = s.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "s"))).alias("of_page"))
    rows = docs.select("doc_id", *about, "pages").join(s, "doc_id")
    rows = rows.select("doc_id", *about, F.transform("pages", lambda page, p: F.struct(page["page"].alias("page"), page["lang"].alias("lang"), F.element_at("of_page", p).alias("s"))).alias("pages"))

    def likeness(s):
        pair = lambda i: F.aggregate(F.zip_with(F.get(s, i - 1)["v"], F.get(s, i)["v"], lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.when(i < F.size(s), pair(i)))

    def cut(page):
        def with_likeness(like):
            total = lambda f: F.aggregate(like, F.lit(0.0), lambda a, x: a + F.coalesce(f(x), F.lit(0.0)))
            mean = total(lambda x: x) / F.greatest(F.size(like), F.lit(1))
            # Deviations are of the population.
            return let(mean, lambda m: let(m - spread * F.sqrt(total(lambda x: (x - m) * (x - m)) / F.greatest(F.size(like), F.lit(1))), lambda least: runs(page["s"], like, least)))

        return F.when(page["s"].isNotNull(), F.transform(let(likeness(page["s"]), with_likeness), lambda t: piece(page, t))).otherwise(F.array().cast(f"array<{PIECE}>"))

    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("out"), F.lit(0).alias("a"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def runs(s, like, least):
        def step(acc, x):
            n = count(x["s"])
            far = F.coalesce(F.when(acc["i"] > 0, F.get(like, acc["i"] - 1) < least), F.lit(False))
            ends = (acc["i"] > acc["a"]) & (far | (acc["n"] + n > most))
            return F.struct(
                F.when(ends, F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), (acc["i"] - 1).alias("b"))))).otherwise(acc["out"]).alias("out"),
                F.when(ends, acc["i"]).otherwise(acc["a"]).alias("a"),
                F.when(ends, n).otherwise(acc["n"] + n).alias("n"),
                (acc["i"] + 1).alias("i"),
            )

        spans = F.aggregate(s, start, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), (acc["i"] - 1).alias("b")))))
        return F.transform(spans, lambda x: F.array_join(F.transform(F.slice(s, x["a"] + 1, x["b"] - x["a"] + 1), lambda y: y["s"]), " "))

    return chunked(rows, cut, count)


def structural(docs: DataFrame, most: int = 800, count: Callable = count_words) -> DataFrame:
    """One chunk for each unit (unit_refs: ref, num, start); long units are split by sentences and keep their ref.

    Text before the first unit is a chunk if it is longer than 50 characters; pages without units are packed by
    sentences, and their ids count within the page.
    """

    def units(page):
        refs, t = page["unit_refs"], page["text"]
        first = F.get(refs, F.lit(0))["start"]
        head = F.when(first > LEAST_PREAMBLE, F.array(piece(page, T.strip(F.substring(t, F.lit(1), first))))).otherwise(F.array().cast(f"array<{PIECE}>"))

        def block(r, i):
            end = F.coalesce(F.get(refs, i + 1)["start"], F.char_length(t))
            parts = lambda b: F.when(F.char_length(b) < LEAST_CHARS, F.array().cast("array<string>")).when(count(b) > most, packed(T.split_sentences(b), most, 0, count)).otherwise(F.array(b))
            return F.transform(let(T.strip(F.substring(t, r["start"] + 1, end - r["start"])), parts), lambda b: piece(page, b, None, r["ref"]))

        return F.concat(head, F.flatten(F.transform(refs, block)))

    return chunked(docs, lambda page: F.when(F.coalesce(F.size(page["unit_refs"]), F.lit(0)) > 0, units(page)).otherwise(_sentences(page, most, 1, count)), count)


STRATEGIES = {"fixed": fixed_windows, "sentence": by_sentence, "semantic": semantic, "structural": structural}


def statistics(chunks: DataFrame) -> DataFrame:
    """One row about token counts; zeros for no chunks."""
    n = F.col("n_tokens")
    zero = lambda x, name: F.coalesce(x, F.lit(0.0)).cast("double").alias(name)
    has_ref = F.count_if(F.coalesce(F.col("unit_ref"), F.lit("")) != "") if "unit_ref" in chunks.columns else F.lit(0).cast("bigint")
    return chunks.agg(F.count("*").alias("n_chunks"), zero(F.avg(n), "mean_tokens"), zero(F.median(n), "median_tokens"), zero(F.stddev_pop(n), "std_tokens"), zero(F.min(n), "min_tokens"), zero(F.max(n), "max_tokens"), has_ref.alias("n_with_ref"))


def contained(passages: DataFrame, chunks: DataFrame, grams: int = 3, form: Callable = T.compare_form) -> DataFrame:
    """Ids of passages (item_id, text) that some chunk (id, text) has whole, in comparison form or another.

    A passage and a chunk that has it share every run of ``grams`` inner words, so they are
    joined by equality on the one with the smallest hash instead of comparing everything with
    everything; passages of three or four words by an inner word. Only ids and hashes meet; texts are
    fetched for pairs that share one. Passages of one or two words, which may begin and end
    within a word, are compared with all chunks.
    """
    p = passages.select("item_id", form(F.col("text")).alias("t")).withColumn("w", F.split("t", " "))
    c = chunks.select(F.col("id").alias("chunk"), form(F.col("text")).alias("c"))
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
    inner = F.slice("w", F.lit(2), F.size("w") - 2)
    found, split = None, c.select("chunk", F.split("c", " ").alias("w"))
    for n, which in ((grams, F.size("w") >= grams + 2), (1, (F.size("w") >= 3) & (F.size("w") < grams + 2))):
        keyed = p.filter(which).select("item_id", F.array_min(runs(inner, n)).alias("g"))
        own = split.filter(F.size("w") >= n).select("chunk", F.explode(F.array_distinct(runs(F.col("w"), n))).alias("g"))
        met = own.join(keyed, "g").select("item_id", "chunk")
        found = met if found is None else found.union(met)
    found = found.distinct().join(c, "chunk").join(p.select("item_id", "t"), "item_id").filter(F.contains("c", "t")).select("item_id")
    short = p.filter(F.size("w") < 3).select("item_id", "t").join(c, F.contains("c", "t")).select("item_id")
    return found.union(short).distinct()


def fragmentation(passages: DataFrame, chunks: DataFrame, examples: int = 5) -> DataFrame:
    """n, n_whole and rate of passages that no chunk has whole, in the form that searching compares, with the first examples (80 characters; null where all are whole); rate 1 for no passages."""
    whole = contained(passages, chunks, form=T.normalize_for_search).withColumn("whole", F.lit(1))
    rows = passages.select("item_id", "text").join(whole, "item_id", "left")
    # The examples are the smallest ids: a bounded list of each task.
    broken = F.when(F.col("whole").isNull(), F.struct("item_id", F.substring("text", 1, 80).alias("text")))
    first = rows.filter("whole IS NULL").orderBy("item_id").limit(examples).agg(F.transform(F.array_sort(F.collect_list(broken)), lambda x: x["text"]).alias("examples"))
    counts = rows.agg(F.count("*").alias("n"), F.count("whole").alias("n_whole")).withColumn("rate", 1 - F.col("n_whole") / F.greatest("n", F.lit(1)))
    return counts.crossJoin(F.broadcast(first.select(F.when(F.size("examples") > 0, F.col("examples")).alias("examples"))))  # one row each
