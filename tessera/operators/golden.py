"""Question sets: building, audit, citation and faithfulness checks, agreement with hand labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

KEPT_OUT = ("article", "absent_terms")


def lexical_overlap(question: Column, answer: Column) -> Column:
    """Share of the question's content words that the answer has; Python's rounding."""
    asked = text.content_words(question)
    return F.bround(F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, text.content_words(answer))) / F.size(asked)).otherwise(0.0), 2)


def headings(chunks: DataFrame) -> DataFrame:
    """Chunks that begin with the heading of their unit, with its number as ``article``."""
    number = F.element_at(F.split("unit_ref", " "), -1)
    rows = chunks.filter(F.col("unit_ref").rlike(r"^article \d+$"))
    return rows.withColumn("article", number.cast("int")).filter(text.is_heading(F.col("text"), number, F.col("lang")))


def present(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid and the absent_terms that some chunk has after all, as whole words; Arabic ones in normal form anywhere in Arabic chunks.

    A term is a whole word, so the first run of letters in it is one in the chunk too: they are joined by
    equality. Arabic terms and those without letters, few, are compared with all chunks.
    """
    run, arabic = "[a-zà-ÿ]+", F.regexp_like("term", F.lit(f"[{fixed.ARABIC}]"))
    terms = questions.select("qid", F.explode("absent_terms").alias("raw")).withColumn("term", F.when(F.regexp_like("raw", F.lit(f"[{fixed.ARABIC}]")), F.col("raw")).otherwise(text.compare_form(F.col("raw"))))
    terms = terms.withColumn("word", F.when(~arabic, F.nullif(F.regexp_extract("term", run, 0), F.lit(""))))
    forms = chunks.select(F.struct(text.compare_form(F.col("text")).alias("compare"), F.when(F.col("lang") == "ar", text.normalize_for_search(F.col("text"))).otherwise("").alias("normal")).alias("form"))
    has = text.has_term(F.col("form"), F.col("term"))
    by_word = forms.select("form", F.explode(F.array_distinct(F.regexp_extract_all(F.col("form.compare"), F.lit(run), F.lit(0)))).alias("word")).join(terms, "word").filter(has)
    rest = terms.filter("word IS NULL").crossJoin(forms).filter(has)
    found = by_word.select("qid", "raw").union(rest.select("qid", "raw")).distinct()
    return found.groupBy("qid").agg(F.array_sort(F.collect_list("raw")).alias("found"))


def absent(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Unanswerable questions none of whose terms a chunk has."""
    return questions.join(present(questions, chunks).select("qid"), "qid", "left_anti")


def build(questions: DataFrame, chunks: DataFrame, source: str = "code_travail") -> DataFrame:
    """Questions with the chunks of their article, whether the evidence is in them, how much they copy, and alerts and blocking failures.

    Evidence and copying are checked on the French text, copying for French questions. Unanswerable questions fail if the corpus has one of their terms.
    """
    french = F.when(F.col("lang") == "fr", F.col("text"))
    heads = headings(chunks).groupBy("article").agg(
        F.array_sort(F.collect_list("id")).alias("relevant_chunk_ids"), F.array_sort(F.collect_set("lang")).alias("relevant_langs"),
        F.collect_list(text.compare_form(french)).alias("forms"), F.array_join(F.collect_list(french), " ").alias("french"),
    )
    rows = questions.join(heads, "article", "left").join(present(questions.filter("type = 'unanswerable'"), chunks), "qid", "left")
    answerable = F.col("type") != "unanswerable"
    form = text.compare_form(F.col("evidence"))
    verified = F.coalesce(F.exists("forms", lambda t: F.contains(t, form)), F.lit(False))
    overlap = F.when(F.col("lang") == "fr", lexical_overlap(F.col("question"), F.coalesce("french", F.lit("")))).otherwise(0.0)
    some = lambda condition, words: F.when(condition, F.array(words)).otherwise(F.array().cast("array<string>"))
    number = F.coalesce(F.col("article").cast("string"), F.lit("?"))
    failures = F.concat(
        some(answerable & F.col("relevant_chunk_ids").isNull(), F.concat(F.lit("no chunk begins article "), number)),
        some(answerable & ~verified, F.concat(F.lit("evidence is not in article "), number)),
        some(F.col("found").isNotNull(), F.concat(F.lit("the corpus has "), F.array_join("found", ", "))),
    )
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "answerable": answerable,
            "article_ref": F.when(answerable, F.concat(F.lit("article "), number)),
            "evidence": F.when(answerable, F.col("evidence")),
            "evidence_verified": F.when(answerable, verified),
            "source_expected": F.when(answerable, F.array(F.lit(source))).otherwise(none),
            "relevant_chunk_ids": F.coalesce("relevant_chunk_ids", none),
            "relevant_langs": F.when(answerable, F.coalesce("relevant_langs", none)),
            "lexical_overlap": F.when(answerable, overlap),
            "alert": answerable & (F.col("type") == "semantic") & (overlap > fixed.COPY_ALERT),
            "failures": failures,
        }
    ).drop("forms", "french", "found")


def entries(built: DataFrame) -> DataFrame:
    """The rows of the question set itself: without what only the audit needs."""
    return built.drop(*KEPT_OUT, "alert", "failures")


def answerable(questions: DataFrame) -> DataFrame:
    return questions.filter("answerable")


def failures(built: DataFrame) -> DataFrame:
    return built.select("qid", F.explode("failures").alias("failure"))


def counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("type").agg(F.count("*").alias("n")).orderBy("type")


def audit(built: DataFrame) -> DataFrame:
    """One row for each question: qid, type, article, proof, copied and langs, as an audit lists them."""
    proof = F.when(F.col("answerable"), F.when(F.col("evidence_verified"), "OK").otherwise("ECHEC")).otherwise(F.when(F.size("failures") > 0, "PRESENT").otherwise("absent"))
    copied = F.when(~F.col("answerable"), "-").when(F.col("lang") == "fr", F.concat(F.round(100 * F.col("lexical_overlap")).cast("int").cast("string"), F.lit("%"))).otherwise("n/a")
    return built.select("qid", "type", F.coalesce("article_ref", F.lit("-")).alias("article"), proof.alias("proof"), copied.alias("copied"), F.coalesce(F.array_join("relevant_langs", "+"), F.lit("-")).alias("langs"))


def audit_report(built: DataFrame) -> str:
    """The audit as Markdown. Question sets are written by hand, so their audit fits the driver."""
    rows, kinds, failed = audit(built).orderBy("qid").collect(), counts(built).collect(), failures(built).orderBy("qid", "failure").collect()
    alerts = built.filter("alert").select("qid", "lexical_overlap").orderBy("qid").collect()
    lines = ["# Audit of the question set", "", f"{len(rows)} questions: " + ", ".join(f"{r['n']} `{r['type']}`" for r in kinds), ""]
    lines += [f"- blocking failures: **{len(failed)}**", f"- copying alerts (above {fixed.COPY_ALERT:.0%}): **{len(alerts)}**", "", "| qid | type | article | proof | copied | langs |", "|-|-|-|-|-|-|"]
    lines += ["| " + " | ".join(map(str, r)) + " |" for r in rows]
    lines += ["", *(f"- failed: {r['qid']}: {r['failure']}" for r in failed), *(f"- alert: {r['qid']}: {r['lexical_overlap']:.0%} of its words" for r in alerts)]
    return "\n".join(lines).rstrip() + "\n"


def judged(replies: DataFrame) -> DataFrame:
    """Faithfulness from a judge's JSON replies (qid, reply): supported claims over claims; null where a reply can't be read."""
    claims = F.from_json("reply", "affirmations array<struct<texte:string,soutenue:boolean,passage:int>>")["affirmations"]
    return replies.select("qid", F.size(claims).alias("n_claims"), F.try_divide(F.size(F.filter(claims, lambda c: c["soutenue"])), F.size(claims)).alias("faithfulness"))


def faithfulness(answers: DataFrame, complete, attempts: int = 2) -> DataFrame:
    """qid, n_claims and faithfulness of answers (qid, question, contexts, answer) by a judge, a column function from prompt to reply.

    A reply that can't be read is asked for again; after ``attempts`` it is null.
    """
    head, rest = fixed.FAITHFULNESS.split("{question}")
    middle, rest = rest.split("{contexts}")
    low, end = rest.split("{answer}")
    prompt = F.concat(F.lit(head), F.col("question"), F.lit(middle), F.col("contexts"), F.lit(low), F.col("answer"), F.lit(end))
    left, out = answers.select("qid", prompt.alias("prompt")), None
    for k in range(attempts):
        got = left.select("qid", "prompt", complete(F.col("prompt")).alias("reply"))
        rows = judged(got).join(got.select("qid", "prompt"), "qid")
        done = rows if k == attempts - 1 else rows.filter("faithfulness IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        left = rows.filter("faithfulness IS NULL").select("qid", F.concat("prompt", F.lit("\nJSON:")).alias("prompt"))
    return out.drop("prompt")


def calibration(labels: DataFrame) -> DataFrame:
    """Agreement and correlation of a judge with hand labels, rows (hand, judge)."""
    return labels.agg(F.count("*").alias("n"), F.avg((F.col("hand") == F.col("judge")).cast("double")).alias("agreement"), F.corr("hand", "judge").alias("correlation"))
