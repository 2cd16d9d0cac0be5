"""Answers with citations. The model is any pandas UDF from prompt to text; offline, an extractive stand-in."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed, text


def context(passages: DataFrame) -> DataFrame:
    """qid, n and context of passages (qid, rank, source_id, unit_ref, lang, text); as many passages as a prompt takes."""
    line = text.context_line(F.col("rank"), F.col("source_id"), F.col("unit_ref"), F.col("lang"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return passages.groupBy("qid").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("context"))


@F.pandas_udf(StringType())
def extract(prompt: pd.Series) -> pd.Series:
    """The first sentence of the first passage with its number, or the refusal if there is none."""

    def answer(p: str) -> str:
        found = re.search(r"\[1\] \(.*?\)\n([^\n]*?[.!?]|[^\n]+)", p)
        return f"{found[1].strip()} [1]" if found and found[1].strip() else fixed.REFUSAL

    return prompt.map(answer)


def generate(questions: DataFrame, passages: DataFrame, complete=extract) -> DataFrame:
    """qid, answer, refused, citations for questions (qid, question); a question without passages gets an empty context."""
    rows = questions.join(context(passages), "qid", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "context": F.coalesce("context", F.lit(""))})
    rows = rows.withColumn("prompt", text.prompt(F.col("question"), F.col("context"))).withColumn("answer", complete(F.col("prompt")))
    return rows.select("qid", "question", "answer", text.has_refused(F.col("answer")).alias("refused"), text.verify_citations(F.col("answer"), F.col("n")).alias("citations"), "prompt")
