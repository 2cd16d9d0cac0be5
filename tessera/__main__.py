"""Entry points: ``python -m tessera ingest|index|ask|indexes ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import chunking, ingest, pipeline
from .sources import readers


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    kinds = top.add_subparsers(dest="command", required=True)
    p = kinds.add_parser("ingest", help="files below root, in folders by source, to documents")
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--registry", required=True, help="JSON lines: source_id, label, authority, unit, langs, priority")
    p.add_argument("--source", action="append", help="only this source; may be repeated")
    p.add_argument("--priority", type=int, help="only sources of at most this priority")
    p = kinds.add_parser("index", help="documents to an index")
    p.add_argument("documents")
    p.add_argument("root")
    p.add_argument("--chunker", default="structural", choices=[*chunking.STRATEGIES])
    p.add_argument("--model", default="hashing")
    p.add_argument("--lang")
    p.add_argument("--embed-field", default="text", choices=["text", "text_norm"])
    p.add_argument("--sources", nargs="*")
    p = kinds.add_parser("ask", help="questions (JSON lines: qid, question) to answers")
    p.add_argument("index")
    p.add_argument("questions")
    p.add_argument("out")
    p.add_argument("--method", default="rrf", choices=["rrf", "weighted", "vector", "bm25"])
    p.add_argument("--no-rerank", action="store_true")
    p.add_argument("--top", type=int, default=5)
    p = kinds.add_parser("indexes", help="the indexes below root")
    p.add_argument("root")
    return top


def main(given: list[str] | None = None) -> None:
    a = arguments().parse_args(given)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "ingest":
        registry = spark.read.schema(ingest.REGISTRY).json(a.registry)
        chosen = a.source if a.source else None
        raw = readers.read_pages(spark, a.root, chosen)
        readers.write_corpus(ingest.documents(ingest.pages(raw, registry, chosen, a.priority)), a.out)
        ingest.totals(readers.read_corpus(spark, a.out)).show()
    elif a.command == "index":
        path = readers.index_path(a.root, a.chunker, a.model, a.lang, a.embed_field if a.embed_field != "text" else None)
        pipeline.build(readers.read_corpus(spark, a.documents, a.sources), path, a.chunker, a.model, a.lang, a.embed_field).meta.show(truncate=False)
    elif a.command == "ask":
        questions = spark.read.schema("qid bigint, question string").json(a.questions)
        done = pipeline.answer(pipeline.load(spark, a.index), questions, f"{a.out}/stages", a.method, not a.no_rerank, top=a.top)
        done.rows.write.mode("overwrite").json(f"{a.out}/answers")
        print({k: round(v) for k, v in done.latency_ms.items()}, "degraded" if done.degraded else "")
    else:
        readers.catalogue(spark, a.root).show(truncate=False)


if __name__ == "__main__":
    main()
