"""Command line: index, search, eval, ingest, run. Everything is a call of the API and a printed table."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake.operators import chunking
from strandlake.plans.knowledge_base import KnowledgeBase
from strandlake.plans.outputs import hit_table, persist
from strandlake.plans.workflow import Run
from strandlake.sources import legal_xhtml
from strandlake.sources.config import Settings
from strandlake.sources.gold import read_gold
from strandlake.sources.markdown import write_markdown


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("--rebuild", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--source", help="a regulation, or 'policies'")
    search.add_argument("--mode", default=None)
    search.add_argument("-k", type=int, default=5)
    evaluate = sub.add_parser("eval")
    evaluate.add_argument("--gold", required=True)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("--celex", required=True)
    ingest.add_argument("--name", required=True)
    ingest.add_argument("--title", required=True)
    ingest.add_argument("--refresh", action="store_true")
    run = sub.add_parser("run")
    run.add_argument("--source", required=True)
    run.add_argument("--name", required=True)
    run.add_argument("--model", required=True, help="module:function that answers prompts")
    run.add_argument("--approve", action="store_true", help="decide nothing by hand")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandlake").getOrCreate()
    s = Settings.load(spark)
    if args.command == "ingest":
        articles = legal_xhtml.parse_documents(legal_xhtml.fetch(spark, args.celex, s.cache_dir, not args.refresh)).cache()
        titles = spark.createDataFrame([(args.celex, args.title, dt.date.today().isoformat())], "celex string, title string, fetched string")
        write_markdown(legal_xhtml.to_markdown(articles, titles).select(F.lit(args.name).alias("source"), "value"), s.regulations_dir)
        legal_xhtml.counts(articles).show()
        return
    kb = KnowledgeBase.load(spark, s.regulations_dir, s.policies_csv, s.index_dir, rebuild=getattr(args, "rebuild", False), mode=s.retrieval_mode)
    if args.command == "index":
        print(kb.index.info())
        chunking.counts_by_source(kb.chunks).show()
    elif args.command == "search":
        kind = "policy" if args.source == "policies" else None
        found = kb.search(args.query, args.k, kind, None if kind else args.source, args.mode)
        hit_table(found).show(args.k, truncate=False)
    elif args.command == "eval":
        measures, missed = kb.evaluate(read_gold(spark, args.gold))
        measures.orderBy("grp", "mode").show(truncate=False)
        missed.select("mode", "q", "rank").orderBy("mode", "q").show(100, truncate=False)
    else:
        module, _, name = args.model.partition(":")
        run = Run(kb, getattr(importlib.import_module(module), name), uuid.uuid4().hex[:8], args.source, args.name)
        payload = run.start()
        while payload is not None:
            payload = run.resume("approve" if args.approve else input("Approve, or say what to change: "))
        at = f"{s.output_dir}/{args.source}-{dt.datetime.now():%Y%m%d-%H%M%S}"
        persist(run.outputs(), at)
        print(run.state["final_report"])
        print(f"Written to {at}")


if __name__ == "__main__":
    main()
