"""Command line: ``python -m factloom.cli ingest ROOT STORE [--pattern P] [--collection C]`` and ``status STORE``.

``ingest`` reads a directory's files into pages and chunks; each run leaves a row in STORE/runs, a failed one too.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factloom.operators.runs import RunRecorder
from factloom.sources.landing import pdf_pages, read_pages, scan_directory, text_pages
from factloom.streaming.ingest import ingest_batch


def ingest(spark: SparkSession, root: str, store: str, pattern: str = "*.txt", collection: str | None = None) -> int:
    """Pages read; files that can't be read are noted as errors of the run and don't stop the others."""
    with RunRecorder(spark, f"{store}/runs", "ingest") as run:
        files = scan_directory(spark, root, pattern)
        files = files.withColumn("collection", F.lit(collection)) if collection else files
        pages = read_pages(files, pdf_pages if pattern.endswith(".pdf") else text_pages)
        for r in pages.filter("warning is not null").select("filename", "warning").limit(100).collect():
            run.fail("unreadable", f"{r.filename}: {r.warning}")
        good = pages.filter("text is not null")
        run.n_items = good.count()
        ingest_batch(good, store)
    return run.n_items


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factloom")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("root")
    a.add_argument("store")
    a.add_argument("--pattern", default="*.txt")
    a.add_argument("--collection")
    b = sub.add_parser("status")
    b.add_argument("store")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    if args.command == "ingest":
        print(f"{ingest(spark, args.root, args.store, args.pattern, args.collection)} pages")
    else:
        spark.read.parquet(f"{args.store}/runs").orderBy("started_at").select("stage", "started_at", "n_items", "errors", "notes").show(60, truncate=False)


if __name__ == "__main__":
    main()
