"""Command line: python -m sievelight COMMAND INPUT OUTPUT, also through spark-submit.

extract: pages to Markdown. ingest: the crawl filters. stream: extract over a file stream. The stages of extract as commands of their own:
preprocess: pages to simplified pages with blocks; infer: these to labels; postprocess: labelled pages to results. A stage's rows that
stand in its output already, by page_id, are left out, so a command can be repeated."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.ingest import ingest
from .operators.resume import pending
from .plans.extract import FALLBACKS, OUTPUTS, Config, extract, with_content, with_labels, with_simplified
from .session import ship
from .sources.readers import json_lines
from .sources.warc import html_pages, read_warc


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sievelight", description=__doc__)
    parser.add_argument("command", choices=("extract", "ingest", "stream", "preprocess", "infer", "postprocess"))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--format", choices=("parquet", "jsonl", "warc"), default="parquet")
    parser.add_argument("--classifier", default="heuristic")
    parser.add_argument("--output-format", choices=OUTPUTS, default="markdown")
    parser.add_argument("--fallback", choices=FALLBACKS, default="none")
    parser.add_argument("--checkpoint", help="of a stream; by default beside the output")
    given = parser.parse_args(argv)
    spark = ship(SparkSession.builder.appName("sievelight").getOrCreate())
    config = Config(classifier=given.classifier, output=given.output_format, fallback=given.fallback)
    if given.command == "stream":
        from .streaming.pages import extract_stream, page_stream

        schema = spark.read.parquet(given.input).schema
        extract_stream(page_stream(spark, given.input, schema), given.output, given.checkpoint or f"{given.output}.checkpoint", config).awaitTermination()
        return
    pages = spark.read.parquet(given.input) if given.format == "parquet" else json_lines(spark, given.input) if given.format == "jsonl" else html_pages(read_warc(spark, given.input))
    stages = {"preprocess": with_simplified, "infer": with_labels, "postprocess": with_content}
    if given.command in stages:
        if "page_id" in pages.columns and _exists(spark, given.output):
            pages = pending(pages, spark.read.parquet(given.output), "page_id")
        stages[given.command](pages, config).write.option("compression", "zstd").mode("append").parquet(given.output)
        return
    made = ingest(pages) if given.command == "ingest" else extract(pages, config)
    made.write.option("compression", "zstd").parquet(given.output)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


if __name__ == "__main__":
    main()
