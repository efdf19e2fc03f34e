"""Sources: pages from lists, JSON lines (also zstd-compressed), Parquet, and path lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..tables import stored

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
RAW_JSON = T.StructType([T.StructField("html", T.StringType()), T.StructField("url", T.StringType())])
BENCHMARK = T.StructType([
    T.StructField("html", T.StringType()), T.StructField("convert_main_content", T.StringType()),
    T.StructField("meta", T.StructType([T.StructField("language", T.StringType()), T.StructField("level", T.StringType())])),
])
SCORE = T.StructType([T.StructField("page_idx", T.StringType()), T.StructField("f1", T.DoubleType()), T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()), T.StructField("empty", T.BooleanType())])


def pages_of(spark: SparkSession, pages: list) -> DataFrame:
    """input_idx, page_id, html, metadata, error from strings or dicts with html, page_id, metadata; others become error rows."""
    rows = []
    for k, page in enumerate(pages):
        if isinstance(page, str):
            rows.append((k, k, page, None, None))
        elif isinstance(page, dict) and isinstance(page.get("html", ""), str):
            rows.append((k, page.get("page_id", 0), page.get("html", ""), page.get("metadata"), None))
        else:
            rows.append((k, k, None, None, f"input failed: {type(page).__name__} is not a page"))
    return spark.createDataFrame(rows, "input_idx long, page_id long, html string, metadata map<string,string>, error string")


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_JSON) -> DataFrame:
    """JSON lines, plain, .gz or .zst; a missing html is "". Only the columns of the schema are parsed."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("html", F.coalesce("html", F.lit(""))) if "html" in schema.names else rows


def numbered_lines(spark: SparkSession, path: str | list[str], broadcast_splits: int = 1_000_000) -> DataFrame:
    """path, line (from 0 in each file), value of every line, in two passes and without moving the lines.

    A split's rows come in order, and splits begin at known bytes: the lines of a file's earlier splits are counted and summed up.
    One row for each split is broadcast, unless there are more than broadcast_splits of them."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("path", "start").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = stored(splits.select("path", "start", "low", before.alias("before")), "line-splits")
    known = F.broadcast(splits) if splits.count() <= broadcast_splits else splits
    return rows.join(known, ["path", "start"]).select("path", (F.col("at") - F.col("low") + F.col("before")).cast("long").alias("line"), "value")


def numbered_pages(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_JSON) -> DataFrame:
    """json_lines() with page_id, the number of the line in its file; a line that is no JSON is an empty page."""
    lines = numbered_lines(spark, path)
    parsed = lines.select("path", F.col("line").alias("page_id"), F.from_json("value", schema).alias("row")).select("path", "page_id", "row.*")
    return parsed.withColumn("html", F.coalesce("html", F.lit("")))


def benchmark_pages(spark: SparkSession, path: str, language: str = "en", limit: int = 0) -> DataFrame:
    pages = spark.read.schema(BENCHMARK).json(path).where(F.col("meta.language") == language)
    return pages.limit(limit) if limit else pages


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """One path a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where(F.length("path") > 0)


def shards(spark: SparkSession, folder: str, suffix: str = ".jsonl.zst") -> list[str]:
    """The files of a folder with that suffix, sorted, from any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().toString() for s in found if s.getPath().getName().endswith(suffix))


def scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE).parquet(path)
