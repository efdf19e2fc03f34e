"""Resuming and batching: what is done is left out by anti-joins; ranges and batches are made of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import stored


def pending(work: DataFrame, done: DataFrame, key: str, start: int = 0, limit: int = 0) -> DataFrame:
    """Work that is not done, in order of key, from the start-th row on, at most limit rows (0: all)."""
    rest = work.join(done.select(key).distinct(), key, "left_anti")
    if not start and not limit:
        return rest
    rest = rest.orderBy(key).offset(start)
    return rest.limit(limit) if limit else rest


def in_range(index: Column, start: int, end: int | None = None) -> Column:
    return (index >= start) & (index < end) if end is not None else index >= start


def batches(rows: DataFrame, key: str, size: int, partitions: int = 64) -> DataFrame:
    """rows with batch: position in order of key divided by size.

    Positions come from a range partitioning: rows are numbered within each range, and the ranges' counts are summed
    before, so no single task sees all rows. The dealt rows are written once, as they must be dealt alike both times."""
    ranged = stored(rows.repartitionByRange(partitions, key).withColumn("__part", F.spark_partition_id()), "batches")
    counts = ranged.groupBy("__part").count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    placed = ranged.withColumn("__in", inside).join(counts, "__part")
    return placed.withColumn("batch", F.floor((F.col("__before") + F.col("__in")) / size).cast("long")).drop("__part", "__in", "__before")


def done_indices(paths: DataFrame, column: str = "path", pattern: str = r"warc_(\d{5})") -> DataFrame:
    """idx of the outputs that exist, from their names."""
    found = F.regexp_extract(column, pattern, 1)
    return paths.select(F.nullif(found, F.lit("")).cast("long").alias("idx")).where("idx IS NOT NULL").distinct()


def set_of(kind: str, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The distinct keys of either side (union), of both (common), or of left without right (difference)."""
    a, b = left.select(key), right.select(key)
    if kind not in ("union", "common", "difference"):
        raise ValueError(f"unknown set operation {kind!r}: union, common or difference")
    return a.unionByName(b).distinct() if kind == "union" else a.intersect(b) if kind == "common" else a.subtract(b)


def with_bypass(rows: DataFrame, bypass: Column, work) -> DataFrame:
    """work(the rows for which bypass is not true), and the others beside them; columns that work adds are null there."""
    skipped = F.coalesce(bypass, F.lit(False))
    return work(rows.where(~skipped)).unionByName(rows.where(skipped), allowMissingColumns=True)


def input_order(results: DataFrame, index: str = "input_idx") -> DataFrame:
    """Results in the order of the input, for a sink that needs it."""
    return results.orderBy(index)


def fill_gaps(work: DataFrame, results: DataFrame, key: str, message: str = "page was dropped before a result") -> DataFrame:
    """Every row of work with its result; where there is none, an error says so."""
    marked = results.withColumn("__has", F.lit(True))
    joined = work.join(marked, key, "left")
    error = F.when(F.col("__has").isNull(), F.lit(message))
    error = F.coalesce(error, F.col("error")) if "error" in results.columns else error
    return joined.withColumn("error", error).drop("__has")
