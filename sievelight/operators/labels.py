"""Blocks, predictions and labels in long form: one row for each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_of(prediction: Column) -> Column:
    """1 is main, everything else (and nothing) other."""
    return F.when(F.coalesce(prediction, F.lit(0)) == 1, "main").otherwise("other")


def regroup(blocks: DataFrame, predictions: DataFrame, keys: list[str], missing_as_other: bool = True) -> DataFrame:
    """blocks with the prediction for their keys and a label; blocks without one are other, or left out."""
    joined = blocks.join(predictions, keys, "left" if missing_as_other else "inner")
    return joined.withColumn("prediction", F.coalesce("prediction", F.lit(0))).withColumn("label", label_of(F.col("prediction")))


def labels_map(labelled: DataFrame, page: str, order: str) -> DataFrame:
    """page, labels: a map per page; of equal ids the last one in order counts, blocks without an id don't."""
    last = labelled.where("item_id IS NOT NULL").groupBy(page, "item_id").agg(F.max_by("label", order).alias("label"))
    return last.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("item_id", "label"))).alias("labels"))


def counts(labels: Column) -> tuple[Column, Column, Column]:
    """Blocks, main blocks and other blocks of a label map."""
    main = F.size(F.map_filter(labels, lambda _, v: v == "main"))
    return F.size(labels).cast("long"), main.cast("long"), (F.size(labels) - main).cast("long")


def when_ok(value: Column, error: Column | str = "error") -> Column:
    """value for rows without an error."""
    return F.when((F.col(error) if isinstance(error, str) else error).isNull(), value)


def fallback(value: Column, html: Column, mode: str = "bypass", error: str = "error") -> Column:
    """For rows with an error the whole page (bypass) or nothing (empty) instead of value."""
    if mode not in ("bypass", "empty"):
        raise ValueError(f"unknown fallback {mode!r}: bypass or empty")
    return F.when(F.col(error).isNull(), value).otherwise(html if mode == "bypass" else F.lit(""))


def length_batches(chunks: DataFrame, tokens: str, max_batch_tokens: int = 16_384, partitions: int | None = None) -> DataFrame:
    """chunks sorted by length within their partitions, with n_batch: how many of that length make a batch."""
    dealt = chunks.repartition(partitions) if partitions else chunks
    size = F.greatest(F.lit(1), F.floor(F.lit(max_batch_tokens) / F.greatest(F.col(tokens), F.lit(1)))).cast("long")
    return dealt.withColumn("n_batch", size).sortWithinPartitions(tokens)
