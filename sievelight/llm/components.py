"""Connected components by alternating large-star and small-star, and joins whose hot keys are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, stored

#: Keys that may count as hot at most, and the rows a hot key has at least.
HOT_KEYS, HOT_ROWS = 1000, 1000


def hot_join(rows: DataFrame, per: DataFrame, on: str, total: int) -> DataFrame:
    """rows joined with per, a table with one row for each value of on, and as n how often rows has it. total: the rows of rows.

    A value with at least one in HOT_KEYS of all rows is hot. There are at most HOT_KEYS of these, so they are broadcast, and their rows
    stay where they are; all other rows meet by value, and no task has to take more than one in HOT_KEYS of them for one value."""
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = per.where(F.col("n") >= least).drop("n")
    if hot.isEmpty():
        return rows.join(per.drop("n"), on)
    hot = F.broadcast(hot)
    rest = rows.join(hot.select(on), on, "left_anti").join(per.where(F.col("n") < least).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u, linked to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    least = stored(least, "least")
    made = hot_join(both.where("v > u"), least, "u", 2 * edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    made = stored(made, "edges")
    drop_table(edges.sparkSession, least)
    return made


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every smaller neighbour of it, linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    moved = hot_join(down, least, "u", edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    made = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    drop_table(edges.sparkSession, least)
    return made


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node with an edge; the component is its smallest node. edges: u, v (long).

    The tables of each step go to the shared folder; minima are found with partial sums. The edges of a node with very many are not
    gathered in one place: its minimum is broadcast to them. Ends when a round changes nothing. A null or repeated edge,
    and one from a node to itself, changes nothing."""
    spark = edges.sparkSession
    now = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        large = _large_star(now)
        after = _small_star(large)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(spark, now, large)
        now = after
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
