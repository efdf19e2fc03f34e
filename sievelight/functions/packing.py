"""Greedy packing of blocks into bounded chunks, as one higher-order function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Budget of a chunk in tokens; the begin and end tokens count towards it, and each block brings a separator.
MAX_TOKENS = 8192


def pack(costs: Column, max_tokens: int = MAX_TOKENS, edge_tokens: int = 2) -> Column:
    """array<struct<blocks: array<int>, tokens: int>> for an array of block lengths.

    Blocks stay in order, each in one chunk. A block that does not fit starts the next chunk; one longer than a whole
    chunk is cut to its budget and opens a chunk of its own."""
    budget = max_tokens - edge_tokens
    chunk = "struct<blocks:array<int>,tokens:int>"
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.array().cast("array<int>").alias("open"), F.lit(0).alias("used"), F.lit(0).alias("at"))

    def closed(acc: Column) -> Column:
        made = F.struct(acc["open"].alias("blocks"), (acc["used"] + edge_tokens).alias("tokens"))
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(made))).otherwise(acc["done"])

    def step(acc: Column, cost: Column) -> Column:
        need = F.least(cost + 1, F.lit(budget)).cast("int")
        fits = acc["used"] + need <= budget
        return F.struct(
            F.when(fits, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(fits, F.concat(acc["open"], F.array(acc["at"]))).otherwise(F.array(acc["at"])).alias("open"),
            F.when(fits, acc["used"] + need).otherwise(need).alias("used"),
            (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(costs, start, step, closed)


def chunk_tokens(blocks: Column, chunk: Column, sep: str, begin: str, end: str, max_tokens: int = MAX_TOKENS) -> Column:
    """The tokens of a chunk of pack(): begin, each block's tokens and a separator, end. blocks: array<array<string>>."""
    room = max_tokens - 3
    inner = F.flatten(F.transform(chunk["blocks"], lambda i: F.concat(F.slice(F.get(blocks, i), 1, room), F.array(F.lit(sep)))))
    return F.concat(F.array(F.lit(begin)), inner, F.array(F.lit(end)))
