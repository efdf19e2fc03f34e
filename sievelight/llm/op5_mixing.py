"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Within a
source, documents stand in one fixed order; the expected copies up to the k-th of them are rate * k,
one offset in [0, 1) is added, and a document is emitted once per integer that its step crosses. The
order goes by size class, so the copies are spread evenly over short and long documents and the words
taken come within a few documents of the target.

The position k is not found by a window over a whole source, which may hold a third of all rows:
documents are dealt into cells (source, size class, hash slice), cells are counted, the counts are
prefix-summed over the few cells of a source, and only within a cell are documents numbered. The slices of a class grow with the
square root of the documents, and so do the cells of a source and the documents of a cell, even if all have one size.

Texts are read for their sizes once, and once more where whole documents are mixed; targets and counts come from the table
of the sizes. Whole documents are shuffled once.

Nulls and ties: a null text has size 0, a null source is a source of its own (last), a null doc_id sorts first.
Rows that repeat in full are numbered one after the other; which of them gets which number makes no
difference. Documents of size 0 get copies like any other of their source; a source whose
size is 0 has target 0 and gets none. Texts of any length count whole. mix() keeps all columns, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_SPACE, stored, table

#: Weights dealt to the sources in order, again and again.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words wanted in all, as a multiple of the words there are; the most for one source.
SHARE, CAP = 1.5, 2.0
#: Least hash slices of a size class: rows of one class and source meet in a window only within a slice.
SLICES = 64


def words_of(text: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{ASCII_SPACE}]+")).cast("long").alias("size")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of each document."""
    return docs.select("doc_id", "source", words_of("text"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: sources are water-filled by weight up to cap times their size."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # The windows here run over one row per source.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.select(
        "source", "source_size", "w", "most",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("full"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("open_w"),
        (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("wanted"),
    )
    # If the sources before this one are full, the rest share what is left at this level. The first level that
    # overfills none of them is the one: those behind it count sources as full that are not, and are lower.
    level = (F.col("wanted") - F.col("full")) / F.col("open_w")
    per = per.withColumn("level", F.when(level * F.col("w") <= F.col("most"), level))
    return per.select("source", "source_size", F.least("most", F.coalesce(F.max("level").over(everything) * F.col("w"), F.col("most"))).alias("target"))


def slices_for(rows: int) -> int:
    return max(SLICES, -(-math.isqrt(rows) // SLICES))


def _celled(sized: DataFrame, slices: int) -> DataFrame:
    """sized with its cell: __s and __n (the source without nulls), __c, __l."""
    slice_of = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 7), 16, 10).cast("long") % slices
    bits = F.length(F.bin("size"))
    size_class = (bits * 16 + F.floor(F.col("size") * 16 / F.pow(F.lit(2.0), bits - 1))).cast("long")  # sixteen classes for each doubling
    return sized.withColumns({"__s": F.coalesce("source", F.lit("")), "__n": F.col("source").isNull(), "__c": size_class, "__l": slice_of})


_CELL = ["__s", "__n", "__c", "__l"]


def copies(sized: DataFrame, narrow: DataFrame, wanted: DataFrame, slices: int, seed: str = "mix") -> DataFrame:
    """sized with source_size, target and copies (long); other columns of sized are carried along. narrow: the same rows' doc_id, source, size,
    from a table; wanted: targets()."""
    counted = _celled(narrow, slices).groupBy("source", *_CELL).agg(F.count("*").alias("n"))
    along = Window.partitionBy("__s", "__n").orderBy("__c", "__l").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__base", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    counted = counted.alias("c").join(wanted.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(*_CELL, "__base", "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("__s"))), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))
    inside = Window.partitionBy(*_CELL).orderBy("size", F.col("doc_id").asc_nulls_first())
    joined = _celled(sized, slices).withColumn("__k", F.row_number().over(inside).cast("long")).join(counted, _CELL)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    k = F.col("__base") + F.col("__k")
    upto = lambda k: F.floor(rate * k.cast("double") + offset)
    return joined.withColumn("copies", (upto(k) - upto(k - 1)).cast("long")).drop(*_CELL, "__k", "__base")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: every row of docs as often as it is taken, with docs' columns."""
    narrow = stored(sizes(docs), "mix-sizes")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select("doc_id", "source", words_of("text"), row)
    taken = copies(sized, narrow, targets(narrow), slices_for(narrow.count())).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = stored(sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), "mix-sizes")
    taken = copies(narrow, narrow, targets(narrow), slices_for(narrow.count()))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


QUERIES = {"op5_mixing": op5_mixing}

ORACLE_SQL = {
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM per),
filled AS (
  SELECT *,
    coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_,
    (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS open_w,
    1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS wanted
  FROM weighed),
levels AS (SELECT *, CASE WHEN (wanted - full_) / open_w * w <= most THEN (wanted - full_) / open_w END AS level FROM filled),
targets AS (SELECT source, source_size, least(most, coalesce(max(level) OVER () * w, most)) AS target FROM levels),
cells AS (
  SELECT *, CAST(length(bin(size)) * 16 + floor(size * 16 / pow(2.0::DOUBLE, length(bin(size)) - 1)) AS BIGINT) AS cls,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7))::BIGINT % greatest(64, CAST(ceil(floor(sqrt((SELECT count(*) FROM documents))) / 64) AS BIGINT)) AS sl
  FROM sized),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, sl, size, doc_id NULLS FIRST) AS k,
    ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 7))::BIGINT::DOUBLE / 268435456.0::DOUBLE AS off_
  FROM cells),
rated AS (
  SELECT n.doc_id, n.source, n.size, n.k, n.off_, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate
  FROM numbered n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CAST(floor(rate * k::DOUBLE + off_) AS BIGINT) - CAST(floor(rate * (k - 1)::DOUBLE + off_) AS BIGINT) AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken
"""
}
