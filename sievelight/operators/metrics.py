"""Scores of extracted text against references, and their reports.

Reports are native. n-grams of a text are counted in Arrow-batched Python where the text stands, so no text's n-grams are ever shuffled whole."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import ngrams, whitespace_tokens

#: Lower and upper bounds of the F1 histogram, best first.
BINS = ((0.9, 1.01), (0.8, 0.9), (0.6, 0.8), (0.4, 0.6), (0.2, 0.4), (0.0, 0.2))
LEVELS = ("simple", "mid", "hard")
#: Distinct n-grams of the reference side up to which they are broadcast, and their bytes.
BROADCAST_GRAMS, BROADCAST_BYTES = 500_000, 50_000_000


def ngram_counts(docs: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """key, gram, n: how often each n-gram stands in each text."""
    # The tokens are a column of their own: within the lambda of ngrams() they would be split anew for each position.
    words = docs.select(F.col(key), whitespace_tokens(text).alias("words"))
    grams = words.select(key, F.explode(ngrams(F.col("words"), n)).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count("*").alias("n"))


def _totals(docs: DataFrame, key: str, text: str, n: int, name: str) -> DataFrame:
    return docs.select(F.col(key), F.greatest(F.size(whitespace_tokens(text)) - (n - 1), F.lit(0)).cast("long").alias(name))


def prf(overlap: Column, n_reference: Column, n_predicted: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where a side is empty or nothing overlaps."""
    some = (n_reference > 0) & (n_predicted > 0) & (overlap > 0)
    p = F.when(some, overlap / n_predicted).otherwise(0.0)
    r = F.when(some, overlap / n_reference).otherwise(0.0)
    return p, r, F.when(some, 2 * p * r / (p + r)).otherwise(0.0)


def _grams(text: str | None, n: int) -> tuple[Counter, int]:
    """How often each run of n tokens stands in a text, and how many runs there are."""
    words = text.split() if text else []
    return Counter(zip(*(words[k:] for k in range(n)))), max(0, len(words) - n + 1)


def rouge_scores(pages: DataFrame, key: str, reference: str, predicted: str, n: int = 5, keep: list[str] | None = None) -> DataFrame:
    """key, f1, p, r, empty and the columns in keep for each page: its own n-gram multisets are compared, within its row. No shuffle."""
    carried = [key, *(keep or [])]
    given = pages.select(*carried, F.col(reference).alias("__a"), F.col(predicted).alias("__b"))
    schema = ", ".join([f"`{c}` {given.schema[c].dataType.simpleString()}" for c in carried] + ["__overlap long", "__n long", "__m long", "empty boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], []]
            for a, b in zip(batch.column("__a").to_pylist(), batch.column("__b").to_pylist()):
                (wanted, size), (got, other) = _grams(a, n), _grams(b, n)
                small, large = (wanted, got) if len(wanted) < len(got) else (got, wanted)
                for values, value in zip(found, (sum(min(k, large[g]) for g, k in small.items() if g in large), size, other, not (b or "").strip(" "))):
                    values.append(value)
            cells = [*[batch.column(c) for c in carried], *[pa.array(v, pa.int64()) for v in found[:3]], pa.array(found[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cells, names=[*carried, "__overlap", "__n", "__m", "empty"])

    p, r, f1 = prf(F.col("__overlap"), F.col("__n"), F.col("__m"))
    return given.mapInArrow(run, schema).select(key, f1.alias("f1"), p.alias("p"), r.alias("r"), "empty", *carried[1:])


def _known_counts(docs: DataFrame, key: str, text: str, n: int, known: DataFrame) -> DataFrame:
    """ngram_counts() of docs for the grams in known only, which is small, with size_left: all runs of the text."""
    shared = docs.sparkSession.sparkContext.broadcast({tuple(r["gram"].split(" ")) for r in known.collect()})
    given = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, counts, sizes = [], [], [], []
            for k, value in enumerate(batch.column("__text").to_pylist()):
                words = value.split() if value else []
                for gram, count in Counter(g for g in zip(*(words[i:] for i in range(n))) if g in shared.value).items():
                    rows.append(k)
                    grams.append(" ".join(gram))
                    counts.append(count)
                    sizes.append(len(words) - n + 1)
            cells = [batch.column("__key").take(pa.array(rows, pa.int64())), pa.array(grams, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["__key", "gram", "n", "size_left"])

    made = given.mapInArrow(run, f"__key {given.schema['__key'].dataType.simpleString()}, gram string, n long, size_left long")
    return made.withColumnRenamed("__key", key)


def rouge_pairs(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str = "text", n: int = 5, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """left_key, right_key, overlap, p, r, f1 of all pairs that share an n-gram; right is the reference.

    Where the reference's distinct n-grams are few and small enough to broadcast, only n-grams of left that it has leave the
    task that reads the text; otherwise those that it doesn't have are dropped in a join before any are paired. Keys are unique."""
    b = ngram_counts(right, right_key, text, n).withColumnRenamed("n", "n_right")
    known = b.select("gram").distinct()
    grams, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()
    if grams <= broadcast_grams and size <= BROADCAST_BYTES:
        a = _known_counts(left, left_key, text, n, known)
    else:
        a = ngram_counts(left, left_key, text, n).join(_totals(left, left_key, text, n, "size_left"), left_key)
    a = a.withColumnRenamed("n", "n_left")
    overlap = F.sum(F.least("n_left", "n_right")).cast("long").alias("overlap")
    shared = a.join(b, "gram").groupBy(left_key, right_key).agg(overlap, F.first("size_left").alias("size_left"))
    sized = shared.join(_totals(right, right_key, text, n, "size_right"), right_key)
    p, r, f1 = prf(F.col("overlap"), F.col("size_right"), F.col("size_left"))
    return sized.select(left_key, right_key, "overlap", p.alias("p"), r.alias("r"), f1.alias("f1"))


def report_by_level(scores: DataFrame, level: str = "level", by: list[str] | None = None) -> DataFrame:
    """Means over all pages and per level, pages scored and pages empty; 0.0 for a level without pages."""
    means = [F.coalesce(F.avg(F.when(F.col(level) == name, F.col("f1"))), F.lit(0.0)).alias(f"f1_{name}") for name in LEVELS]
    every = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_all") for c in ("f1", "p", "r")]
    made = scores.groupBy(*(by or [])).agg(*every, *means, F.count_if("empty").alias("n_empty"), F.count("*").alias("n_scored"))
    return made.orderBy(F.desc("f1_all"))


def with_missing(scores: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """A score for every page (key, level): pages that have none count as 0 and as empty."""
    joined = pages.join(scores.drop("level"), key, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("f1", "p", "r")}
    return joined.withColumns({**zero, "empty": F.coalesce("empty", F.lit(True))})


def with_published(report: DataFrame, rows: list[tuple], name: str = "method") -> DataFrame:
    """A report by method with rows of published numbers (method, all, simple, mid, hard) in percent of one, best first."""
    made = report.sparkSession.createDataFrame(rows, f"{name} string, f1_all double, f1_simple double, f1_mid double, f1_hard double")
    return report.select(*made.columns).unionByName(made).orderBy(F.desc("f1_all"), name)


def totals(results: DataFrame, seconds: float | None = None) -> DataFrame:
    """n_pages, n_failed, n_chunks, kept_bytes, and with seconds the pages a second: one row. Columns that are missing count as 0."""
    there = results.columns
    failed = F.count_if(F.col("error").isNotNull()) if "error" in there else F.lit(0).cast("long")
    chunks = F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long") if "n_chunks" in there else F.lit(0).cast("long")
    kept = F.coalesce(F.sum(F.octet_length("markdown")), F.lit(0)).cast("long") if "markdown" in there else F.lit(0).cast("long")
    made = results.agg(F.count("*").alias("n_pages"), failed.alias("n_failed"), chunks.alias("n_chunks"), kept.alias("kept_bytes"))
    return made.withColumn("pages_per_s", F.col("n_pages") / F.lit(seconds)) if seconds else made


def histogram(scores: DataFrame, value: str = "f1", bins: tuple[tuple[float, float], ...] = BINS) -> DataFrame:
    """bin, low, high, n and share of all pages; every bin has a row."""
    inside = [F.when((F.col(value) >= lo) & (F.col(value) < hi), k) for k, (lo, hi) in enumerate(bins)]
    counted = scores.select(F.coalesce(*inside).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = scores.agg(F.count("*").alias("total"))
    rows = scores.sparkSession.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(bins)], "bin int, low double, high double")
    joined = rows.join(counted, "bin", "left").join(F.broadcast(total))  # one row
    n = F.coalesce("n", F.lit(0))
    return joined.select("bin", "low", "high", n.cast("long").alias("n"), F.when(F.col("total") > 0, n / F.col("total")).otherwise(0.0).alias("share"))


def clean_rate(judged: DataFrame, clean: str, by: str) -> DataFrame:
    """Percentage of clean texts over all rows (group null) and per group."""
    sets = judged.groupingSets([[], [F.col(by)]], F.col(by))
    return sets.agg(F.grouping(by).cast("int").alias("is_total"), F.count("*").alias("n"), (F.avg(F.col(clean).cast("double")) * 100).alias("clean_pct"))


def observed(rows: DataFrame, name: str = "totals") -> tuple[DataFrame, Observation]:
    """rows, and an observation that has n_rows, n_errors and n_chars when an action on them has ended; no second pass."""
    seen = Observation(name)
    error = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    size = F.length("markdown") if "markdown" in rows.columns else F.lit(0)
    return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(error).alias("n_errors"), F.sum(size).alias("n_chars")), seen
