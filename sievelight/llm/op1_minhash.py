"""MinHash near-dedup: universal hash minima, banding, verification on full sets, connected components.

1. Every document's set of word shingles is hashed to 64 bits; the band keys of its 288 minima under multiply-add hashes, its size
   and a 128-bit fingerprint of the set are kept. Rows with equal fingerprints are one class. A class goes on as one head with the
   smallest of its doc_ids, so copies never meet in pairs.
2. Bands of six minima put heads into buckets. At a similarity of 0.8, two sets share none of the 48 bands once
   in two million times.
3. Stars: each bucket's members are paired with its smallest member, and the pairs checked on full sets. The links' components
   are labels.
4. Rest: in a bucket whose members still have different labels, members of different labels may yet be linked. There, the members
   outside the most frequent label are compared with all members, on full sets and in tiles of bounded size. A tile gives
   links that span all links in it. Members of one label need no more comparing.
5. The components of all links, by alternating large-star and small-star.

Members of a bucket are never gathered in one place: minima come from partial sums, hot buckets learn their smallest member by a
broadcast of bounded size, a smallest member's set is copied for every PARTNERS partners, and large buckets are dealt out in
tiles. Full sets are read for documents with a partner only.

Words, shingles and threshold are parameters; the defaults are the operator's own (five words, 0.8).

Nulls and ties: a null or empty text or one without words has size 0 and is linked with nothing; texts of any length are taken whole; a
null doc_id counts as the smallest, and as one id; rows of equal doc_id, copies or not, are one document, which has the links of
all its rows, whatever the partitions; columns beside doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, stored, table, trimming
from .components import components, hot_join

#: Words of a shingle, least similarity in hundredths.
WORDS, PERCENT = 5, 80
BANDS, ROWS = 48, 6
#: Members of one side of a tile, and shingles of their sets; columns of its incidence matrix at once; partners of a copy of a set.
TILE, TILE_ITEMS, COLUMNS, PARTNERS = 512, 1_000_000, 4096, 500
_NONE = -(2**63)
_DRAW = np.random.Generator(np.random.PCG64(20_240_601))
_MULTIPLY = _DRAW.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64, endpoint=False) | np.uint64(1)
_ADD = _DRAW.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64, endpoint=False)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    found = text.encode().lower().split() if text else []  # of bytes: A-Z, and ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    width = min(words, len(hashes))
    mixed = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k : len(hashes) - width + 1 + k]) * _C1
        mixed ^= mixed >> np.uint64(29)
    mixed *= _C2
    return np.unique(mixed ^ mixed >> np.uint64(32))


def minima(values: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for lo in range(0, len(values), 128):  # so that a chunk stays in the cache
        part = values[lo : lo + 128, None] * _MULTIPLY
        part += _ADD
        np.minimum(out, part.min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, his, los, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingles(text, words)
                sizes.append(len(values))
                if not len(values):
                    his.append(None)
                    los.append(None)
                    bands.append(None)
                    continue
                hi, lo = _fingerprint(values)
                his.append(hi)
                los.append(lo)
                signature = minima(values)
                bands.append([xxhash.xxh3_64_intdigest(signature[k * ROWS : k * ROWS + ROWS].tobytes(), seed=k) - 2**63 for k in range(BANDS)])
            cells = [batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "th", "n", "hi", "lo", "bands"])

    return run


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, his, los = [], [], []
            for text in batch.column("text").to_pylist():
                values = shingles(text, words)
                hi, lo = _fingerprint(values)
                raw.append(values.tobytes())
                his.append(hi)
                los.append(lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(raw, pa.binary())], names=["doc", "hi", "lo", "items"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _head(prefix: str) -> list:
    return [F.col(c).alias(prefix + c) for c in ("doc", "hi", "lo")]


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v of those pairs that are linked. pairs: two heads, u_ and v_, and m, at least the partners of v_ that have as many or fewer. A pair's first
    set travels with it, to where one of the copies of the second one is."""
    copies = F.ceil(F.col("m") / PARTNERS).cast("int")
    first = pairs.join(sets.select(*_head("u_"), F.col("items").alias("x")), ["u_doc", "u_hi", "u_lo"])
    first = first.withColumn("copy", F.pmod(F.xxhash64("u_doc", "u_hi"), copies))
    wanted = pairs.groupBy("v_doc", "v_hi", "v_lo").agg(F.max("m").alias("m"))
    second = sets.select(*_head("v_"), F.col("items").alias("y")).join(wanted, ["v_doc", "v_hi", "v_lo"])
    second = second.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1))).drop("m")
    both = first.join(second, ["v_doc", "v_hi", "v_lo", "copy"]).select(F.col("u_doc").alias("u"), F.col("v_doc").alias("v"), "x", "y")
    return both.mapInArrow(trimming(_confirmed(percent)), "u long, v long")


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one partition, sorted by the columns in by, group by group."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        frame = batch.to_pandas()
        if held and all(held[-1][c].iloc[-1] == frame[c].iloc[0] for c in by):
            pass
        elif held:
            yield pd.concat(held, ignore_index=True)
            held = []
        change = np.zeros(len(frame), bool)
        for c in by:
            values = frame[c].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(frame)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo and held:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(frame.iloc[lo:hi])
    if held:
        yield pd.concat(held, ignore_index=True)


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets in left with those in right, from the items that more than one set has."""
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    edge = np.concatenate([[True], items[1:] != items[:-1]])
    column = np.cumsum(edge) - 1
    common = np.bincount(column)[column] > 1
    owner, column = owner[common], column[common]
    total = np.zeros((len(left), len(right)), np.int32)
    if not len(column):
        return total
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    for lo in range(0, int(column[-1]) + 1, COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        total += (part[left] @ part[right].T).astype(np.int32)
    return total


def _tiled(percent: int):
    """Of each tile, links that span all links between its sides. Side 0 are members of a bucket outside its most frequent
    label, side 1 members of any label; members of one label are linked already."""

    def pairs(group: pd.DataFrame) -> tuple[list[int], list[int]]:
        doc, label, size, side = (group[c].to_numpy() for c in ("doc", "label", "n", "side"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        us: list[int] = []
        vs: list[int] = []
        if not len(left) or not len(right) or (label[left][:, None] == label[right]).all():
            return us, vs
        common = _overlaps([np.frombuffer(x, np.uint64) for x in group["items"]], left, right)
        both = size[left][:, None] + size[right]
        i, j = np.nonzero((100 * common.astype(np.int64) >= percent * (both - common)) & (label[left][:, None] != label[right]))
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(left[i].tolist(), right[j].tolist()):
            a, b = top(int(label[x])), top(int(label[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                us.append(int(doc[x]))
                vs.append(int(doc[y]))
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "p", "q"]):
            u, v = pairs(group)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links u, v between members of different labels. members: key, doc, hi, lo, n of buckets of three or more."""
    labelled = members.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")
    labelled = stored(labelled, "minhash-labelled")
    # Of every bucket with several labels: the most frequent one, and how many members and shingles it and the others have.
    per = labelled.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    per = per.groupBy("key").agg(F.max(F.struct("c", "label", "s")).alias("most"), F.sum("c").alias("n"), F.sum("s").alias("s"), F.count("*").alias("labels")).where("labels > 1")
    slices = lambda rows, items: F.greatest(F.ceil(rows / TILE), F.ceil(items / TILE_ITEMS)).cast("int")
    per = per.select("key", F.col("most.label").alias("most"), "n", slices(F.col("n"), F.col("s")).alias("slices"), slices(F.col("n") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("other_slices"))
    per = stored(per, "minhash-mixed")
    mixed = hot_join(labelled, per, "key", labelled.count())
    own = lambda n: F.pmod(F.xxhash64("doc", "hi"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    head = ["key", "doc", "hi", "lo", "n", "label"]
    left = mixed.where("label <> most").select(*head, F.lit(0).alias("side"), own("other_slices").alias("p"), all_of("slices").alias("q"))
    right = mixed.select(*head, F.lit(1).alias("side"), all_of("other_slices").alias("p"), own("slices").alias("q"))
    tiles = left.unionByName(right).join(sets, ["doc", "hi", "lo"]).select("key", "p", "q", "side", "doc", "n", "label", "items")
    return tiles.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(trimming(_tiled(percent)), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = stored(plain.mapInArrow(trimming(_signed(words)), "doc_id long, th long, n long, hi long, lo long, bands array<long>"), "minhash")
    filled = signed.where("n > 0")
    classes = stored(filled.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")), "minhash-classes")
    # Heads are known by their doc_id and their set: a doc_id may be the first of several classes.
    heads = filled.withColumnRenamed("doc_id", "doc").join(classes.select(F.col("first").alias("doc"), "hi", "lo"), ["doc", "hi", "lo"], "left_semi")
    heads = stored(heads.dropDuplicates(["doc", "hi", "lo"]), "minhash-heads")
    # A key holds its band's number, through its seed.
    members = heads.select("doc", "hi", "lo", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min(F.struct("doc", "hi", "lo", "n")).alias("center"), F.count("*").alias("n")).where("n > 1")
    buckets = stored(buckets.withColumn("m", F.col("n")), "minhash-buckets")
    members = stored(hot_join(members.withColumnRenamed("n", "size"), buckets, "key", BANDS * heads.count()).withColumnRenamed("size", "n"), "minhash-members")

    # Of a head's texts one is read again: rows are known by their id and their text's hash.
    partners = heads.join(members.select("doc", "hi", "lo").distinct(), ["doc", "hi", "lo"], "left_semi").select("doc", "th")
    texts = plain.withColumnRenamed("doc_id", "doc").join(partners, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"])
    sets = stored(texts.mapInArrow(trimming(_sets(words)), "doc long, hi long, lo long, items binary"), "minhash-sets")
    likely = members.where((F.col("doc") != F.col("center.doc")) & (100 * F.least("n", "center.n") >= percent * F.greatest("n", "center.n")))
    stars = likely.select(*_head("u_"), *[F.col(f"center.{c}").alias(f"v_{c}") for c in ("doc", "hi", "lo")], "m")
    stars = stored(stars.groupBy([c for c in stars.columns if c != "m"]).agg(F.max("m").alias("m")), "minhash-stars")
    links = _confirm(stars, sets, percent)
    # Classes of one doc_id are linked through it.
    several = filled.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("a"), F.max(F.struct("hi", "lo")).alias("b")).where("a <> b").select("doc_id")
    several = stored(several, "minhash-repeated")
    if not several.isEmpty():
        firsts = filled.select("doc_id", "hi", "lo").join(several, "doc_id", "left_semi").join(classes.select("hi", "lo", "first"), ["hi", "lo"])
        links = links.unionByName(firsts.select(F.col("doc_id").alias("u"), F.col("first").alias("v")).where("u <> v"))
    links = stored(links, "minhash-links")
    labels = stored(components(links), "minhash-labels")
    links = links.unionByName(_rest(members.where("m > 2").select("key", "doc", "hi", "lo", "n"), labels, sets, percent))
    drop_table(spark, labels)
    labels = stored(components(links), "minhash-labels")
    drop_table(spark, heads, members, sets, stars, buckets)

    # A document has its class's component, which is its own id unless the class or its head have others.
    merged = classes.join(labels.withColumnRenamed("node", "first"), "first", "left").where("size > 1 OR component <> first")
    merged = merged.select("hi", "lo", F.coalesce("component", "first").alias("class_component"))
    found = signed.select("doc_id", "n", "hi", "lo").join(merged, ["hi", "lo"], "left")
    component = F.coalesce("class_component", "doc_id")
    null = lambda c: F.when(c != _NONE, c)
    return found.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(component).alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


QUERIES = {"op1_minhash": op1_minhash}

ORACLE_SQL = {
    "op1_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.c >= 80 * (a.n + b.n - c.c)),
ties AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM w UNION SELECT reach.d, ties.y FROM reach JOIN ties ON reach.r = ties.x),
least AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, w.doc_id = l.component_id AS kept
FROM w JOIN least l ON l.d = w.doc_id LEFT JOIN sizes s USING (doc_id)
"""
}
