"""Embedding near-dedup by iterative quantisation and multi-index hashing.

Vectors are centred and rotated to balanced binary codes: principal directions of a bounded sample, then rounds that alternate between codes
and the rotation that fits them best (Procrustes). Several tables hold the vectors by label and by the values of some bits of
their codes, each table by other bits. Within an entry, pairs whose codes differ in at most a third of their bits are
reranked by the cosine of the original vectors in double precision; a pair counts in the first table in which it meets.

The bits of a table grow with the logarithm of the largest label's vectors, so an entry holds about ENTRY vectors at any size and
the pairs compared grow as the vectors do; the number of tables grows with the bits, so that a pair at the threshold, whose
codes differ in one bit of sixteen, still shares an entry of some table 19 times in 20. Each length of vectors has its own
index; lengths with few vectors are compared as a whole.

Entries are compared in tiles of bounded size, so a label or a value that holds a third of all rows is dealt over many
tasks; which entries are hot is broadcast for a bounded number of them. Pairs are never written out: a tile gives each member its number of
links there, and edges that span its links. Vectors equal in direction are one class; its members are counted, not paired.

The rotation is learned from at most SAMPLE vectors of a length, those with the smallest hashes, and at most SAMPLE_BYTES. Every vector is indexed.
Recall against brute force is measured in the tests; links below the threshold are never returned.

Nulls and ties: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with
nothing. A null vec_id counts as the smallest. Repeated vec_ids are one node of the components; each of their rows has its own links. Columns
beside vec_id, embedding and label are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, stored, table
from .components import components, hot_join
from .op1_minhash import runs

#: Least cosine; vectors and bytes of the sample that a rotation is learned from; rounds; bits of a code at most.
COSINE, SAMPLE, SAMPLE_BYTES, ROUNDS, BITS = 0.98, 20_000, 48_000_000, 30, 64
#: Vectors of an entry that tables are planned for; vectors of a length up to which they are one entry; members of one side of a tile.
ENTRY, FEW, TILE = 64, 500, 256
#: Share of bits that agree in the codes of two vectors at the threshold.
AGREE = 0.936
_NONE = -(2**63)


def learn(sample: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that (x - mean) @ projection > 0 are the bits of x."""
    mean = sample.mean(0)
    centred = sample - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    basis = directions[:, ::-1][:, :bits]
    flat = centred @ basis
    rotation, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((basis.shape[1], basis.shape[1])))
    for _ in range(rounds):
        signs = np.where(flat @ rotation > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(flat.T @ signs)
        rotation = u @ vt
    return mean, basis @ rotation


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def plan(vectors: int, bits: int) -> list[list[int]]:
    """The bits of each table, for so many vectors of the largest label."""
    wide = min(bits, max(6, (vectors // ENTRY).bit_length()))
    tables = max(4, int(np.ceil(3 / AGREE**wide)))
    draw, out, left = np.random.default_rng(11), [], []
    for _ in range(tables):  # all bits are used before one is used again
        while len(left) < wide:
            left += [x for x in draw.permutation(bits).tolist() if x not in left]
        out.append(sorted(left[:wide]))
        left = left[wide:]
    return out


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, raw): length and label, and the unit vector in doubles; null if it can't be linked."""
    for batch in batches:
        raws, labels = [], []
        for vector, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist()):
            raw = None
            if label is not None and vector and None not in vector:
                x = np.array(vector, np.float64)
                if np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()  # against overflow
                    raw = (x / np.sqrt((x * x).sum())).tobytes()
            raws.append(raw)
            labels.append(None if raw is None else f"{len(vector)}:{label}")
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(labels, pa.string()), pa.array(raws, pa.binary())], names=["id", "label", "raw"])


def _coded(shared):
    """Adds the code and each table's value; for lengths without a model one entry for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            codes: list[bytes] = [b""] * len(raws)
            keys: list[list[int]] = [[0]] * len(raws)
            widths = np.array([len(r) // 8 for r in raws], np.int64)
            for width in np.unique(widths).tolist():
                if width not in shared.value:
                    continue
                mean, projection, tables = shared.value[width]
                at = np.flatnonzero(widths == width)
                bits = (_matrix(pd.Series([raws[k] for k in at])) - mean) @ projection > 0
                values = np.stack([bits[:, t] @ (1 << np.arange(len(t), dtype=np.int64)) for t in tables], 1)
                for k, code, own in zip(at.tolist(), np.packbits(bits, 1), values.tolist()):
                    codes[k], keys[k] = code.tobytes(), own
            cells = [*[batch.column(c) for c in ("id", "label", "raw", "h", "size")], pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "label", "raw", "h", "size", "code", "keys"])

    return run


_ENTRY = ["entry", "label", "place", "value"]


def _linked(least: float):
    """Per tile: rows (u, h, v null, n): links of u's class, the vector with hash h, to others; rows (u, 0, v, 0): edges that span the links."""
    ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, [*_ENTRY, "p", "q"]):
            ids, hashes, sizes, place = group["id"].to_numpy(), group["h"].to_numpy(), group["size"].to_numpy(), int(group["place"].iloc[0])
            vectors = _matrix(group["raw"])
            codes = np.frombuffer(b"".join(group["code"]), np.uint8).reshape(len(group), -1)
            keys = np.stack(group["keys"].to_numpy())
            side = group["side"].to_numpy()
            one = group["p"].iloc[0] == group["q"].iloc[0]
            left = np.flatnonzero(side == 0)
            right = left if one else np.flatnonzero(side == 1)
            counts, us, vs = np.zeros(len(group), np.int64), [], []
            parent = list(range(len(group)))

            def top(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for lo in range(0, len(left), 128):
                a = left[lo : lo + 128]
                near = vectors[a] @ vectors[right].T >= least
                if one:
                    near &= a[:, None] < right
                i, j = np.nonzero(near)
                x, y = a[i], right[j]
                ok = ones[codes[x] ^ codes[y]].sum(1) * 3 <= codes.shape[1] * 8
                ok &= (keys[x] == keys[y]).argmax(1) == place
                x, y = x[ok], y[ok]
                np.add.at(counts, x, sizes[y])
                np.add.at(counts, y, sizes[x])
                for s, t in zip(x.tolist(), y.tolist()):
                    s, t = top(s), top(t)
                    if s != t:
                        parent[max(s, t)] = min(s, t)
                        us.append(ids[s])
                        vs.append(ids[t])
            some = np.flatnonzero(counts)
            u = np.concatenate([ids[some], np.array(us, np.int64)])
            v = pa.array([*[None] * len(some), *vs], pa.int64())
            h, n = (np.concatenate([x[some], np.zeros(len(us), np.int64)]) for x in (hashes, counts))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(h, pa.int64()), v, pa.array(n, pa.int64())], names=["u", "h", "v", "n"])

    return run


def _models(classes: DataFrame, sample: int) -> dict[int, tuple]:
    """By length: mean, projection, and the bits of each table. Lengths with few vectors have none."""
    width = (F.octet_length("raw") / 8).cast("int").alias("width")
    largest = classes.groupBy(width, "label").agg(F.count("*").alias("n")).groupBy("width").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    made = {}
    for r in largest.where(F.col("most") > FEW).orderBy("width").collect():  # one row for each length of vectors
        n = max(1, min(sample, SAMPLE_BYTES // (8 * r["width"])))
        share = min(1.0, 1.2 * n / r["n"] + 100 / r["n"])
        place = F.col("h") / 2.0**64 + 0.5
        rows = classes.where((width == r["width"]) & (place <= share)).select("h", "raw").collect()
        raws = [raw for _, raw in sorted((x["h"], bytes(x["raw"])) for x in rows)[:n]]
        mean, projection = learn(_matrix(pd.Series(raws)), bits=min(r["width"], BITS))
        made[r["width"]] = (mean, projection, plan(r["most"], projection.shape[1]))
    return made


def near_vectors(given: DataFrame, least: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of given (vec_id, embedding, label)."""
    spark = given.sparkSession
    plain = given.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NONE)).alias("id"), "embedding", F.col("label").cast("string").alias("label"))
    rows = stored(plain.mapInArrow(_usable, "id long, label string, raw binary"), "vectors")
    classes = rows.where("raw IS NOT NULL").groupBy("label", "raw").agg(F.min("id").alias("head"), F.count("*").alias("size"))
    classes = stored(classes.withColumn("h", F.xxhash64("raw")), "vector-classes")
    shared = spark.sparkContext.broadcast(_models(classes, sample))
    coded = classes.select(F.col("head").alias("id"), "label", "raw", "h", "size").mapInArrow(_coded(shared), "id long, label string, raw binary, h long, size long, code binary, keys array<long>")
    coded = stored(coded, "vector-codes")
    entries = coded.select("id", "label", "h", F.posexplode("keys").alias("place", "value")).withColumn("entry", F.xxhash64("label", "place", "value"))
    counts = stored(entries.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1").withColumn("m", F.col("n")), "vector-entries")
    tables = coded.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()[0]
    slim = hot_join(entries, counts, "entry", tables)
    slices = F.ceil(F.col("m") / TILE).cast("int")
    slim = slim.withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("id", "h"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    slim = slim.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    order = [*_ENTRY, "p", "q"]
    tiles = slim.select("id", "h", *order, "side").join(coded, ["id", "h", "label"])
    tiles = tiles.select(*order, "side", "id", "h", "size", "raw", "code", "keys").repartition(*order).sortWithinPartitions(*order)
    found = stored(tiles.mapInArrow(_linked(least), "u long, h long, v long, n long"), "vector-links")
    labels = components(found.where("v IS NOT NULL").select("u", "v"))
    drop_table(spark, coded, counts)
    outside = found.where("v IS NULL").groupBy("u", "h").agg(F.sum("n").alias("outside"))
    merged = classes.join(outside.withColumnRenamed("u", "head"), ["head", "h"], "left").join(labels.withColumnRenamed("node", "head"), "head", "left")
    merged = merged.select("label", "raw", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("links"), F.coalesce("component", "head").alias("class_component")).where("links > 0")
    made = rows.join(merged, ["label", "raw"], "left")
    component = F.coalesce("class_component", "id")
    null = lambda c: F.when(c != _NONE, c)
    return made.select(null(F.col("id")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), null(component).alias("component_id"), (component == F.col("id")).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embeddings": op10_embeddings}

ORACLE_SQL = {
    "op10_embeddings": r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT reach.d, links.y FROM reach JOIN links ON reach.r = links.x),
least AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.d = e.vec_id LEFT JOIN counts c ON c.x = e.vec_id
"""
}
