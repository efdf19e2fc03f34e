"""Line dedup with sharded cuckoo filters and exact reference-count tables.

A line's key is the line stripped of ASCII white space with A-Z lowered, known by its 128-bit xxh3
hash; keys of at least ten code points count. The reference table has a row for each key: the rows of documents that
hold it (n_rows), the smallest and the largest doc_id. Keys held by at least two documents are shared, and their lines
go from all documents but the smallest.

dedup() is the batch form: references are counted with map-side partial sums (a line that stands in a third of
all documents is one row per map task), and the shared keys go into one cuckoo filter per shard. Lines then meet

* the hot keys, those with at least one in HOT of all references, of which there are at most HOT: their exact rows are broadcast,
  so a line that stands in a third of all documents is decided where it is read;
* the filters, and behind them the exact table, which decides. While all filters together are below BROADCAST_BYTES they are broadcast,
  and only lines they don't rule out are joined with the exact table; beyond that, lines go to the shard of their key, where its
  filter and its part of the exact table stand. Both ways give the same rows.

Dropped line numbers meet their document by doc_id and text, so rows of equal doc_id and different texts keep their own.

LineStore keeps the same state over time: postings (key, doc_id) in segments that are written once, and per shard a cuckoo filter of
all keys held, so new documents' lines that no filter knows are new without a look at the exact table. Documents can be deleted
again: only segments that hold them are written anew, keys without postings leave the filter, and lines of the documents left are judged
anew. Small segments are merged, shards are doubled as keys become more, and tables that were replaced are deleted.

Nulls and ties: a null or empty text is one empty line; rows with equal doc_id are one document for the
counts and are each written; a null doc_id counts as smaller than all others; texts of any length and lines of any length are
taken whole; columns beside doc_id and text are not read; an empty table gives an empty result.
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
from .cuckoo import CuckooFilter

#: Code points of a key that counts; keys of a shard; bytes of all filters up to which they are broadcast; hot keys at most.
LEAST, SHARD_KEYS, BROADCAST_BYTES, HOT = 10, 1_000_000, 64_000_000, 10_000
#: Segments of a store's postings before small ones are merged.
SEGMENTS = 8
#: What tells a document's row: two rows that agree in all of it have the same lines.
_ROW = ["doc_id", "th", "tn"]
_NONE = -(2**63)


def keys_of(text: str | None) -> list[bytes | None]:
    """For each line its 16-byte key, None for lines that are too short to count."""
    keys: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip().lower()  # of bytes: ASCII only
        long = len(key) >= 4 * LEAST or len(key) >= LEAST and len(key.decode()) >= LEAST
        keys.append(xxhash.xxh3_128_digest(key) if long else None)
    return keys


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            own = {k for k in keys_of(text) if k}
            keys.extend(own)
            ids.extend([doc] * len(own))
        hi, lo = _halves(keys)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hi), pa.array(lo)], names=["doc_id", "hi", "lo"])


def _plain(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), F.xxhash64(text).alias("th"), F.octet_length(text).alias("tn"), "text")


def references(docs: DataFrame) -> DataFrame:
    """hi, lo, n_rows, first, last: the exact table of all keys."""
    keys = _plain(docs).select("doc_id", "text").mapInArrow(trimming(_distinct_keys), "doc_id long, hi long, lo long")
    return keys.groupBy("hi", "lo").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def filters(keys: DataFrame, shards: int) -> DataFrame:
    """shard, raw: a cuckoo filter for the keys of each shard. keys: hi, lo, each key once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            hi = batch.column("hi").to_numpy()
            for s in np.unique(shard).tolist():
                held.setdefault(s, []).append(hi[shard == s].view(np.uint64))
        names = sorted(held)
        raw = [CuckooFilter.of(np.concatenate(held[s])).dump() for s in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(raw, pa.binary())], names=["shard", "raw"])

    dealt = keys.select(F.pmod("lo", F.lit(shards)).cast("int").alias("shard"), "hi").repartition(shards, "shard")
    return dealt.mapInArrow(build, "shard int, raw binary")


def _lines(hot, known, shards: int):
    """Rows (doc_id, th, tn, line, hi, lo) of the lines that count and that the hot keys' exact rows or the filters (a broadcast, or
    None) don't decide. Lines with a hot key are in only if they are dropped, and then with null hi and lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = hot.value
        loaded = None if known is None else {s: CuckooFilter.load(raw) for s, raw in known.value.items()}
        for batch in batches:
            own, lines, keys, sure_own, sure_lines = [], [], [], [], []
            docs = batch.column("doc_id").to_pylist()
            for k, (doc, text) in enumerate(zip(docs, batch.column("text").to_pylist())):
                for n, key in enumerate(keys_of(text)):
                    if key is None:
                        continue
                    if key in first:
                        if doc > first[key]:
                            sure_own.append(k)
                            sure_lines.append(n)
                    else:
                        own.append(k)
                        lines.append(n)
                        keys.append(key)
            hi, lo = _halves(keys)
            keep = np.ones(len(lo), bool)
            if loaded is not None:
                shard = lo % shards
                for s in np.unique(shard).tolist():
                    at = np.flatnonzero(shard == s)
                    keep[at] = loaded[s].contains(hi[at].view(np.uint64)) if s in loaded else False
            rows = pa.array(np.concatenate([np.array(own, np.int64)[keep], np.array(sure_own, np.int64)]))
            none = [None] * len(sure_own)
            cells = [*[batch.column(c).take(rows) for c in _ROW], pa.array(np.concatenate([np.array(lines, np.int32)[keep], np.array(sure_lines, np.int32)]))]
            cells += [pa.concat_arrays([pa.array(x[keep]), pa.array(none, pa.int64())]) for x in (hi, lo)]
            yield pa.RecordBatch.from_arrays(cells, names=[*_ROW, "line", "hi", "lo"])

    return run


def _sharded(lines: DataFrame, shared: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """lines' rows of _ROW and line that are dropped: each shard's filter comes first, then its part of the exact table, then its lines."""
    shard = F.pmod("lo", F.lit(shards)).cast("int").alias("shard")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asked = lines.select(shard, F.lit(2).alias("step"), null("binary", "raw"), "hi", "lo", null("long", "first"), *_ROW, "line")
    exact = shared.select(shard, F.lit(1).alias("step"), null("binary", "raw"), "hi", "lo", "first", null("long", "doc_id"), null("long", "th"), null("int", "tn"), null("int", "line"))
    front = built.select("shard", F.lit(0).alias("step"), "raw", null("long", "hi"), null("long", "lo"), null("long", "first"), null("long", "doc_id"), null("long", "th"), null("int", "tn"), null("int", "line"))
    dealt = front.unionByName(exact).unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, front, rows = None, None, []
        table: tuple[np.ndarray, np.ndarray] | None = None
        kind = np.dtype([("hi", "<i8"), ("lo", "<i8")])
        for batch in batches:
            shards_, steps = batch.column("shard").to_numpy(), batch.column("step").to_numpy()
            edges = np.flatnonzero((np.diff(shards_) != 0) | (np.diff(steps) != 0)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(steps)]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if shards_[begin] != at:
                    at, front, rows, table = shards_[begin], None, [], None
                if steps[begin] == 0:
                    front = CuckooFilter.load(part.column("raw")[0].as_py())
                    continue
                keys = np.empty(len(part), kind)
                keys["hi"], keys["lo"] = part.column("hi").to_numpy(), part.column("lo").to_numpy()
                if steps[begin] == 1:
                    rows.append((keys, part.column("first").to_numpy()))
                    continue
                if front is None:  # no key of this shard is shared
                    continue
                if table is None:
                    keys_, firsts = (np.concatenate(x) for x in zip(*rows))
                    order = np.argsort(keys_)
                    table, rows = (keys_[order], firsts[order]), []
                maybe = np.flatnonzero(front.contains(np.ascontiguousarray(keys["hi"]).view(np.uint64)))
                place = np.minimum(np.searchsorted(table[0], keys[maybe]), len(table[0]) - 1)
                gone = maybe[(table[0][place] == keys[maybe]) & (part.column("doc_id").to_numpy()[maybe] > table[1][place])]
                yield part.select([*_ROW, "line"]).take(pa.array(gone))

    return dealt.mapInArrow(run, "doc_id long, th long, tn int, line int")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts, gone = [], [], []
        for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist()):
            lines = (text or "").split("\n")
            out = set(drops or ())
            counts.append(len(lines))
            gone.append(len(out))
            kept.append("\n".join(x for n, x in enumerate(lines) if n not in out) if out else text or "")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])


def resolve(docs: DataFrame, shared: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped. shared: hi, lo, first, n_rows of the shared keys, each once."""
    plain, context = _plain(docs), docs.sparkSession.sparkContext
    n, total = shared.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    shards, most_hot = max(8, -(-n // SHARD_KEYS)), max(1000, -(-total // HOT))
    pack = np.dtype("<i8")
    hot = {np.array([r["hi"], r["lo"]], pack).tobytes(): r["first"] for r in shared.where(F.col("n_rows") >= most_hot).collect()}
    hot = context.broadcast(hot)
    schema = "doc_id long, th long, tn int, line int, hi long, lo long"
    if n * 5 <= broadcast_bytes:  # a filter takes at most two bytes for each of 1 / 0.85 slots, rounded up to a power of two
        built = {r["shard"]: bytes(r["raw"]) for r in filters(shared, shards).collect()}
        maybe = plain.mapInArrow(trimming(_lines(hot, context.broadcast(built), shards)), schema)
        found = maybe.join(shared.select("hi", "lo", "first"), ["hi", "lo"], "left").where("hi IS NULL OR doc_id > first").select(*_ROW, "line")
    else:
        lines = plain.mapInArrow(trimming(_lines(hot, None, shards)), schema)
        found = lines.where("hi IS NULL").select(*_ROW, "line").unionByName(_sharded(lines.where("hi IS NOT NULL"), shared, filters(shared, shards), shards))
    drops = found.groupBy(*_ROW).agg(F.collect_set("line").alias("drops"))
    made = plain.join(drops, _ROW, "left").select("doc_id", "text", "drops").mapInArrow(_rebuilt, "doc_id long, text string, n_lines long, n_dropped long")
    return made.withColumn("doc_id", F.when(F.col("doc_id") != _NONE, F.col("doc_id")))


def dedup(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every document without the lines that an earlier one holds."""
    shared = references(docs).where(F.col("first") < F.col("last")).select("hi", "lo", "first", "n_rows")
    return resolve(docs, stored(shared, "line-references"), broadcast_bytes)


class LineStore:
    """The state of line dedup over time."""

    def __init__(self, spark: SparkSession, shards: int = 8, shard_keys: int = SHARD_KEYS):
        self.spark, self.shards, self.shard_keys = spark, shards, shard_keys
        self.segments: list[tuple[int, DataFrame]] = []  # rows, and hi, lo, doc_id: each posting in one segment
        self.filters = spark.createDataFrame([], "shard int, raw binary")

    @property
    def postings(self) -> DataFrame:
        found = self.spark.createDataFrame([], "hi long, lo long, doc_id long")
        for _, segment in self.segments:
            found = found.unionByName(segment)
        return found

    def _shard(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.pmod("lo", F.lit(self.shards)).cast("int").alias("shard"), "hi", "lo")

    def _segment(self, rows: DataFrame) -> None:
        made = stored(rows.select("hi", "lo", "doc_id"), "line-postings")
        n = made.count()
        self.segments.append((n, made))
        if len(self.segments) > SEGMENTS:  # the smaller half becomes one
            self.segments.sort(key=lambda s: -s[0])
            old = self.segments[SEGMENTS // 2 :]
            merged = old[0][1]
            for _, segment in old[1:]:
                merged = merged.unionByName(segment)
            self.segments[SEGMENTS // 2 :] = [(sum(k for k, _ in old), stored(merged, "line-postings"))]
            drop_table(self.spark, *[segment for _, segment in old])

    def _replace_filters(self, made: DataFrame) -> None:
        old, self.filters = self.filters, made
        drop_table(self.spark, old)

    def _rebuild(self) -> None:
        self._replace_filters(stored(filters(self.postings.select("hi", "lo").distinct(), self.shards), "line-filters"))

    def _change(self, keys: DataFrame, add: bool) -> None:
        """Keys go into the filters or out of them; if one overflows, all are made anew."""

        def change(key, pdf, held):
            hi = pdf["hi"].to_numpy(np.int64).view(np.uint64)
            now = CuckooFilter.load(held["raw"].iloc[0]) if len(held) else CuckooFilter(len(hi))
            raw = None
            if not add:
                now.delete(hi)
                raw = now.dump()
            elif now.insert(hi):
                raw = now.dump()
            return pd.DataFrame({"shard": [key[0]], "raw": [raw]})

        made = self._shard(keys).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(change, "shard int, raw binary")
        made = stored(made, "line-filters")
        if made.where("raw IS NULL").isEmpty():
            self._replace_filters(made)
        else:
            self._rebuild()
            drop_table(self.spark, made)

    def unknown(self, keys: DataFrame) -> DataFrame:
        """Of keys (hi, lo, each once) those that no document holds: the filters rule most out, the exact table decides on the rest."""

        def probe(key, pdf, held):
            pdf["maybe"] = CuckooFilter.load(held["raw"].iloc[0]).contains(pdf["hi"].to_numpy(np.int64).view(np.uint64)) if len(held) else False
            return pdf[["hi", "lo", "maybe"]]

        probed = self._shard(keys).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "hi long, lo long, maybe boolean")
        probed = stored(probed, "line-probes")
        new = probed.where("NOT maybe").select("hi", "lo")
        made = stored(new.unionByName(probed.where("maybe").select("hi", "lo").join(self.postings, ["hi", "lo"], "left_anti")), "line-new")
        drop_table(self.spark, probed)
        return made

    def insert(self, docs: DataFrame) -> None:
        """Adds documents; a doc_id that is held already gets the new lines beside its old ones."""
        keys = _plain(docs).select("doc_id", "text").mapInArrow(trimming(_distinct_keys), "doc_id long, hi long, lo long").select("hi", "lo", "doc_id").distinct()
        posted = stored(keys.join(self.postings, ["hi", "lo", "doc_id"], "left_anti"), "line-posted")
        new = self.unknown(posted.select("hi", "lo").distinct())
        self._segment(posted)
        if sum(n for n, _ in self.segments) > self.shards * self.shard_keys:  # postings are at least as many as keys
            wanted = -(-self.postings.select("hi", "lo").distinct().count() // self.shard_keys)
            while self.shards < wanted:
                self.shards *= 2
            self._rebuild()
        else:
            self._change(new, add=True)
        drop_table(self.spark, posted, new)

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes documents (doc_id) out again."""
        out = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id")).distinct()
        gone = stored(self.postings.join(out, "doc_id", "left_semi").select("hi", "lo").distinct(), "line-gone")
        kept = []
        for n, segment in self.segments:
            if segment.join(out, "doc_id", "left_semi").isEmpty():
                kept.append((n, segment))
                continue
            left = stored(segment.join(out, "doc_id", "left_anti").select("hi", "lo", "doc_id"), "line-postings")
            drop_table(self.spark, segment)
            kept.append((left.count(), left))
        self.segments = kept
        lost = stored(gone.join(self.postings, ["hi", "lo"], "left_anti"), "line-lost")
        self._change(lost, add=False)
        drop_table(self.spark, gone, lost)

    def references(self) -> DataFrame:
        return self.postings.groupBy("hi", "lo").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))

    def resolve(self, docs: DataFrame) -> DataFrame:
        """docs (all of them inserted before) without the lines that a smaller doc_id in the store holds."""
        shared = self.references().where(F.col("first") < F.col("last")).select("hi", "lo", "first", "n_rows")
        return resolve(docs, stored(shared, "line-references"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op9_lines": op9_lines}

ORACLE_SQL = {
    "op9_lines": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id > s.first AS dropped FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
}
