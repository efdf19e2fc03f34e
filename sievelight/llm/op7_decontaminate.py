"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items are normalised to words and put into one suffix automaton over word ids. A
document's words run through it; at each word the automaton gives the longest run of words that
ends there and stands in some item. Where that length reaches the window (or the whole of an item that
is shorter), the window's words are hit, and the automaton's state gives the items. matched() reports spans and items;
remove_spans() cuts the hit words of a text, or drops the text beyond a coverage limit; clean() drops documents that match
an item over length words on end, hold windows of limit items or are covered too far, and cuts shorter spans out of the others.

An automaton is held in arrays: about 150 bytes a word of its items, and 400 at the very most. It is built on the driver from
at most shard_words words (one item may be longer), so it takes some 100 MB at most there, in a broadcast and in a worker, whatever
the size of the benchmark: a larger one is split by item into shards. Only one shard's items and automaton exist at a time; what
it finds is written, its broadcast destroyed, and the documents run through the next one. Documents are never shuffled for one
shard; for more, their spans meet by row.

Nulls: a null text has no words; an item without words is in no document; rows that repeat, also by doc_id alone, are judged
one by one; very long texts are run through word by word like others; an empty benchmark hits nothing; the item of a null
item_id counts like any other and is written as an empty string. matched() reads doc_id and text only, clean() keeps all columns.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, stored, table, trimming

#: Words of a window; items that must occur before a document counts as contaminated; words of one automaton.
WINDOW, LIMIT, SHARD_WORDS = 8, 2, 250_000
#: Words on end that make a document go wholly, and the share of its words beyond which hit words do.
LENGTH, COVERAGE = 13, 0.5
#: Bytes that are not part of words become spaces, A-Z become a-z.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Over all items. A state's first transition stands in arrays, as most states have one only; further ones in a dictionary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.names = window, [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.link, self.length, self.word, self.to = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in items]
        for words in coded:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # top[state]: the state of the last window words of the state's runs; -1 if its runs are shorter.
        self.top = array("i", [-1]) * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[state] >= window:
                up = self.top[self.link[state]]
                self.top[state] = state if up < 0 else up
        #: Items of windows by top state, and of whole shorter items by state; an item alone stands for itself.
        self.windows: dict[int, int | frozenset[int]] = {}
        self.whole: dict[int, int | frozenset[int]] = {}
        self.brief = set()
        for item, words in enumerate(coded):
            if 0 < len(words) < window:
                self.brief.add(item)
                state = 0
                for word in words:
                    state = self._step(state, word)
                self._note(self.whole, state, item)
            state = size = 0
            for word in words if len(words) >= window else ():
                state, size = self._step(state, word), size + 1
                if size >= window:
                    self._note(self.windows, self.top[state], item)
        # ends[state]: the nearest state up the links, itself included, where a shorter item ends; 0 for none.
        self.ends = array("i", [0]) * (len(self.link) if self.whole else 0)
        if self.whole:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.ends[state] = state if state in self.whole else self.ends[self.link[state]]

    @staticmethod
    def _note(held: dict[int, int | frozenset[int]], state: int, item: int) -> None:
        old = held.get(state)
        held[state] = item if old is None or old == item else frozenset({item} | ({old} if isinstance(old, int) else old))

    def _step(self, state: int, word: int) -> int:
        """The next state; 0 for none, as no transition leads to the root."""
        if self.word[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return more.get(word, 0) if more else 0

    def _put(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _state(self, length: int) -> int:
        self.link.append(0)
        self.length.append(length)
        self.word.append(-1)
        self.to.append(-1)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        known = self._step(last, word)
        if known:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, at = self._state(self.length[last] + 1), last
        while at >= 0 and not self._step(at, word):
            self._put(at, word, new)
            at = self.link[at]
        if at >= 0:
            target = self._step(at, word)
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _split(self, at: int, word: int, target: int) -> int:
        clone = self._state(self.length[at] + 1)
        self.word[clone], self.to[clone], self.link[clone] = self.word[target], self.to[target], self.link[target]
        if target in self.more:
            self.more[clone] = dict(self.more[target])
        self.link[target] = clone
        while at >= 0 and self._step(at, word) == target:
            self._put(at, word, clone)
            at = self.link[at]
        return clone

    def run(self, words: list[bytes], brief: bool = True) -> tuple[list[tuple[int, int]], set[int], int]:
        """The hit spans [from, to) of words, in order and merged, the items that occur, and the longest match. brief: whether
        whole items of fewer words than a window count."""
        ids, link, length, first, to, more, window, top = self.ids, self.link, self.length, self.word, self.to, self.more, self.window, self.top
        ends = self.ends if brief else ()
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = size = longest = 0
        for at, name in enumerate(words):
            word = ids.get(name)
            if word is None:
                state = size = 0
                continue
            while True:
                if first[state] == word:
                    after = to[state]
                    break
                after = more[state].get(word, 0) if state in more else 0
                if after or not state:
                    break
                state = link[state]
                size = length[state]
            if not after:
                size = 0
                continue
            state = after
            size += 1
            if size > longest:
                longest = size
            reach = 0
            if size >= window:
                self._add(items, self.windows[top[state]])
                reach = size
            if ends:
                end = ends[state]
                while end:
                    if length[end] <= size:
                        self._add(items, self.whole[end])
                        reach = max(reach, length[end])
                    end = ends[link[end]]
            if reach:
                start = at + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, items, longest

    @staticmethod
    def _add(items: set[int], who: int | frozenset[int]) -> None:
        items.update((who,) if isinstance(who, int) else who)


class Shards:
    """The benchmark (item_id, text) as automata of at most about shard_words words each, built one at a time by build()."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS):
        self.benchmark, self.window = benchmark, window
        rough = F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / 2) + 1)
        self.n = max(1, -(-int(benchmark.agg(rough).first()[0] or 0) // shard_words))

    def build(self, k: int) -> SuffixAutomaton:
        own = F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(0)), "text"), F.lit(self.n)) == k
        part = self.benchmark.where(own) if self.n > 1 else self.benchmark
        rows = part.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").collect()
        return SuffixAutomaton(sorted((r["item"], words_of(r["text"])) for r in rows), self.window)


def shards(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Shards:
    return Shards(benchmark, window, shard_words)


def matched(docs: DataFrame, automata: Shards) -> DataFrame:
    """docs' doc_id and text with n_words, spans (hit words [from, to)), items (sorted as strings)."""
    schema = "doc_id long, text string, n_words long, spans array<struct<a:int,b:int>>, items array<string>"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def runner(shared):
        kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                counts, spans, items = [], [], []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    hit, who, _ = automaton.run(words)
                    counts.append(len(words))
                    spans.append([{"a": a, "b": b} for a, b in hit])
                    items.append(sorted({automaton.names[i] for i in who}))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text").cast(pa.string()), pa.array(counts, pa.int64()), pa.array(spans, kind.field("spans").type), pa.array(items, kind.field("items").type)], schema=kind)

        return run

    spark = docs.sparkSession
    if automata.n == 1:
        return docs.mapInArrow(runner(spark.sparkContext.broadcast(automata.build(0))), schema)
    # Rows get a key of their own, as doc_id may repeat; spans and items of all shards meet there.
    keyed = stored(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    found = None
    for k in range(automata.n):
        shared = spark.sparkContext.broadcast(automata.build(k))
        one = keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(runner(shared), schema).drop("text")
        one = stored(one.where("size(items) > 0"), "decontaminate-shard")
        shared.destroy()
        found = one if found is None else found.unionByName(one)

    def merge(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["b"], F.lit(-1)) >= x["a"]), joined).otherwise(F.concat(acc, F.array(x)))

    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    empty = F.array().cast("array<struct<a:int,b:int>>")
    per = found.groupBy("doc_id").agg(spans.alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per = per.select(F.col("doc_id").alias("row"), F.aggregate("all", empty, merge).alias("spans"), "items")
    counts = keyed.mapInArrow(_count, "row long, doc_id long, text string, n_words long")
    return counts.join(per, "row", "left").select("doc_id", "text", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("text"), pa.array(n, pa.int64())], names=["row", "doc_id", "text", "n_words"])


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))


def remove_spans(docs: DataFrame, automata: list[SuffixAutomaton], coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text, n_hit: the hit words cut from each text, with what stands between them; a text of which more
    than coverage of the words are hit goes wholly (text null)."""

    def cut(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            texts = []
            for text, spans, n in zip(pdf["text"], pdf["spans"], pdf["n_words"]):
                hits = [(s["a"], s["b"]) for s in spans]
                total = sum(b - a for a, b in hits)
                texts.append(None if text is None or n and total > coverage * n else _without(text, hits))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "n_hit": [sum(s["b"] - s["a"] for s in x) for x in pdf["spans"]]})

    return matched(docs, automata).mapInPandas(cut, "doc_id long, text string, n_hit long")


def clean(docs: DataFrame, automata: Shards, length: int = LENGTH, limit: int = LIMIT, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, without those that match an item over length words on end, hold full windows of
    limit items, or have hit words for more than coverage of their words. From the texts of rows that stay, full windows are cut;
    an n_chars column follows the text. Whole items shorter than a window count for the coverage only, and are not cut.

    What an automaton finds in a row travels with the row to the next one, so nothing is shuffled."""
    pairs, strings = "array<struct<a:int,b:int>>", "array<string>"
    names = docs.columns
    carried = {"__hits": pairs, "__cuts": pairs, "__items": strings}

    def runner(shared, last):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                keep, texts, state = [], [], {c: [] for c in carried}
                before = zip(*(batch.column(c).to_pylist() for c in carried))
                for text, (hits, cuts, items) in zip(batch.column("text").to_pylist(), before):
                    words = words_of(text)
                    full, who, longest = automaton.run(words, brief=False)
                    every = automaton.run(words)[0] if automaton.brief else full
                    hits, cuts = (_merged([(s["a"], s["b"]) for s in old] + new) for old, new in ((hits, every), (cuts, full)))
                    items = sorted({*items, *(automaton.names[i] for i in who)})
                    # Later automata only add words and items, so a row over a limit goes at once.
                    keep.append((longest < length or not full) and len(items) < limit and sum(b - a for a, b in hits) <= coverage * len(words))
                    texts.append(_without(text, cuts) if last and keep[-1] and cuts else text)
                    for c, value in zip(carried, (hits, cuts, items)):
                        state[c].append(value if c == "__items" else [{"a": a, "b": b} for a, b in value])
                if last:
                    changed = [len(new) if new is not old and new != old else -1 for new, old in zip(texts, batch.column("text").to_pylist())]
                    batch = _replaced(batch, "text", texts)
                    if "n_chars" in names:
                        batch = _replaced(batch, "n_chars", [old if n < 0 else n for n, old in zip(changed, batch.column("n_chars").to_pylist())])
                    batch = batch.select(names)
                else:
                    for c in carried:
                        batch = _replaced(batch, c, state[c])
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    spark = docs.sparkSession
    found = docs.withColumns({c: F.array().cast(kind) for c, kind in carried.items()})
    for k in range(automata.n):
        last = k == automata.n - 1
        shared = spark.sparkContext.broadcast(automata.build(k))
        after = found.mapInArrow(trimming(runner(shared, last)), docs.schema if last else found.schema)
        if not last:
            after = stored(after, "decontaminate-shard")
            shared.destroy()
            if k:
                drop_table(spark, found)
        found = after
    return found


def _replaced(batch: pa.RecordBatch, column: str, values: list) -> pa.RecordBatch:
    at = batch.schema.get_field_index(column)
    return batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw, out, at = text.encode(), [], 0
    places = [m.span() for m in _WORD.finditer(raw)]
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    automata = shards(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    found = matched(table(spark, sf_dir, "documents"), automata)
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= LIMIT).alias("contaminated"),
    )


QUERIES = {"op7_decontaminate": op7_decontaminate}

ORACLE_SQL = {
    "op7_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.i, g.n, v.item FROM grams g JOIN windows v USING (n, gram)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.list, '')) AS items_sha256, coalesce(i.n_items, 0) >= 2 AS contaminated
FROM dw d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
}
