"""Token-ID / binary output: documents as ids of a public tokenizer, in a compressed and checksummed file format.

write() sorts the documents by doc_id over the whole table, tokenises them, puts an end id behind each, and writes the
ids of about GROUP ids at a time as one group: a row of a Parquet table (Spark commits its files, so lost executors and
repeated tasks leave no trace) with

    part, seq   place of the group: groups in order of (part, seq) hold the documents in order of doc_id
    n_docs, n_tokens
    docs        the documents' index: for each int64 doc_id, uint8 null flag and uint32 ids, as three arrays
    blocks      range_coder blocks of up to 131,072 ids; a document may run over any number of blocks

read() needs only the table. Blocks are independent of each other and carry a crc32; a damaged one raises an error.

Pieces are cached: texts are cut, many at a time, where the tokenizer's own splitting always cuts too (_cuts()), and equal pieces of
some texts are looked up once. A piece goes to the tokenizer only if it is in neither of a worker's two caches (of CACHE pieces and what
the next texts bring; the older one is dropped when the newer one is full). Texts with the tokenizer's special strings go to it whole,
as do all texts for a tokenizer that splits in another way.

A worker holds a group's ids and the coder's arrays for AT_ONCE of them, whatever the size of its partition; a single
document that is longer than a group adds its own ids.

Nulls and ties: a null text is empty and has the end id only; null doc_ids come first; rows of equal doc_id are in order of
their texts, and only those whose texts begin alike have to meet in one task; texts of any length are taken whole; columns beside doc_id
and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import range_coder
from .common import new_table, table, trim

#: Pieces of each of a worker's two caches, bytes of a piece that is kept at most, bytes of texts that are tokenised together.
TOKENIZER, END_ID, CACHE, KEPT_PIECE, TOGETHER = "byte_bpe_50k.json", 2, 300_000, 60, 8_000_000
#: Bytes that are classified at once (ids are put together for an eighth as many pieces), new pieces that go to the tokenizer in one text: more leave a core's cache.
STEP, JOINED = 1 << 17, 100
#: Ids of a group.
GROUP = range_coder.AT_ONCE
TABLE = "part int, seq int, n_docs int, n_tokens long, docs binary, blocks array<binary>"
_PLAIN = re.compile(r" ?\S+(?:\n ?\S+)*+").fullmatch
#: How the tokenizers library describes the splitting that _cuts() follows.
_SPLITS = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
#: Classes of bytes: white space, letters, digits, other visible ASCII. Bytes without a class are cut from nothing but white space and a character behind it.
_SPACE, _LETTER, _DIGIT, _OTHER = 1, 2, 4, 8
_KNOWN = _LETTER | _DIGIT | _OTHER


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[33:127] = _OTHER
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = _LETTER
    out[list(b" \t\n\x0b\x0c\r")] = _SPACE
    return out


_CLASS = _classes()
#: First bytes of two that always make a letter: U+0100 to U+02BF and U+0400 to U+047F; those of U+00C0 to U+00FF but two.
_LETTERS = np.isin(np.arange(256), [*range(0xC4, 0xCB), 0xD0, 0xD1])


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of UTF-8 texts begin that the tokenizer's own splitting cuts apart too. starts: where texts begin.

    Its pieces are runs of letters, of digits or of other characters, each with a space before it, and runs of white space whose
    last character goes to what follows. The letters after an apostrophe can belong to it."""
    out = np.empty(len(data), bool)
    for lo in range(0, len(data), STEP):
        hi = min(len(data), lo + STEP)
        begin = max(0, lo - 2)
        some = data[begin : hi + 2]
        kind = _CLASS.take(some)
        lead = np.flatnonzero(some[:-1] >= 0xC3)
        if len(lead):
            first, second = some.take(lead), some.take(lead + 1)
            lead = lead[np.where(first == 0xC3, (second != 0x97) & (second != 0xB7), _LETTERS.take(first))]
            kind[lead] = kind[lead + 1] = _LETTER
        space, known = kind == _SPACE, (kind & _KNOWN) != 0
        here, text = kind[1:], some[:-1]
        cut = here != kind[:-1]
        cut &= known[1:]
        cut &= kind[:-1] != 0
        cut &= text != 32
        cut &= (text != 39) | (here != _LETTER)
        cut |= space[1:] & known[:-1]
        after = known[1:].copy()  # a known character of the same text follows
        a, b = np.searchsorted(starts, (begin + 1, begin + len(some)))
        after[starts[a:b] - begin - 1] = False
        cut[:-1] |= space[1:-1] & after[1:]
        out[lo:hi] = np.concatenate([[True], cut])[lo - begin : hi - begin]
    out[starts[starts < len(data)]] = True
    return out


def _gathered(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[f : f + c] of each f, c one after the other, and where each of them begins, with the end."""
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(ends[-1], flat.dtype)
    for lo in range(0, len(first), STEP // 8):
        hi = min(len(first), lo + STEP // 8)
        at = np.repeat(first[lo:hi] - ends[lo:hi], count[lo:hi])
        at += np.arange(ends[lo], ends[hi])
        out[ends[lo] : ends[hi]] = flat.take(at)
    return out, ends


class _Cache:
    """Rows of ids: row k has count[k] of the flat ids, from first[k] on. rows: the row of a piece."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.flat, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """The row of each piece, or -1."""
        return np.fromiter(map(self.rows.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        """Ids of pieces, one after the other; long pieces get a row that is not found again."""
        at = len(self.count)
        kept = np.fromiter(map(len, pieces), np.int64, len(pieces)) <= KEPT_PIECE
        self.rows.update(itertools.compress(zip(pieces, range(at, at + len(pieces))), kept.tolist()))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.flat, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.count, count])


class Tokens:
    """A tokenizer with a cache of pieces; ids come as little-endian uint32."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.cache, self.older = Tokenizer.from_file(path), cache, _Cache(), _Cache()
        self.cuts = str(self.tokenizer.pre_tokenizer) == _SPLITS and self.tokenizer.normalizer is None
        #: The strings that the tokenizer takes out of a text before it splits it.
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self._encoded(["\n"])[0]
        self.mark = int(mark[0]) if len(mark) == 1 and self.cuts else None

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces and how many each has. Some pieces go to the tokenizer in one text, a line each, if no line has white space
        but a space at its start: a line break between such pieces is always an id of its own, which no piece has."""
        flat, count = [], []
        for lo in range(0, len(new), JOINED):
            some = new[lo : lo + JOINED]
            text = b"\n".join(some).decode()
            if self.mark is not None and text.count("\n") == len(some) - 1 and _PLAIN(text) and not any(x in text for x in self.special):
                ids = self._encoded([text])[0]
                marks = np.flatnonzero(ids == self.mark)
                if len(marks) != len(some) - 1:
                    raise ValueError("pieces and their ids do not match")
                count.append(np.diff(marks, prepend=-1, append=len(ids)) - 1)
                flat.append(np.delete(ids, marks))
            else:
                flat += (own := self._encoded([p.decode() for p in some]))
                count.append(np.array([len(x) for x in own]))
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([np.zeros(0, np.int64), *count])

    def _known(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of some different pieces where its ids begin and how many they are. Pieces that neither cache has are encoded."""
        own, old = self.cache, self.older
        row = own.find(pieces)
        lost = np.flatnonzero(row < 0)
        names = [pieces[k] for k in lost.tolist()]
        was = old.find(names)  # pieces that are met again before the new cache is full move into it
        met, new = np.flatnonzero(was >= 0), np.flatnonzero(was < 0)
        row[lost[np.concatenate([met, new])]] = len(own.count) + np.arange(len(lost))
        own.add([names[k] for k in met.tolist()], _gathered(old.flat, old.first.take(was[met]), old.count.take(was[met]))[0], old.count.take(was[met]))
        names = [names[k] for k in new.tolist()]
        own.add(names, *self._pieces(names))
        if len(own.rows) > self.most or len(own.flat) > 10 * self.most:
            self.cache, self.older = _Cache(), own
        count = own.count.take(row)
        ids, ends = _gathered(own.flat, own.first.take(row), count)
        return ids, ends[:-1], count

    def all_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, none of them null, one after the other, and where those of each text begin, with the end."""
        texts = pa.concat_arrays([texts.cast(pa.large_binary())])  # from offset 0
        starts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
        n = int(starts[-1])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8, n)
        if self.cuts:
            cut = _cuts(data, starts)
            for special in self.special:
                for k in np.flatnonzero(pc.match_substring(texts, special).to_numpy(False)).tolist():  # goes to the tokenizer whole
                    cut[starts[k] + 1 : starts[k + 1]] = False
            begins = np.flatnonzero(cut)
        else:
            begins = np.unique(starts[:-1][starts[:-1] < n])
        offsets = pa.py_buffer(np.append(begins, n).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        flat, first, count = self._known(coded.dictionary.to_numpy(False).tolist())
        which = coded.indices.to_numpy()
        ids, ends = _gathered(flat, first.take(which), count.take(which))
        return ids, ends.take(np.searchsorted(begins, starts))

    def ids(self, text: str) -> bytes:
        return self.all_ids(pa.array([text], pa.string()))[0].tobytes()


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The worker's one tokenizer for a file, with what its cache holds from earlier tasks."""
    if path not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coded(batches: Iterator[pa.RecordBatch], tokens: Tokens) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and ids of the rows, some texts at a time."""

    def together() -> Iterator[tuple[int | None, bytes]]:
        docs = [doc for part in held for doc in part.column("doc_id").to_pylist()]
        ids, ends = tokens.all_ids(pa.concat_arrays([part.column("text") for part in held]))
        yield from zip(docs, (ids[a:b].tobytes() for a, b in itertools.pairwise(ends.tolist())))

    held, size = [], 0
    for batch in batches:
        lo, sizes = 0, pc.binary_length(batch.column("text")).to_pylist()
        for k, n in enumerate(sizes, 1):
            size += n
            if size >= TOGETHER:
                held.append(batch.slice(lo, k - lo))
                yield from together()
                held, size, lo = [], 0, k
        held.append(batch.slice(lo))
    if held:
        yield from together()


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes docs (doc_id, text) to a new table at path. tokenizer: a file, by default the public one on each executor."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Ranges are cut between texts of one doc_id too, by their first characters, in the order of the sort.
    placed = given.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 24)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = tokens_of(tokenizer or tokenizer_path()), np.array([end_id], "<u4").tobytes()
        part, seq, ids, raws, held = TaskContext.get().partitionId(), 0, [], [], 0

        def group() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(raws), "<u4")
            known = np.array([i is not None for i in ids], np.uint8)
            index = np.array([i or 0 for i in ids], "<i8").tobytes() + known.tobytes() + np.array([len(r) // 4 for r in raws], "<u4").tobytes()
            coded_blocks = range_coder.encode([flat[i : i + range_coder.BLOCK] for i in range(0, len(flat), range_coder.BLOCK)])
            cells = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([index], pa.binary()), pa.array([coded_blocks], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(cells, names=["part", "seq", "n_docs", "n_tokens", "docs", "blocks"])

        for doc, raw in coded(batches, tokens):
            raw += end
            if held and held + len(raw) // 4 > GROUP:
                yield group()
                seq, ids, raws, held = seq + 1, [], [], 0
                trim()
            ids.append(doc)
            raws.append(raw)
            held += len(raw) // 4
        if ids:
            yield group()
        trim()

    placed.mapInArrow(run, TABLE).write.parquet(path)


def _documents(row_docs: bytes, n_docs: int, blocks: list[bytes]) -> Iterator[tuple[int | None, np.ndarray]]:
    ids = np.frombuffer(row_docs, "<i8", n_docs)
    known = np.frombuffer(row_docs, np.uint8, n_docs, 8 * n_docs)
    sizes = np.frombuffer(row_docs, "<u4", n_docs, 9 * n_docs)
    flat = np.concatenate(range_coder.decode(blocks))
    at = 0
    for doc, is_known, n in zip(ids.tolist(), known.tolist(), sizes.tolist()):
        yield doc if is_known else None, flat[at : at + n]
        at += n


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """part, seq, n (place in the group), doc_id, before (ids before it in the group), n_tokens and its ids, or with digest their crc32."""
    last = ("ids_crc32", pa.int64(), "ids_crc32 long") if digest else ("ids", pa.list_(pa.int64()), "ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, before, sizes, values, at = [], [], [], [], 0
                for doc, ids in _documents(row["docs"], row["n_docs"], row["blocks"]):
                    docs.append(doc)
                    before.append(at)
                    sizes.append(len(ids))
                    at += len(ids)
                    values.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64))
                n = len(docs)
                cells = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(docs, pa.int64()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, last[1])]
                yield pa.RecordBatch.from_arrays(cells, names=["part", "seq", "n", "doc_id", "before", "n_tokens", last[0]])
                trim()

    stored = spark.read.schema(TABLE).parquet(path).select("part", "seq", "n_docs", "docs", "blocks")
    return stored.mapInArrow(run, f"part int, seq int, n int, doc_id long, before long, n_tokens long, {last[2]}")


def placed(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """read() with start: the ids of all documents before."""
    # One narrow row for each group of some million ids.
    groups = spark.read.schema(TABLE).parquet(path).select("part", "seq", "n_tokens")
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("part", "seq", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    return read(spark, path, digest).join(groups, ["part", "seq"]).withColumn("start", F.col("base") + F.col("before"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path)
    return placed(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op8_tokens": op8_tokens}
ORACLE_SQL: dict[str, str] = {}
