"""Token classifiers of blocks: blocks to token ids, chunks, padded batches, and predictions at the separators.

A page's blocks are tokenised one by one and packed into chunks (begin, block, separator, block, separator, ..., end). A
model gets batches of chunks of like length, padded on the right, and gives two numbers for each position; the larger one
at a block's separator is the block's prediction. A block without a separator in its chunk keeps 0.

TokenClassifier does that for one page and can be used wherever a classifier can. classify_pages() does it over a table:
chunks are sorted by length within their partitions, so batches waste little padding, and predictions meet their page again by
key. Tokenisers and models are made once for each Python worker.

Nulls: null blocks or a page without blocks have no predictions; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import slices
from ..functions.packing import MAX_TOKENS

#: ids and mask, each (chunks, positions), to scores (chunks, positions, labels).
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]
Tokenize = Callable[[str], list[int]]

SEPARATOR, MAX_BATCH_TOKENS = "<|sep|>", 16_384
#: Bytes of chunks that are lists of numbers at a time; more than most batches of a model.
CHUNK_BYTES = 4 << 20
#: Ids of the tokeniser without a vocabulary.
BEGIN, END, PAD, SEP, WORDS_FROM = 1, 2, 0, 3, 4


def word_ids(text: str) -> list[int]:
    """The tokeniser without a vocabulary: an id below 50,000 for each word, by its checksum."""
    return [WORDS_FROM + zlib.crc32(w.encode()) % (50_000 - WORDS_FROM) for w in text.split()]


@lru_cache(maxsize=4)
def vocabulary(path: str, separator: str = SEPARATOR) -> tuple[Tokenize, int]:
    """A tokeniser of the tokenizers library from a file, and its separator's id; the separator is added if it has none."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    if made.token_to_id(separator) is None:
        made.add_special_tokens([separator])
    return lambda text: made.encode(text, add_special_tokens=False).ids, made.token_to_id(separator)


def devices() -> list[str]:
    """The execution providers of this machine, the fastest first."""
    import onnxruntime

    there = onnxruntime.get_available_providers()
    return [p for p in ("CUDAExecutionProvider", "CoreMLExecutionProvider", "CPUExecutionProvider") if p in there]


@lru_cache(maxsize=4)
def onnx_model(path: str) -> Model:
    """A file with the inputs input_ids and attention_mask and scores as first output."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=devices())
    return lambda ids, mask: session.run(None, {"input_ids": ids, "attention_mask": mask})[0]


def long_blocks(least: int = 5) -> Model:
    """A stand-in without training: a block of so many tokens is main."""

    def score(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = np.zeros((*ids.shape, 2), np.float32)
        for row, chunk in enumerate(ids):
            begin = int(chunk[0] == BEGIN)
            for at in np.flatnonzero(chunk == SEP).tolist():
                out[row, at, int(at - begin >= least)] = 1
                begin = at + 1
        return out

    return score


def chunks_of(blocks: list[list[int]], sep: int, begin: int | None, end: int | None, max_tokens: int = MAX_TOKENS) -> list[tuple[list[int], list[int]]]:
    """Token ids and block numbers of each chunk, packed as functions.packing.pack() does."""
    edges = (begin is not None) + (end is not None)
    room, made, held, inside = max_tokens - edges, [], [], []
    for number, ids in enumerate(blocks):
        ids = [*ids[: room - 1], sep]
        if inside and len(held) + len(ids) > room:
            made.append((held, inside))
            held, inside = [], []
        held = held + ids
        inside = [*inside, number]
    if inside:
        made.append((held, inside))
    return [([begin] * (begin is not None) + ids + [end] * (end is not None), numbers) for ids, numbers in made]


def batches_of(lengths: list[int], max_batch_tokens: int = MAX_BATCH_TOKENS) -> Iterator[tuple[int, int]]:
    """Ranges of chunks that come in order of their lengths: chunks times the square of the longest stay within the square of the budget."""
    begin = 0
    for at, length in enumerate(lengths):
        if at > begin and (at - begin + 1) * length**2 > max_batch_tokens**2:
            yield begin, at
            begin = at
    if begin < len(lengths):
        yield begin, len(lengths)


def predicted(chunks: list[list[int]], model: Model, sep: int, pad: int = PAD) -> list[list[int]]:
    """The predictions at the separators of each chunk of one batch."""
    longest = max(map(len, chunks))
    ids, mask = np.full((len(chunks), longest), pad, np.int64), np.zeros((len(chunks), longest), np.int64)
    for row, chunk in enumerate(chunks):
        ids[row, : len(chunk)], mask[row, : len(chunk)] = chunk, 1
    best = np.asarray(model(ids, mask)).argmax(-1)
    return [best[row, np.flatnonzero((ids[row] == sep) & (mask[row] == 1))].tolist() for row in range(len(chunks))]


@dataclass(frozen=True)
class TokenClassifier:
    """tokenizer: a file, or None for word_ids(); model: a path of an ONNX file, or what makes a model; budgets in tokens."""

    model: str | Callable[[], Model] = long_blocks
    tokenizer: str | None = None
    separator: str = SEPARATOR
    begin: int | None = BEGIN
    end: int | None = END
    pad: int = PAD
    max_tokens: int = MAX_TOKENS
    max_batch_tokens: int = MAX_BATCH_TOKENS

    def __post_init__(self) -> None:
        if self.max_tokens < 4 or self.max_batch_tokens < 1:
            raise ValueError("a chunk needs room for four tokens and a batch for one")

    def parts(self) -> tuple[Tokenize, int, Model]:
        tokenize, sep = vocabulary(self.tokenizer, self.separator) if self.tokenizer else (word_ids, SEP)
        return tokenize, sep, onnx_model(self.model) if isinstance(self.model, str) else self.model()

    def chunks(self, blocks: list[str]) -> list[tuple[list[int], list[int]]]:
        tokenize, sep = vocabulary(self.tokenizer, self.separator) if self.tokenizer else (word_ids, SEP)
        return chunks_of([tokenize(b) for b in blocks], sep, self.begin, self.end, self.max_tokens)

    def __call__(self, blocks: list[str]) -> list[int]:
        _, sep, model = self.parts()
        made = sorted(self.chunks(blocks), key=lambda c: len(c[0]))
        out = [0] * len(blocks)
        for lo, hi in batches_of([len(ids) for ids, _ in made], self.max_batch_tokens):
            for (_, numbers), found in zip(made[lo:hi], predicted([ids for ids, _ in made[lo:hi]], model, sep, self.pad)):
                for number, value in zip(numbers, found):
                    out[number] = value
        return out


_CHUNK = pa.schema([("chunk", pa.int32()), ("ids", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int32())), ("n_tokens", pa.int32())])


def token_chunks(pages: DataFrame, key: str, blocks: str, classifier: TokenClassifier = TokenClassifier()) -> DataFrame:
    """key, chunk, ids, numbers (of its blocks), n_tokens: a row for each chunk of a page's blocks (array<string>). No shuffle."""
    given = pages.select(F.col(key).alias("__key"), F.col(blocks).alias("__blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows, cells = [], []
            for k, own in enumerate(batch.column("__blocks").to_pylist()):
                for n, (ids, numbers) in enumerate(classifier.chunks([b or "" for b in own or []])):
                    rows.append(k)
                    cells.append({"chunk": n, "ids": ids, "numbers": numbers, "n_tokens": len(ids)})
            made = pa.RecordBatch.from_pylist(cells, schema=_CHUNK)
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(rows, pa.int64())), *made.columns], names=["__key", *made.schema.names])

    return given.mapInArrow(run, f"__key {given.schema['__key'].dataType.simpleString()}, chunk int, ids array<int>, numbers array<int>, n_tokens int").withColumnRenamed("__key", key)


def predict_chunks(chunks: DataFrame, key: str, classifier: TokenClassifier = TokenClassifier(), partitions: int | None = None) -> DataFrame:
    """key, chunk, numbers, predictions: chunks of token_chunks() through the model, in batches of like length."""
    dealt = (chunks.repartition(partitions) if partitions else chunks).sortWithinPartitions("n_tokens", key, "chunk")
    given = dealt.select(F.col(key).alias("__key"), "chunk", "ids", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sep, model = classifier.parts()
        for batch in (part for whole in batches for part in slices(whole, CHUNK_BYTES)):
            chunks_ = batch.column("ids").to_pylist()
            found: list[list[int]] = []
            for lo, hi in batches_of([len(c) for c in chunks_], classifier.max_batch_tokens):
                found += predicted(chunks_[lo:hi], model, sep, classifier.pad)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("chunk"), batch.column("numbers"), pa.array(found, pa.list_(pa.int32()))], names=["__key", "chunk", "numbers", "predictions"])

    made = given.mapInArrow(run, f"__key {given.schema['__key'].dataType.simpleString()}, chunk int, numbers array<int>, predictions array<int>")
    return made.withColumnRenamed("__key", key)


def page_predictions(predictions: DataFrame, key: str, n_blocks: Column, pages: DataFrame) -> DataFrame:
    """pages with predictions: a number for each of a page's n_blocks blocks, 0 where no chunk has one."""
    pairs = F.filter(F.arrays_zip("numbers", "predictions"), lambda p: p["numbers"].isNotNull() & p["predictions"].isNotNull())
    found = predictions.groupBy(key).agg(F.map_from_entries(F.flatten(F.collect_list(pairs))).alias("__found"))
    n = F.coalesce(n_blocks, F.lit(0)).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    joined = pages.join(found, key, "left")
    return joined.withColumn("predictions", F.transform(numbers, lambda k: F.coalesce(F.try_element_at(F.col("__found"), k), F.lit(0)))).drop("__found")


def classify_pages(pages: DataFrame, key: str, blocks: str, classifier: TokenClassifier = TokenClassifier(), partitions: int | None = None) -> DataFrame:
    """pages with predictions for their blocks (array<string>); each page's key stands once."""
    return page_predictions(predict_chunks(token_chunks(pages, key, blocks, classifier), key, classifier, partitions), key, F.size(blocks), pages)


def marked_blocks(simplified: str, marker: str = "[BLOCK]") -> list[str]:
    """The pieces behind the block markers of a simplified page, for classifiers that read markers."""
    return [piece.strip() for piece in re.split(re.escape(marker), simplified)[1:]]


def classify_texts(texts: DataFrame, text: str, classifier: TokenClassifier = TokenClassifier(), batch: int = 32, max_tokens: int = 4096) -> DataFrame:
    """texts with label: 1 or 0 by the scores at a text's last token, of its first max_tokens tokens; an empty text is 0."""
    schema = texts.withColumn("label", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, sep, model = classifier.parts()
        for rows in batches:
            ids = [[*tokenize(t)[: max_tokens - 1], sep] if t and t.strip() else [] for t in rows.column(text).to_pylist()]
            order = sorted((k for k, own in enumerate(ids) if own), key=lambda k: len(ids[k]))
            found = [0] * len(ids)
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                for k, values in zip(some, predicted([ids[k] for k in some], model, sep, classifier.pad)):
                    found[k] = values[-1]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.int32())], names=[*rows.schema.names, "label"])

    return texts.mapInArrow(run, schema)
