"""Tokenising, packing, batching and predicting against plain versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.functions.packing import pack
from sievelight.operators import inference
from sievelight.plans.extract import Config, extract


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=12), st.integers(6, 24), st.booleans())
def test_chunks(sizes, budget, edges):
    blocks = [[100 + k] * n for k, n in enumerate(sizes)]
    begin, end = (1, 2) if edges else (None, None)
    made = inference.chunks_of(blocks, 3, begin, end, budget)
    assert [n for _, numbers in made for n in numbers] == list(range(len(blocks)))
    room = budget - 2 * edges
    for k, (ids, numbers) in enumerate(made):
        inner = ids[1:-1] if edges else ids
        assert len(ids) <= budget and inner.count(3) == len(numbers)
        assert inner == [x for n in numbers for x in [*blocks[n][: room - 1], 3]]
        if k:  # its first block had no room before
            assert len(made[k - 1][0]) - 2 * edges + min(len(blocks[numbers[0]]) + 1, room) > room


def test_packing_agrees(spark):
    """The native packing of lengths and the packing of ids make the same chunks."""
    sizes = [3, 0, 9, 40, 2, 2, 7, 1]
    native = spark.range(1).select(pack(F.array(*map(F.lit, sizes)), max_tokens=16).alias("c")).first()["c"]
    made = inference.chunks_of([[9] * n for n in sizes], 3, 1, 2, 16)
    assert [(list(c["blocks"]), c["tokens"]) for c in native] == [(numbers, len(ids)) for ids, numbers in made]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=30), st.integers(1, 100))
def test_batches(lengths, budget):
    lengths = sorted(lengths)
    ranges = list(inference.batches_of(lengths, budget))
    assert [k for lo, hi in ranges for k in range(lo, hi)] == list(range(len(lengths)))
    assert all(hi - lo == 1 or (hi - lo) * lengths[hi - 1] ** 2 <= budget**2 for lo, hi in ranges)


def odd_ids():
    """What makes a model by which a block is main if its first token's id is odd; made here, so that workers get it by value."""

    def make():
        def score(ids, mask):
            out = np.zeros((*ids.shape, 2))
            for row in range(len(ids)):
                first = 1
                for at in np.flatnonzero(ids[row] == 3):
                    out[row, at, 1] = ids[row, first] % 2 if first < at else -1
                    first = at + 1
            return out

        return score

    return make


def test_pages(spark):
    pages = [(k, [f"w{k}-{n} " * (n % 5 + 1) for n in range(k % 9)]) for k in range(40)] + [(90, None), (91, [""]), (92, ["a " * 100, "b"])]
    want = {k: [inference.word_ids(b)[0] % 2 if b.split() else 0 for b in blocks or []] for k, blocks in pages}
    classifier = inference.TokenClassifier(model=odd_ids(), max_tokens=20, max_batch_tokens=50)
    frame = spark.createDataFrame(pages, "page int, blocks array<string>").repartition(3)
    got = {r["page"]: list(r["predictions"]) for r in inference.classify_pages(frame, "page", "blocks", classifier, partitions=2).collect()}
    assert got == want
    assert all(classifier(list(blocks)) == want[k] for k, blocks in pages if blocks)
    assert inference.classify_pages(frame.limit(0), "page", "blocks", classifier).count() == 0
    chunks = inference.token_chunks(frame, "page", "blocks", classifier)
    assert chunks.where("n_tokens > 20 OR n_tokens <> size(ids)").isEmpty()


def test_batches_are_worked_on_in_slices(spark, monkeypatch):
    """The first rows leave a stage long before its batch is through, and all rows leave it in the end."""
    caught = []

    class Caught(Exception):
        pass

    def catch(self, function, schema):
        caught.append(function)
        raise Caught

    pages = spark.createDataFrame([], "page int, blocks array<string>")
    chunks = spark.createDataFrame([], "page int, chunk int, ids array<int>, numbers array<int>, n_tokens int")
    monkeypatch.setattr(type(pages), "mapInArrow", catch)
    for made in (lambda: inference.token_chunks(pages, "page", "blocks"), lambda: inference.predict_chunks(chunks, "page")):
        with pytest.raises(Caught):
            made()
    monkeypatch.undo()
    blocks = [["word " * 20_000] for _ in range(64)]
    batch = pa.RecordBatch.from_pydict({"__key": list(range(64)), "__blocks": blocks})
    found = list(caught[0](iter([batch])))
    assert sum(b.num_rows for b in found) == 64 and max(b.num_rows for b in found) * 100_000 <= inference.slices.__defaults__[0]
    ids = pa.array([[5] * 50_000 + [3]] * 64, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([0] * 64, pa.int32()), ids, pa.array([[0]] * 64, pa.list_(pa.int32()))], names=["__key", "chunk", "ids", "numbers"])
    found = list(caught[1](iter([batch])))
    assert sum(b.num_rows for b in found) == 64 and max(b.num_rows for b in found) * 200_000 <= inference.CHUNK_BYTES
    assert all(p == [1] for b in found for p in b.column("predictions").to_pylist())


def test_real_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    classifier = inference.TokenClassifier(tokenizer=public.path("byte_bpe_50k.json"), begin=None, end=None)
    tokenize, sep = inference.vocabulary(classifier.tokenizer)
    assert sep == inference.vocabulary(classifier.tokenizer)[1] and sep not in tokenize("a <p> b")
    [(ids, numbers)] = classifier.chunks(["hello world", "again"])
    assert ids == [*tokenize("hello world"), sep, *tokenize("again"), sep] and numbers == [0, 1]
    made = extract(spark.createDataFrame([(1, "<p>one two three four five six seven</p><p>x</p>")], "page_id int, html string"), Config(classifier=inference.TokenClassifier()))
    assert made.first()["labels"] == {"1": "main", "2": "other"}
    with pytest.raises(ValueError):
        inference.TokenClassifier(max_tokens=2)
    assert inference.devices()[-1] == "CPUExecutionProvider"
    assert inference.marked_blocks("<html><p [BLOCK] _item_id=1>a</p><p [BLOCK] _item_id=2>b") == ["_item_id=1>a</p><p", "_item_id=2>b"]


def test_texts(spark):
    rows = spark.createDataFrame([(1, "a " * 6), (2, "a"), (3, ""), (4, None), (5, "b " * 5000)], "k int, t string")
    got = {r["k"]: r["label"] for r in inference.classify_texts(rows, "t", batch=2).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
