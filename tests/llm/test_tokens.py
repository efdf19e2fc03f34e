from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievelight.llm import op8_tokens, range_coder


@pytest.mark.parametrize(("sizes", "high"), [([1, 5, 70, 300], 50), ([0, 3, 0, 9000], 50_000), ([2000, 10], 2**32 - 1), ([], 5), ([0], 5)])
def test_round_trip(sizes, high):
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, high, n, dtype=np.uint32) for n in sizes]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    if high < 2**16:  # a block's bytes don't depend on the blocks beside it
        assert all(range_coder.encode([b])[0] == c and np.array_equal(range_coder.decode([c])[0], b) for b, c in zip(blocks, coded))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=400), max_size=4))
def test_any_blocks(blocks):
    given_ = [np.array(b, np.uint32) for b in blocks]
    assert all(np.array_equal(a, b) for a, b in zip(given_, range_coder.decode(range_coder.encode(given_)), strict=True))


def test_text_like_ids_beat_zstandard():
    rng = np.random.default_rng(5)
    words = [rng.zipf(1.3, rng.integers(1, 4)) % 20_000 for _ in range(3000)]
    ids = np.concatenate([words[k % 3000] for k in rng.zipf(1.4, 150_000)])[: range_coder.BLOCK + 5000].astype(np.uint32)
    blocks = [ids[: range_coder.BLOCK], ids[range_coder.BLOCK :]]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    assert len(coded[0]) < len(zstandard.compress(blocks[0].astype("<u2").tobytes(), 3))


def test_carries_and_repeats():
    blocks = [np.full(5000, 7, np.uint32), np.tile(np.arange(50, dtype=np.uint32), 160), np.array([65535, 0] * 500, np.uint32)]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    assert len(coded[1]) < len(blocks[1])  # under a byte an id: repeats are predicted


def test_damage_is_found():
    coded = range_coder.encode([np.arange(500, dtype=np.uint32)])[0]
    for bad in (coded[:-2], b"????" + coded[4:], coded[:40] + bytes([coded[40] ^ 1]) + coded[41:], coded[:8]):
        with pytest.raises(ValueError):
            range_coder.decode([bad])


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sX 1\n\t\x0b\x1c\x85 　é<|>endoftx,.\r字"), max_size=40))
def test_pieces_equal_whole_texts(text):
    tokens = test_pieces_equal_whole_texts.__dict__.setdefault("tokens", op8_tokens.Tokens(op8_tokens.tokenizer_path(), cache=50))
    want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.ids(text), "<u4").tolist() == want


def test_files(spark, docs, nothing, tmp_path):
    for k, frame in enumerate((docs, nothing)):
        op8_tokens.write(frame, str(tmp_path / str(k)))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    tokenizer = Tokenizer.from_file(op8_tokens.tokenizer_path())
    want, at = [], 0
    for known, doc, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in op8_tokens.placed(spark, str(tmp_path / "0")).orderBy("start").collect()]
    assert got == want
    assert set(spark.read.parquet(str(tmp_path / "0")).columns) == {"part", "seq", "n_docs", "n_tokens", "docs", "blocks"}
    ids = op8_tokens.read(spark, str(tmp_path / "0")).where("doc_id = 2").first()["ids"]
    assert ids == tokenizer.encode("one", add_special_tokens=False).ids + [2]
    assert op8_tokens.placed(spark, str(tmp_path / "1")).count() == 0


def test_a_document_longer_than_a_group(spark, tmp_path, monkeypatch):
    rows = [(1, "a b"), (2, " ".join(f"w{k}" for k in range(40_000))), (3, None)]
    op8_tokens.write(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).coalesce(1), str(tmp_path / "long"), None, 2)
    tokenizer = Tokenizer.from_file(op8_tokens.tokenizer_path())
    got = {r["doc_id"]: r["ids"] for r in op8_tokens.read(spark, str(tmp_path / "long")).collect()}
    assert got == {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    blocks = [np.arange(range_coder.BLOCK, dtype=np.uint32) % 997] * 3  # more than are coded at once
    monkeypatch.setattr(range_coder, "AT_ONCE", range_coder.BLOCK)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(range_coder.encode(blocks)), strict=True))


def test_known_pieces_do_not_go_to_the_tokenizer_again(monkeypatch):
    tokens = op8_tokens.Tokens(op8_tokens.tokenizer_path())
    for text in ("one two.", "one, two", "\none"):
        tokens.ids(text)
    sent = []
    monkeypatch.setattr(tokens, "_encoded", lambda texts, real=tokens._encoded: sent.extend(texts) or real(texts))
    text = "one two, two.\none two"
    assert np.frombuffer(tokens.ids(text), "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert not sent


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sre 1\n\t\r\x1c\x85\xa0é×Ж́字 .,-"), max_size=30) | st.just("a<|endoftext|> b"), max_size=12), st.sampled_from([8, 24, 1 << 17]))
def test_texts_together_equal_texts_alone(texts, step):
    tokens = test_texts_together_equal_texts_alone.__dict__.setdefault("tokens", op8_tokens.Tokens(op8_tokens.tokenizer_path(), cache=50))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(op8_tokens, "STEP", step)
        ids, at = tokens.all_ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
