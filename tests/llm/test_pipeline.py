"""Each stage of the pipeline against a plain version on the smallest tables, each on what the one before it kept, and run() against all."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import regex
import zstandard
from test_near_duplicates import brute
from tokenizers import Tokenizer

import corpus_pipeline
from sievelight.llm import op4_language, op5_mixing, op7_decontaminate
from sievelight.llm.op7_decontaminate import words_of
from sievelight.tables import stored


def plain_language(text: str | None, model: list) -> tuple[str, float]:
    """Language and margin by compressing the text's letters with each dictionary anew."""
    words = regex.findall(r"\p{L}+", (text or "").lower())
    if not words:
        return "und", 0.0
    whole, sizes = (" " + " ".join(words) + " ").encode(), []
    for rank, (lang, _, content) in enumerate(model):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(op4_language.LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=20)
        known.precompute_compress(compression_params=settings)
        coder = zstandard.ZstdCompressor(dict_data=known, compression_params=settings)
        sizes.append((sum(len(coder.compress(bytes(64) + whole[k : k + op4_language.PIECE])) for k in range(0, len(whole), op4_language.PIECE)), rank, lang))
    sizes.sort()
    return sizes[0][2], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def plain_decontamination(texts: dict, items: dict) -> dict:
    """The texts that stay: without full windows, long matches, two items, or hits for more than half of the words."""
    grams = lambda words, n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    windows = {name: grams(words, 8) for name, words in items.items()}
    brief = {tuple(words) for words in items.values() if 0 < len(words) < 8}
    long = set().union(*(grams(words, 13) for words in items.values()))
    every = set().union(*windows.values())
    kept = {}
    for doc, text in texts.items():
        words = words_of(text)
        cut = {p for k in range(len(words) - 7) if tuple(words[k : k + 8]) in every for p in range(k, k + 8)}
        hit = cut | {p for n in {len(b) for b in brief} for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in brief for p in range(k, k + n)}
        if grams(words, 13) & long or sum(bool(grams(words, 8) & w) for w in windows.values()) >= 2 or len(hit) > len(words) / 2:
            continue
        raw, out, at = (text or "").encode(), b"", 0
        places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        for k, (begin, end) in enumerate(places):
            if k not in cut:
                out += raw[at:end]
            elif k - 1 not in cut:
                out += raw[at:begin]
            at = end
        kept[doc] = text if not cut else (out + raw[at:]).decode()
    return kept


def test_decontamination_stage(spark):
    """Windows that stand alone are cut, and a short item drops nothing."""
    import random

    rnd = random.Random(3)
    items = {"1": [f"a{k}" for k in range(30)], "2": [f"b{k}" for k in range(12)], "3": ["yes"], "4": ["new", "york"]}
    filler = [f"f{k}" for k in range(40)] + ["yes", "new", "york"]
    texts = {}
    for doc in range(120):
        words = rnd.choices(filler, k=rnd.randrange(0, 60))
        for _ in range(rnd.randrange(0, 3)):
            item = items[rnd.choice(["1", "1", "2"])]
            n = rnd.randrange(5, 15)
            at = rnd.randrange(max(1, len(item) - n + 1))
            place = rnd.randrange(len(words) + 1)
            words[place:place] = item[at : at + n]
        texts[doc] = "".join(rnd.choice([w, w.upper()]) + rnd.choice([" ", ", ", "\n", " – "]) for w in words)
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in texts.items()], "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame([(int(k), " ".join(words)) for k, words in items.items()], "item_id long, text string")
    want = plain_decontamination(texts, {k: [w.encode() for w in words] for k, words in items.items()})
    assert any(want[d] != texts[d] for d in want) and len(want) < len(texts)
    for shard_words in (1000, 10):
        got = op7_decontaminate.clean(docs, op7_decontaminate.shards(bench, shard_words=shard_words)).collect()
        assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources", "token ids"]
    for name, stage in corpus_pipeline.STAGES:
        docs_before = docs
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "mixing sources":
            source_of = {r["doc_id"]: r["source"] for r in docs.collect()}
            wanted = {r["source"]: r["target"] for r in op5_mixing.targets(op5_mixing.sizes(docs)).collect()}
        docs = stored(stage(spark, docs, data), "test")
        rows = docs.collect()
        after = Counter(r["doc_id"] for r in rows)
        if name != "token ids":
            assert docs.columns == columns
        if name == "language ID":
            model = op4_language.learn(docs_before.where(~op4_language.held_out()))
            judged = {d: plain_language(t, model) for d, t in before.items()}
            assert set(after) == {d for d, (lang, margin) in judged.items() if lang != "und" and margin >= op4_language.LEAST_MARGIN}
            assert len(after) >= 0.97 * len(before)
        elif name == "MinHash near-dedup":
            _, roots = brute(before, 5)
            assert set(after) == {d for d, root in roots.items() if d == root}
        elif name == "benchmark decontamination":
            items = {str(r["item_id"]): words_of(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
            want = plain_decontamination(before, items)
            assert {r["doc_id"]: r["text"] for r in rows} == want and len(want) < len(before)
        elif name == "mixing sources":
            size = {d: len((t or "").split()) for d, t in before.items()}
            assert max(after.values()) <= 2 and set(after) <= set(before)
            # Sizes rise along a source, and the copies up to any place are off by less than one: so is the sum by less than
            # the largest size, and a little for the order within a class.
            for source, target in wanted.items():
                own = {d for d, s in source_of.items() if s == source}
                assert abs(sum(size[d] * after[d] for d in own) - target) <= 1.1 * max(size[d] for d in own)
            texts = sorted((r["doc_id"], r["text"]) for r in rows)
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            at, want = 0, []
            for doc, text in texts:
                n = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
                want.append((doc, at, n))
                at += n
            assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in rows) == sorted(want)
        seen[name] = len(rows)
    assert seen["token ids"] == seen["mixing sources"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(map(tuple, rows))


def test_no_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data), "test")
        assert docs.count() == 0, name
