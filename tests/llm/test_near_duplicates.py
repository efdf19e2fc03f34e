from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from sievelight.llm import op1_minhash, op10_embeddings
from sievelight.llm.components import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    proper = [(a, b) for a, b in edges if a != b]
    want = roots({n for e in proper for n in e}, proper)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute(texts: dict, words: int):
    sets = {}
    for doc, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, roots(sets, links)


def check(spark, texts: dict, words: int):
    frame = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, n string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op1_minhash.near_duplicates(frame, words=words).collect()}
    sets, want = brute(texts, words)
    assert got == {k: (len(sets[k]), want[k], want[k] == k) for k in texts}


def test_near_copies_of_all_degrees(spark):
    """Copies with more and more changes: chains of links, members linked with the rest through others only, and bare misses."""
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    texts = {0: None, 1: "", 2: " \n", 3: "word", 4: "WORD"}
    for k in range(140):
        words = list(base)
        for _ in range(rnd.randrange(0, 22)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        texts[1000 - k] = " ".join(words)
    for k in range(60):
        texts[2000 + k] = " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(1, 40)))
    check(spark, texts, 2)


def test_tiles(spark, monkeypatch):
    """The same with buckets cut into many tiles; workers get the module's values with the pickled function's globals."""
    monkeypatch.setattr(op1_minhash, "TILE", 16)
    monkeypatch.setattr(op1_minhash, "PARTNERS", 3)
    monkeypatch.setattr("sievelight.llm.components.HOT_ROWS", 5)
    test_near_copies_of_all_degrees(spark)


def test_repeated_ids(spark):
    """Rows of one doc_id are one document with the links of all of them, however the rows are dealt out."""
    a, b = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (5, "other words than all of these here"), (5, a), (None, "x y z a b c d"), (None, "q q w w e e r"), (7, "q q w w e e r")]
    want = {1: 1, 2: 1, 3: 1, 5: 1, 7: None, None: None}
    for seed in range(3):
        frame = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string").repartition(seed + 1)
        got = {(r["doc_id"], r["component_id"]) for r in op1_minhash.near_duplicates(frame, words=2).collect()}
        assert got == set(want.items())


def test_long_texts(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(9000)}" for _ in range(60_000)]
    near = [f"y{k}" if k % 40 == 0 else w for k, w in enumerate(long)]
    check(spark, {4: " ".join(long), 9: " ".join(near), 2: "w1 " * 50_000, 3: "w1 w1", 1: "w1"}, 2)


def test_edge_cases(spark, docs, nothing):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in op1_minhash.near_duplicates(docs).collect()}
    assert (5, 8, 3, False) in got and (3, 8, 3, True) in got and (9, 0, 9, True) in got and (7, 0, 7, True) in got
    assert (2, 1, 2, True) in got and (11, 1, 2, False) in got
    assert op1_minhash.near_duplicates(nothing).count() == 0


def vectors(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((40, 16))
    rows = []
    for k in range(400):
        v = centers[k % 40] + rng.standard_normal(16) * (0.02 if k % 3 else 0.3)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 40 % 4))
    v = rows[0][1]
    rows += [(900 + k, v, 0) for k in range(30)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, v, None), (1005, [1.0], 0), (1006, [], 0)]
    rows += [(1100 + k, [1.0, 0.001 * k], 2) for k in range(5)] + [(1110, [0.0, 1.0], 2), (1111, [1.0, 0.0], 3)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x"))


def test_recall_of_small_tables(spark, monkeypatch):
    """The same with an index for each length, as large ones have, and with hot entries."""
    monkeypatch.setattr(op10_embeddings, "FEW", 2)
    monkeypatch.setattr(op10_embeddings, "ENTRY", 1)
    monkeypatch.setattr(op10_embeddings, "TILE", 8)
    monkeypatch.setattr("sievelight.llm.components.HOT_ROWS", 5)
    test_recall(spark)


def test_plan():
    for n in (10, 10_000, 10**6, 10**9):
        tables = op10_embeddings.plan(n, 64)
        wide = len(tables[0])
        assert n / 2**wide <= op10_embeddings.ENTRY and 1 - (1 - op10_embeddings.AGREE**wide) ** len(tables) >= 0.94 and len(tables) < 20
        assert all(len(set(t)) == wide for t in tables)


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 2.0], 0), (None, [1.0, 1.0], 0)]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in op10_embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_recall(spark):
    rows, frame = vectors(spark)
    good = {i: (np.array(v, np.float64), c) for i, v, c in rows if c is not None and v and len(v) in (1, 2, 16) and None not in v and np.isfinite(v).all() and any(v)}
    links = {(a, b) for a, b in itertools.combinations(sorted(good), 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.sqrt((good[a][0] @ good[a][0]) * (good[b][0] @ good[b][0])) >= 0.98}
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = {r["vec_id"]: r for r in op10_embeddings.near_vectors(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_links"] <= count[i] for i in count)
    recall = sum(r["n_links"] for r in got.values()) / sum(count.values())
    assert recall >= 0.9, recall
    want = roots(count, links)
    assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.95 * len(want)
    assert [got[i]["n_links"] for i in (*range(1100, 1105), 1110, 1111)] == [4] * 5 + [0, 0] and got[1104]["component_id"] == 1100
    for i in range(1000, 1007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_recall_on_the_tables(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    found = op10_embeddings.near_vectors(frame).agg(F.sum("n_links")).first()[0]
    rows = [(r["label"], np.array(r["embedding"], np.float64)) for r in frame.collect() if r["label"] is not None]
    truth = 0
    for label in {x for x, _ in rows}:
        m = np.stack([v / np.linalg.norm(v) for x, v in rows if x == label])
        truth += int(((m @ m.T) >= 0.98).sum()) - len(m)
    assert found >= 0.9 * truth and found <= truth


def test_no_vectors(spark):
    _, frame = vectors(spark)
    assert op10_embeddings.near_vectors(frame.limit(0)).count() == 0
    assert {r["n_links"] for r in op10_embeddings.near_vectors(frame.where("vec_id in (1000, 1001, 1006)")).collect()} == {0}
