"""Every query with SQL gives the same rows in both engines; the others give what must hold."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from parity import same

from sievelight.batches import SLICE_BYTES, slices
from sievelight.plans.extract import extract
from sievelight.queries import SQL, Q


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, data, duck):
    assert same(Q[name](spark, data), duck, SQL[name])


def test_entry(spark, data):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and all(r["error"] is None and r["n_blocks"] == r["n_main"] + r["n_other"] for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, data):
    batch = Q["extract_pages"](spark, data).select("page_id", "n_blocks", "n_main", "n_other", "markdown", "error")
    assert sorted(map(str, Q["stream_extract"](spark, data).collect())) == sorted(map(str, batch.collect()))


def test_main_html_keeps_what_is_main(spark, data):
    for row in Q["main_html"](spark, data).collect():
        ids = [int(i) for i in re.findall(r'_item_id="(\d+)"', row["main_html"])]
        assert row["error"] is None and ids and all(i % 2 for i in ids)


def test_plans(spark, data):
    """Filters and columns reach the scan; extraction moves no rows; one Python stage after the other."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    extracted = plan(Q["extract_pages"](spark, data))
    assert "hashpartitioning" not in extracted and extracted.count("Exchange") <= 1  # that one only spreads a single file
    many = spark.read.parquet(f"{data}/pages.parquet").repartition(16)
    assert plan(extract(many)).count("Exchange") == 1  # the one just made here
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan(Q["lang_filter_limit"](spark, data)).replace("`", "")
    assert "Exchange" not in plan(Q["rouge5_scores"](spark, data))  # within rows
    pairs = re.sub(r"#\d+L?", "", plan(Q["rouge5_pairs"](spark, data)))
    assert "hashpartitioning(doc_id, gram" not in pairs and "MapInArrow" in pairs  # the n-grams of texts stay where the texts are


@pytest.mark.parametrize("name", ["stream_extract", "markdown_rules", "simplify_pages", "simplify_block_count", "extract_pages", "markdown", "main_html", "main_text", "chunk_blocks"])
def test_a_batch_of_pages_is_worked_on_in_slices(name, spark, data, monkeypatch):
    """What a worker holds doesn't grow with its batch, which has 10,000 pages where the input is large."""

    class Caught(Exception):
        pass

    def catch(self, function, schema):
        raise Caught(function)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", catch)
    with pytest.raises(Caught) as caught:
        Q[name](spark, data)
    monkeypatch.undo()
    n = 64
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["u"] * n, "html": ["<p>" + "word " * 20_000 for _ in range(n)]})
    sent = []

    def given():
        yield batch

    for made in caught.value.args[0](given()):
        sent.append(made.num_rows)
        if len(sent) == 2:
            break
    assert 0 < sum(sent) <= 2 * SLICE_BYTES // 100_000


def test_extraction_is_one_python_stage(spark, data):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("extract_pages", "markdown", "main_html", "main_text", "markdown_rules"):
        assert plan(Q[name](spark, data)).count("MapInArrow") == 1


def test_slices():
    batch = pa.RecordBatch.from_pydict({"k": list(range(100)), "s": ["x" * (k * 100) for k in range(100)]})
    parts = list(slices(batch, 20_000))
    assert pa.Table.from_batches(parts).combine_chunks().to_pylist() == batch.to_pylist() and len(parts) > 20
    assert all(part.nbytes <= 20_000 or part.num_rows == 1 for part in parts)
    assert list(slices(batch.slice(0, 0), 1)) == [batch.slice(0, 0)]


def test_language_filter_without_limit(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "source", "n_chars").collect()
    got = Q["lang_filter_all"](spark, data).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r["doc_id"], r["source"], r["n_chars"]) for r in docs if r["lang"] == "en"), key=str)
