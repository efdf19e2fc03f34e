from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.functions.packing import chunk_tokens, pack
from sievelight.operators import classify, ingest, labels, metrics, resume
from sievelight.plans import extract as E


def packed(costs: list[int], most: int) -> list[tuple[list[int], int]]:
    """The rule of packing, one block after the other."""
    room, made, held, used = most - 2, [], [], 0
    for k, cost in enumerate(costs):
        need = min(cost + 1, room)
        if held and used + need > room:
            made.append((held, used + 2))
            held, used = [], 0
        held, used = [*held, k], used + need
    return [*made, (held, used + 2)] if held else made


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), min_size=1, max_size=6))
def test_pack(spark, cases):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, costs array<int>").select("k", pack(F.col("costs"), max_tokens=20).alias("made")).collect()
    for row in rows:
        made = [(list(c["blocks"]), c["tokens"]) for c in row["made"]]
        assert made == packed(cases[row["k"]], 20)
        assert [b for blocks, _ in made for b in blocks] == list(range(len(cases[row["k"]])))
        assert all(n <= 20 for _, n in made)


def test_chunk_tokens(spark):
    blocks = F.array(F.array(F.lit("a"), F.lit("b")), F.array(*[F.lit("c")] * 9))
    frame = spark.range(1).select(blocks.alias("b"), pack(F.transform(blocks, F.size), max_tokens=8).alias("p"))
    made = frame.select(F.transform("p", lambda c: chunk_tokens(F.col("b"), c, "|", "[", "]", max_tokens=8)).alias("t")).first()["t"]
    assert [list(t) for t in made] == [["[", "a", "b", "|", "]"], ["[", *"ccccc", "|", "]"]]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.visible_text(F.lit("<p>a <script>x</script><b>b</b>\n c")).alias("seen"), T.domain(F.lit("HTTP://u@Ex.com:80/p")).alias("domain"), T.domain(F.lit("no url at all")).alias("none"),
        F.size(T.extract_blocks(F.lit("none here"))).alias("n"), T.item_id(F.lit("<p>x")).alias("no_id"), T.ngrams(T.whitespace_tokens(F.lit("a b c d")), 3).alias("grams"),
        F.size(T.ngrams(T.whitespace_tokens(F.lit("a b")), 5)).alias("few"), T.short_source(F.lit("http://example.com/a.png")).alias("src"),
    ).first()
    assert tuple(row) == ("a b c", "u@ex.com:80", "", 0, None, ["a b c", "b c d"], 0, "http:...a.png")


def test_rouge(spark):
    rows = [(0, "a b c d e f", "a b c d e"), (1, "a b c d", "a b c d"), (2, "a b c d e", ""), (3, "a b c d e a b c d e", "a b c d e"), (4, None, None)]
    got = {r["k"]: (round(r["p"], 4), round(r["r"], 4), r["empty"]) for r in metrics.rouge_scores(spark.createDataFrame(rows, "k int, ref string, pred string"), "k", "ref", "pred").collect()}
    assert got == {0: (1.0, 0.5, False), 1: (0.0, 0.0, False), 2: (0.0, 0.0, True), 3: (1.0, 0.1667, False), 4: (0.0, 0.0, True)}


def test_labels(spark):
    rows = spark.createDataFrame([(1, "1", 0, "main"), (1, "1", 1, "other"), (1, None, 2, "main"), (1, "2", 3, "main")], "page int, item_id string, ord int, label string")
    assert labels.labels_map(rows, "page", "ord").first()["labels"] == {"1": "other", "2": "main"}
    one = spark.createDataFrame([("<p>x", None), ("<p>y", "failed")], "html string, error string")
    assert [r[0] for r in one.select(labels.fallback(F.lit("ok"), F.col("html"))).collect()] == ["ok", "<p>y"]
    with pytest.raises(ValueError):
        labels.fallback(F.lit(""), F.lit(""), "guess")


def test_resume(spark):
    work = spark.range(10).withColumnRenamed("id", "k")
    assert [r[0] for r in resume.pending(work, work.where("k % 2 = 0"), "k", 1, 3).collect()] == [3, 5, 7]
    assert resume.pending(work, work.limit(0), "k").count() == 10
    assert sorted((r["k"], r["batch"]) for r in resume.batches(work, "k", 4, partitions=3).collect()) == [(k, k // 4) for k in range(10)]


def test_classifiers():
    assert classify.heuristic(['<p>a long enough paragraph of text.</p>', '<div class="ad">buy this very nice thing right now</div>', "<footer>© some company of this world, 2020</footer>", '<p><a href="x">only a link of some length here</a></p>', "<h1>T</h1>", "<p>x</p>"]) == [1, 0, 0, 0, 1, 0]
    assert classify.resolve("alternating")(["a", "b", "c"]) == [1, 0, 1]
    with pytest.raises(ValueError):
        classify.resolve("no such model")


def test_ingest(spark):
    page = "<html><p>" + "the cat is on the mat and it was with us " * 60 + "</p>"
    rows = spark.createDataFrame([("https://A.com/x", page), ("https://b.com", "short"), (None, page), ("https://c.com", "<p>" + "der hund und die katze " * 200)], "url string, html string")
    assert sorted((r["url"] or "", r["domain"]) for r in ingest.ingest(rows).collect()) == [("", ""), ("https://A.com/x", "a.com")]
    assert tuple(ingest.funnel(rows).first())[:3] == (4, 3, 3)


def test_errors_are_data(spark):
    pages = spark.createDataFrame([(1, "<p>some text that is long enough to keep", "k"), (2, None, "l"), (3, "", None)], "page_id int, html string, note string")
    made = {r["page_id"]: r for r in E.extract(pages).collect()}
    assert made[1]["markdown"] == "some text that is long enough to keep" and made[1]["note"] == "k"
    assert made[2]["n_blocks"] == made[3]["n_blocks"] == 0 and made[2]["error"] is None
    failing = E.with_content(E.with_labels(E.with_simplified(pages)).withColumn("error", F.when(F.col("page_id") == 1, "simplify failed: x")))
    assert failing.where("page_id = 1").first()["error"] == "simplify failed: x"


def test_from_simplified(spark):
    given = spark.createDataFrame([('<html><body><p _item_id="1">a paragraph that is long enough</p><p _item_id="2">x</p></body></html>',)], "simplified_html string")
    assert E.from_simplified(given).first()["markdown"] == "a paragraph that is long enough"


def test_text_for_scoring_and_totals(spark):
    pages = spark.createDataFrame([(1, "<p>see <a href='/x'>this</a> text of some length</p>"), (2, "<nav>n</nav>")], "page_id int, html string")
    ready = E.with_labels(E.with_simplified(pages), E.Config(classifier="all-main"))
    assert {r["page_id"]: r["text"] for r in E.with_text(ready).collect()} == {1: "see this text of some length", 2: ""}
    rows, seen = metrics.observed(E.with_content(ready))
    assert rows.count() == 2 and seen.get["n_rows"] == 2 and seen.get["n_errors"] == 0


def test_answers_and_prompts(spark):
    answers = spark.createDataFrame([('x {"1": "main", "2":"other"} y',), ('{"1": "main", "2": "oth',), ("1main2other",), ("none",)], "a string")
    got = [[tuple(x) for x in r[0]] for r in answers.select(T.response_labels("a")).collect()]
    assert got == [[("1", "main"), ("2", "other")], [("1", "main")], [("1", "main"), ("2", "other")], []]
    assert spark.range(1).select(T.prompt(F.lit("<p>"), "compact")).first()[0].endswith("<p>")
    with pytest.raises(ValueError):
        T.prompt("a", "v9")


def test_command_line(spark, tmp_path):
    from sievelight.__main__ import main

    spark.createDataFrame([(1, "<p>a paragraph that is long enough to keep</p>")], "page_id int, html string").write.parquet(str(tmp_path / "in"))
    main(["extract", str(tmp_path / "in"), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).first()["n_main"] == 1


def test_stages_as_commands(spark, tmp_path):
    from sievelight.__main__ import main

    page = "<p>a paragraph that is long enough to keep</p><nav>n</nav>"
    spark.createDataFrame([(1, page), (2, page)], "page_id int, html string").write.parquet(str(tmp_path / "in"))
    for command, source, target in (("preprocess", "in", "a"), ("infer", "a", "b"), ("postprocess", "b", "c"), ("postprocess", "b", "c")):
        main([command, str(tmp_path / source), str(tmp_path / target), "--output-format", "text"])
    got = spark.read.parquet(str(tmp_path / "c"))
    assert sorted((r["page_id"], r["markdown"].strip(), r["error"]) for r in got.collect()) == [(k, "a paragraph that is long enough to keep", None) for k in (1, 2)]


def test_config_and_errors(spark):
    from sievelight.plans.extract import Config, extract

    for wrong in ({"output": "pdf"}, {"fallback": "x"}, {"prompt": "v9"}, {"answers": "xml"}, {"cutoff": 0}, {"prompt": "short_compact"}):
        with pytest.raises(ValueError):
            Config(**wrong)
    assert Config(prompt="short_compact", answers="compact").prompt == "short_compact"

    def fails(blocks):
        return [1] * len(blocks)

    rows = spark.createDataFrame([(1, "<p>kept text of a page</p>"), (2, None)], "page_id int, html string")
    for output, want in (("html", "<p"), ("text", "kept text of a page"), ("none", "")):
        assert extract(rows, Config(classifier=fails, output=output, fallback="text")).where("page_id = 1").first()["markdown"].strip().find(want) >= 0
    errors = spark.createDataFrame([("simplify failed: x",), ("boom",), (None,), ("read failed: y",)], "error string")
    assert [r[0] for r in errors.select(T.failed_stage("error")).collect()] == ["simplify", "other", None, "read"]


def test_backends(spark):
    from sievelight.operators.classify import answers

    def make():
        class Backend:
            def __init__(self):
                self.calls = 0

            def generate(self, prompts):
                self.calls += 1
                if any("bad" in p for p in prompts):
                    raise RuntimeError("no answer")
                return [f"1main{len(p)}other" for p in prompts]

        return Backend()

    rows = spark.createDataFrame([(1, "p"), (2, "bad"), (3, None), (4, "ppp")], "k int, prompt string").coalesce(1)
    got = {r["k"]: (r["answer"], r["answer_error"]) for r in answers(rows, "prompt", make).collect()}
    assert got == {1: ("1main1other", None), 2: ("", "answer failed: no answer"), 3: ("", None), 4: ("1main3other", None)}


def test_lazy_detector(spark):
    def make():
        return lambda text: ("xx", 0.9)

    made = ingest.with_language(spark.createDataFrame([("a",), (None,)], "t string"), "t", ingest.lazily(make))
    assert {(r["lang"], r["lang_conf"]) for r in made.collect()} == {("xx", 0.9)}
