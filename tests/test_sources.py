from __future__ import annotations

import gzip
import json

import zstandard
from pyspark.sql import functions as F

from sievelight.sources import readers, sinks, warc


def _record(kind: str, url: str, payload: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return gzip.compress(head + payload + b"\r\n\r\n")


def test_warc(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: Text/HTML; charset=utf-8\r\n\r\n<p>caf\xc3\xa9 \xff"
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n3\r\n<p>\r\n1\r\nx\r\n0\r\n\r\n"
    other = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\ngone"
    parts = [_record("warcinfo", "", b"info"), _record("response", "http://a/", http), _record("request", "http://a/", b"GET"), _record("response", "http://b/", chunked), _record("response", "http://c/", other)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts) + _record("response", "http://d/", http)[:40])  # the last one is cut off
    read = warc.read_warc(spark, str(tmp_path / "*.warc.gz"))
    assert read.where("error IS NULL").count() == 5 and read.count() == 6
    assert sorted(map(tuple, warc.html_pages(read).collect())) == [("http://a/", "<p>café �"), ("http://b/", "<p>x")]


def test_json_lines(spark, tmp_path):
    lines = "\n".join(json.dumps(x) for x in ({"html": "<p>ä", "url": "u"}, {"url": "v"}))
    (tmp_path / "a.jsonl").write_text(lines)
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress(lines.encode()))
    assert sorted(r["html"] for r in readers.json_lines(spark, str(tmp_path / "a.jsonl")).collect()) == ["", "<p>ä"]
    assert readers.json_lines(spark, str(tmp_path / "b.jsonl.zst")).count() == 2
    assert [s.rsplit("/", 1)[1] for s in readers.shards(spark, str(tmp_path))] == ["b.jsonl.zst"]


def test_lists_and_benchmark(spark, tmp_path):
    (tmp_path / "paths.txt").write_text("a\n\n  b \n")
    assert sorted(r["path"] for r in readers.path_list(spark, str(tmp_path / "paths.txt")).collect()) == ["a", "b"]
    rows = readers.pages_of(spark, ["<p>", {"html": "x", "page_id": 7, "metadata": {"k": "v"}}, 3]).orderBy("input_idx").collect()
    assert [(r["page_id"], r["html"]) for r in rows] == [(0, "<p>"), (7, "x"), (2, None)] and rows[2]["error"].startswith("input failed")
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"html": "h", "meta": {"language": x, "level": "mid"}}) for x in ("en", "de", "en")))
    assert readers.benchmark_pages(spark, str(tmp_path / "b.json")).count() == 2
    assert readers.benchmark_pages(spark, str(tmp_path / "b.json"), limit=1).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"1": "main"}, "<p>ä", "ä", None, "s0")], "page_id long, labels map<string,string>, main_html string, markdown string, error string, shard string")
    sinks.json_results(rows, str(tmp_path / "out"))
    file = max((tmp_path / "out").glob("*.json.gz"), key=lambda f: f.stat().st_size)
    assert json.loads(gzip.decompress(file.read_bytes())) == {"page_id": 1, "labels": {"1": "main"}, "html": "<p>ä", "markdown": "ä", "error": None}
    sinks.parquet_results(rows, str(tmp_path / "parquet"), shard="shard")
    assert (tmp_path / "parquet" / "shard=s0").is_dir()
    sinks.mark_done(rows.select("shard"), str(tmp_path / "done"))
    sinks.mark_done(rows.select("shard"), str(tmp_path / "done"))
    assert spark.read.parquet(str(tmp_path / "done")).distinct().count() == 1


def _page_record(kind: str, url: str, body: bytes) -> bytes:
    payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_damaged_warc_files_say_so(spark, tmp_path):
    import gzip

    from sievelight.sources import warc

    members = [gzip.compress(_page_record("response", f"http://x/{k}", b"<p>page %d</p>" % k)) for k in range(3)]
    files = {"whole.gz": b"".join(members), "cut.gz": b"".join(members)[:-20], "plain.warc": _page_record("response", "http://y", b"y"), "not.warc": b"no record at all", "short.warc": _page_record("response", "http://z", b"z" * 50)[:-40], "empty.warc": b""}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    paths = spark.createDataFrame([(str(tmp_path / name),) for name in files] + [(f"file://{tmp_path}/whole.gz",), (str(tmp_path / "missing"),)], "path string")
    for found in (warc.stream_warc(paths), warc.read_warc(spark, [str(tmp_path / name) for name in files])):
        totals = {r["path"].rsplit("/", 1)[-1]: (r["ok"], r["records"], r["html"]) for r in warc.file_totals(found).where("NOT startswith(path, 'file:///') OR path NOT LIKE '%whole.gz'").collect()}
        assert totals["cut.gz"] == (False, 2, 2) and totals["plain.warc"] == (True, 1, 1) and totals["not.warc"][:2] == (False, 0) and totals["short.warc"][:2] == (False, 0)
    totals = {r["path"]: (r["ok"], r["records"]) for r in warc.file_totals(warc.stream_warc(paths)).collect()}
    assert totals[str(tmp_path / "missing")] == (False, 0) and totals[str(tmp_path / "whole.gz")] == totals[f"file://{tmp_path}/whole.gz"] == (True, 3)
    pages = {r["url"]: r["html"] for r in warc.html_pages(warc.stream_warc(paths.where("path LIKE '%cut.gz'"))).collect()}
    assert pages == {f"http://x/{k}": f"<p>page {k}</p>" for k in range(2)}


def test_zstd_json(spark, tmp_path):
    from sievelight.sources import readers, sinks

    rows = spark.createDataFrame([(k, f"ä {k}" if k % 3 else None) for k in range(20)], "page_id long, html string").repartition(3)
    target = str(tmp_path / "out")
    sinks.zstd_json(rows, target)
    sinks.zstd_json(rows.where("page_id < 5"), target)
    files = readers.shards(spark, target)
    assert len(files) >= 4 and not list((tmp_path / "out").glob("_work*"))
    got = sorted((r["page_id"], r["html"]) for r in readers.json_lines(spark, files, rows.schema).collect())
    assert got == sorted([(k, f"ä {k}" if k % 3 else "") for k in range(20)] + [(k, f"ä {k}" if k % 3 else "") for k in range(5)])
    sinks.zstd_json(rows.where("page_id = 1"), target, mode="overwrite")
    assert readers.json_lines(spark, readers.shards(spark, target), rows.schema).count() == 1


def test_line_numbers(spark, tmp_path):
    from sievelight.sources import readers

    wanted = {}
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 1), ("c.jsonl", 0)):
        (tmp_path / name).write_text("".join('{"html": "%s%d"}\n' % (name, k) if k % 7 else "broken\n" for k in range(n)))
        wanted |= {(name, k): f"{name}{k}" if k % 7 else "" for k in range(n)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = readers.numbered_pages(spark, str(tmp_path)).collect()
        plain = readers.numbered_pages(spark, str(tmp_path / "b.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["path"].rsplit("/", 1)[-1], r["page_id"]): r["html"] for r in rows} == wanted and len(rows) == len(wanted)
    assert [(r["page_id"], r["html"]) for r in plain] == [(0, "")]


def test_warc_from_a_server(spark, tmp_path):
    import functools
    import http.server
    import threading

    from sievelight.sources import warc

    (tmp_path / "a.warc").write_bytes(b"".join(_page_record("response", f"http://x/{k}", b"<p>%d</p>" % k) for k in range(20)))
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        found = warc.file_totals(warc.stream_warc(spark.createDataFrame([(f"{base}/a.warc",), (f"{base}/none.warc",)], "path string"))).collect()
    finally:
        server.shutdown()
    assert {(r["path"].rsplit("/", 1)[-1], r["ok"], r["records"]) for r in found} == {("a.warc", True, 20), ("none.warc", False, 0)}


def test_score_cache(spark, tmp_path):
    from sievelight.sources import readers, sinks

    rows = spark.createDataFrame([(7, 0.5, 0.25, 1.0, False)], "page_idx int, f1 double, p double, r double, empty boolean").withColumn("more", F.lit(1))
    sinks.scores(rows, str(tmp_path / "scores"))
    assert [tuple(r) for r in readers.scores(spark, str(tmp_path / "scores")).collect()] == [("7", 0.5, 0.25, 1.0, False)]
