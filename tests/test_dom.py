"""Golden cases, one for each decision of the tree builder and of simplification."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelight.dom import builder
from sievelight.dom.builder import parse
from sievelight.dom.rebuild import decode_urls, main_html
from sievelight.dom.render import markdown, plain_text, strip_spacer_images
from sievelight.dom.simplify import simplify
from sievelight.dom.tree import outer_html

HEAD, FOOT = '<html><head><meta charset="utf-8"></head><body>', "</body></html>"


def blocks(page: str) -> str:
    return simplify(page).simplified_html.removeprefix(HEAD).removesuffix(FOOT)


@pytest.mark.parametrize(
    ("raw", "body"),
    [
        ("<p>a<p>b<br>c", "<p>a</p><p>b<br>c</p>"),
        ("<p><b>x<br><p>y</p><footer>z", "<p><b>x<br></b></p><p><b>y</b></p><footer><b>z</b></footer>"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>t", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>t"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<a href=1>x<a href=2>y</a>", '<a href="1">x</a><a href="2">y</a>'),
        ("<div>x<!-- c --><i>y</div>z", "<div>x<i>y</i></div><i>z</i>"),
        ("<p>&amp;&copy;&lt;", "<p>&amp;©&lt;</p>"),
        ("", ""),
    ],
)
def test_builder(raw, body):
    assert outer_html(parse(raw)) == f"<html><head></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ("<p>a&amp</p>", "a&amp"),
        ("<p>&copy 2 &ampx; &amp;amp &eacute;&#65;&#66", "&copy 2 &ampx; &amp é" + "AB"),
        ("<p title='?a=1&copy=2'>\ufdd0&lt", "\ufdd0&lt"),
        ("<p><script>a&&b;&amp</script>", "a&&b;&amp"),
    ],
)
def test_named_references_need_their_semicolon(raw, text):
    body = parse(raw).kids[1]
    assert body.all_text() == text and parse(outer_html(parse(raw))).kids[1].all_text() == text
    assert body.kids[0].attrs in ({}, {"title": "?a=1&copy=2"})
    assert parse("<p>a&amp</p>", bare=True).kids[1].all_text() == "a&"


def test_cut_references_are_text_of_the_block():
    page = simplify("<h1>a&&&amp</h1>")
    assert blocks("<h1>a&&&amp</h1>") == '<h1 _item_id="1">a&amp;&amp;&amp;amp</h1>'
    assert markdown(main_html(page.map_html, {"1": "main"})) == "# a&&&amp"


def test_script_text_ends_nothing():
    root = parse('<head><script>var t="</p>";</script></head><p>x')
    assert outer_html(root).startswith('<html><head><script>var t="</p>";</script></head>')


@pytest.mark.parametrize(
    ("raw", "made"),
    [
        ("<p>a<br>b</p>", '<p _item_id="1">a<br></p><p _item_id="2">b</p>'),
        ("<ul><li>1<li>2<li>3<li>4</ul>", '<ul _item_id="1"><li>1</li><span>...</span><li>4</li></ul>'),
        ("<ul><li>a<ul><li>b</ul></ul>", '<li _item_id="1">a</li><ul _item_id="2"><li>b</li></ul>'),
        ("<dl><dt>a<dd>1<dt>b<dd>2<dt>c<dd>3</dl>", '<dl _item_id="1"><dt>a</dt><dd>1</dd><span>...</span><dt>c</dt><dd>3</dd></dl>'),
        ("<div>x<p>y</p>x</div>", '<div _item_id="1">x</div><p _item_id="2">y</p>'),
        ("<div><script>s</script>tail<p>q</p></div>", '<p _item_id="1">q</p>'),
        ("<p>a</p><i style='display:none'>z</i>x", '<p _item_id="1">ax</p>'),
        ("<body><div class=nav>n</div><div><div class=nav>m</div></div>", '<div class="nav" _item_id="1">m</div>'),
        ("<details><summary>s</summary><p>h</details><details open><summary>s</summary><p>h</details>", '<summary _item_id="1">s</summary><summary _item_id="2">s</summary><p _item_id="3">h</p>'),
        ("<table><caption>c</caption><tr><td>1</table>", '<table _item_id="1"><caption>c</caption><tbody><tr><td>1</td></tr></tbody></table>'),
        ("<table><tr><td><div>1</div><td><div>2</div></table>", '<div _item_id="1">1</div><div _item_id="2">2</div>'),
        ("<p><img src='data:image/x'></p><p><img src=/a.jpg alt=t width=3></p>", '<p _item_id="1"><img src="/a.jpg" alt="t"></p>'),
        ("<p>" + "a" * 600 + "</p>", '<p _item_id="1">' + "a" * 500 + "...</p>"),
        ("<p>" + "a" * 499 + "<b>bc<i>d</i></b><u>e</u></p>", '<p _item_id="1">' + "a" * 499 + "<b>b...<i></i></b></p>"),
        ("<p>" + "é" * 500 + "</p>", '<p _item_id="1">' + "é" * 500 + "</p>"),
        ("", ""),
    ],
)
def test_simplify(raw, made):
    assert blocks(raw) == made


def test_table_text_is_not_cut():
    cell = "a" * 700
    assert cell in blocks(f"<table><caption>c</caption><tr><td>{cell}</table>")


def test_marks_on_the_page():
    page = simplify("<div>x<p>y</p>z <b>w</b></div>")
    assert '<div><cc-alg-uc-text _item_id="1">x</cc-alg-uc-text><p _item_id="2">y</p><cc-alg-uc-text _item_id="3">z <b>w</b></cc-alg-uc-text></div>' in page.map_html


def test_rebuild():
    page = simplify("<nav>n</nav><h1>t</h1><p>a<br>b</p><footer>f</footer>")
    labels = {"1": "main", "2": "main", "3": "other", "4": "other"}
    assert main_html(page.map_html, labels) == '<html><body><h1 _item_id="1">t</h1><p>a<br></p></body></html>'
    assert main_html(page.map_html, {}) == "<html></html>"
    assert main_html(page.map_html, {}, empty_as_blank=True) == ""
    assert main_html("", labels) == ""


def test_urls():
    assert decode_urls('<a href="https://a?x=1&amp;y=2">') == '<a href="https://a?x=1&y=2">'
    assert decode_urls('<a href="/a?x=1&amp;y=2">') == '<a href="/a?x=1&amp;y=2">'


def test_rendering():
    page = '<h2>T</h2><p>a <a href="/x">l</a> <b>c</b></p><ul><li>1<li>2</ul><img src="/p.png" alt="i"><img src="/spacer.gif">'
    assert markdown(page) == "## T\n\na [l](/x) **c**\n\n  * 1\n  * 2\n\n![i](/p.png)"
    assert plain_text("<p>a <a href=/x>l</a></p>") == "a l"
    assert strip_spacer_images('<img width="1" src="a"><IMG src="data:image/png;x"><img src="b.jpg">') == '<img src="b.jpg">'


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<br>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<a href=x>", "</a>", "<script>", "</script>", "<nav>", "x", " y ", "&amp;", "<h1>", "</h1>", "<i style='display:none'>", "</i>"]), max_size=40))
def test_any_markup(parts):
    page = simplify("".join(parts))
    ids = [b.item_id for b in page.blocks]
    assert ids == [str(k + 1) for k in range(len(ids))]
    assert outer_html(parse(outer_html(parse("".join(parts)))))  # what is written can be read
    main_html(page.map_html, dict.fromkeys(ids, "main"))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<ul><li>a</li><ul><li>b</li></ul></ul>", "* a\n      * b"),
        ("<ol><li>a</li><ul><li>b</li></ul>c<li>d</ol>", "1. a\n       * b\n     c\n  2. d"),
        ("<ul>x <b>y</b><div>z</div><li>a</li><p>q</p></ul>", "x **y**\nz\n  * a\n    q"),
        ("<ul><ul><li>b</li></ul></ul>", "* b"),
        ("<table><tr>x<td>a</td>y<td>b</td><b>z</b></tr><tr><td>c</table>", "a | b\n\nx y **z**\n\nc"),
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a\n\nb"),
    ],
)
def test_misplaced_content_is_rendered(page, text):
    assert markdown(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<ul>", "</ul>", "<ol>", "</ol>", "<li>", "</li>", "<p>", "<div>", "</div>", "<b>", "</b>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<form>", "</form>", "<tbody>", "<caption>", "word ", "word", "<blockquote>", "</blockquote>"]), max_size=40))
def test_markdown_has_all_text(parts):
    numbered = "".join(f"w{k}w" if p == "word" else f"w{k}w " if p == "word " else p for k, p in enumerate(parts))
    page = simplify(numbered)
    main = main_html(page.map_html, dict.fromkeys((b.item_id for b in page.blocks), "main"))
    words = re.findall(r"w\d+w", main)
    assert sorted(re.findall(r"w\d+w", markdown(main))) == sorted(words) == sorted(re.findall(r"w\d+w", plain_text(main)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", '<a href="?a&amp;b" title="q>r">', "<a href=x>", "</a >", '<p class="a"b="c">', '</a x="1">', "<script>", "</script>", "a<b && c", "</SCRIPT >", "</", "<", "< ", "<!", "<!--", " --> ", "<!-- c -->", "<!DOCTYPE html>", "<?pi?>", ">", "&amp;", "&#65", "&", "x", "<br/>", "<svg/>", "<1>", "</>", "<style>", "</style>"]), max_size=30), st.integers(0, 5))
def test_plain_tags_are_read_as_the_parser_reads_them(parts, cut):
    raw = "".join(parts)
    raw = raw[: len(raw) - cut] if cut else raw
    fast = outer_html(parse(raw))
    with pytest.MonkeyPatch.context() as patch:
        patch.delattr(builder._Builder, "goahead")
        assert outer_html(parse(raw)) == fast


def test_plain_pages_cost_no_searches_of_the_parser(monkeypatch):
    monkeypatch.setattr(builder._Builder, "parse_starttag", None)
    monkeypatch.setattr(builder._Builder, "parse_endtag", None)
    assert outer_html(parse('<body><div class="a"><p id="b" title="x&amp;y">a</p></div></body>')).count("<p id") == 1


def test_deep_pages():
    assert len(simplify("<div>" * 3000 + "x").blocks) == 1
