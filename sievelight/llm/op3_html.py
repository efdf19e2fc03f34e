"""HTML extraction by layout-aware rendering: all visible text of a page, with its block spacing, lists and aligned tables.

The page is built into a tree with the standard's implied tags (sievelight.dom.builder). What is not visible gives nothing:
head matter, scripts, styles, templates, embedded frames, objects, media and canvases (whose content is shown only where they
cannot be), elements hidden by attribute or style (display: none; visibility: hidden, but what is visible again in them is shown),
closed dialogs, hidden inputs, the body of a closed details element, and in svg and math titles, descriptions, annotations and
definitions. Everything else is rendered:

* blocks stand on lines of their own; paragraphs, headings, lists, tables and the like have an empty line around them;
* list items have a mark (`-`, or the number of an ordered list, its start and value attributes heeded), and their further
  lines and lists are indented under it;
* br breaks a line, hr gives a rule, pre keeps its white space (tables in it are text like the rest); elsewhere white space collapses;
* a table's cells are padded to the width of their column and set two spaces apart, cells of several lines side by side; a cell that
  spans rows stands in the first of them and keeps its columns free in the others; lines of a cell that is not the last of its row are
  wrapped at WRAP characters, so no text is lost and no column gets wider for one long line;
* text that stands in a table, but in none of its rows, comes before the rows, and misplaced text of a row after the row;
* formulas and the labels of drawings give their text; a label, and a row of a matrix, stands on a line of its own.

Trees are walked with a stack of their own, and tables from the innermost outwards, so depth is bounded by memory only.

Nulls and ties: a null page gives null text, an empty one or one without visible text ""; repeated rows are rendered each; pages of any
length are rendered whole; columns beside the two named are not read; an empty table gives an empty result. A page whose rendering fails gives null text and the failure as error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dom.builder import parse
from ..dom.tree import Element
from .common import table

#: Characters at which lines of cells are wrapped. The standard's limits of columns and rows that a cell spans.
WRAP, MOST_COLUMNS, MOST_ROWS = 120, 1000, 65534
# Elements that are never visible, blocks, and blocks with an empty line around them.
UNSEEN = frozenset("head title meta link base script style template noscript iframe object embed audio video canvas datalist param source track area".split())
#: The same inside svg and math.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu article section fieldset form details".split())
SVG = {"svg", "math"}
DRAWING = frozenset("svg g text tspan".split())
BLOCKS = SPACED | frozenset("html body div li dt dd header footer main nav aside address center figcaption summary legend option optgroup dialog tbody thead tfoot tr td th caption hgroup search dir text foreignobject mtr mlabeledtr".split())
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")


def visible(node: Element) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in UNSEEN or "hidden" in attrs or "style" in attrs and _HIDING.search(attrs["style"]):
        return False
    if tag == "dialog" and "open" not in attrs or tag == "input" and attrs.get("type", "").lower() == "hidden":
        return False
    if (tag in UNDRAWN or attrs.get("display") == "none") and node.nearest(SVG) is not None:
        return False
    above = node.up
    if above is not None and above.tag == "details" and "open" not in above.attrs:
        return tag == "summary" and next(k for k in above.kids if k.tag == "summary") is node
    return True


def drawn(node: Element | None) -> bool:
    """Whether the text that stands in a node itself is drawn: what the node or else the nearest element above it that says so says."""
    while node is not None:
        said = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else None
        said = said[-1] if said else node.attrs.get("visibility") if node.tag in DRAWING or node.nearest(SVG) is not None else None
        if said:
            return said.lower() not in ("hidden", "collapse")
        node = node.up
    return True


def _preformatted(root: Element, hides: bool) -> str:
    """The visible text of a pre with its white space; br and blocks break lines."""
    out: list[str] = []
    todo: list[tuple[str, Element]] = [("open", root)]
    while todo:
        step, node = todo.pop()
        if step == "close":
            if node.tag in BLOCKS and out and not out[-1].endswith("\n"):
                out.append("\n")
            if not hides or drawn(node.up):
                out.append(node.tail)
            continue
        if node is not root:
            todo.append(("close", node))
            if not visible(node):
                continue
            if node.tag == "br" or node.tag in BLOCKS and out and not out[-1].endswith("\n"):
                out.append("\n")
        todo.extend(("open", kid) for kid in reversed(node.kids))
        if not (node.tag == "details" and "open" not in node.attrs) and (not hides or drawn(node)):
            out.append(node.text)
    return "".join(out)


class _Page:
    """Lines so far. A line is started with the indent of the open lists and quotes; gap is the empty lines due before it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.current: list[str] = []
        self.indents: list[str] = []
        self.mark: str | None = None
        self.gap = 0
        self.blank = True  # whether white space is due before the next word

    def write(self, text: str) -> None:
        """Text in which white space collapses."""
        words = _SPACE.sub(" ", text)
        if not words:
            return
        if words[0] == " " and (self.blank or not self.current):
            words = words[1:]
        if words:
            self.current.append(words)
            self.blank = words[-1] == " "

    def whole(self, lines: list[str]) -> None:
        """Lines that stay as they are."""
        for line in lines:
            self._put(line)

    def end(self, gap: int = 0) -> None:
        """Ends the line, if one is open; gap empty lines are due before the next."""
        if self.current:
            line = "".join(self.current).rstrip(" ")
            self.current, self.blank = [], True
            if line:
                self._put(line)
        self.gap = max(self.gap, gap if self.lines else 0)

    def newline(self) -> None:
        if self.current:
            self.end()
        elif self.lines:
            self.gap = max(self.gap, 1)

    def _put(self, line: str) -> None:
        self.lines.extend([""] * self.gap)
        self.gap = 0
        indent = "".join(self.indents)
        if self.mark is not None:
            indent = "".join(self.indents[:-1]) + self.mark
            self.mark = None
        self.lines.append((indent + line).rstrip(" "))


def _flow(root: Element, tables: dict[int, list[str]], hides: bool, itself: bool = False) -> list[str]:
    """The lines of an element's content, or of the element itself without its tail; tables in it are rendered already. hides: whether
    the page's styles speak of visibility at all."""
    page = _Page()
    closed_details = root.tag == "details" and "open" not in root.attrs
    if not closed_details and not itself and (not hides or drawn(root)):
        page.write(root.text)
    numbers: dict[int, int] = {}
    todo: list[tuple[str, Element]] = [("open", root)] if itself else [("open", kid) for kid in reversed(root.kids)]
    while todo:
        step, node = todo.pop()
        tag = node.tag
        if step == "close":
            if tag in ("li", "dd", "blockquote"):
                page.end()
                page.indents.pop()
                page.mark = None
            if tag in BLOCKS:
                nested = tag in ("ul", "ol", "menu", "dl") and node.up is not None and node.up.nearest({"li", "dd"}) is not None
                page.end(1 if tag in SPACED and not nested else 0)
            step = "tail"
        if step == "tail":
            if node is not root and node.up is not None and not (node.up.tag == "details" and "open" not in node.up.attrs) and (not hides or drawn(node.up)):
                page.write(node.tail)
            continue
        if not visible(node):
            todo.append(("tail", node))
            continue
        if tag == "br":
            page.newline()
            todo.append(("tail", node))
            continue
        if tag == "mtd" or node.up is not None and node.up.tag == "mfrac":  # drawn apart
            page.write(" ")
        if tag in BLOCKS:
            nested = tag in ("ul", "ol", "menu", "dl") and node.up is not None and node.up.nearest({"li", "dd"}) is not None
            page.end(1 if tag in SPACED and not nested else 0)
        seen = not hides or drawn(node)
        if tag == "hr":
            page.whole(["-" * 20] if seen else [])
        elif tag == "table":
            page.whole(tables[id(node)])
        elif tag == "pre":
            text = _preformatted(node, hides)
            page.whole(text.removeprefix("\n").rstrip("\n").expandtabs(8).split("\n") if text.strip() else [])
        elif tag == "input":
            if seen and node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                page.write(node.attrs.get("value", ""))
        elif tag == "textarea":
            page.write(node.text if seen else "")
        else:
            if tag == "li":
                owner = node.up
                mark = "- "
                if owner is not None and owner.tag == "ol":
                    at = numbers.get(id(owner), _number(owner.attrs.get("start"), 1))
                    at = _number(node.attrs.get("value"), at)
                    numbers[id(owner)] = at + 1
                    mark = f"{at}. "
                page.indents.append(" " * len(mark))
                page.mark = mark
            elif tag == "dd":
                page.indents.append("    ")
            elif tag == "blockquote":
                page.indents.append("> ")
            todo.append(("close", node))
            todo.extend(("open", kid) for kid in reversed(node.kids))
            if seen and not (tag == "details" and "open" not in node.attrs):
                page.write(node.text)
            continue
        todo.append(("close" if tag in BLOCKS else "tail", node))
    page.end()
    return page.lines


def _number(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else otherwise


def _wrapped(lines: list[str]) -> list[str]:
    out: list[str] = []
    for line in lines:
        indent = line[: len(line) - len(line.lstrip(" "))][: WRAP // 2]
        while len(line) > WRAP:
            cut = line.rfind(" ", len(indent) + 1, WRAP + 1)
            cut = line.find(" ", WRAP) if cut < 0 else cut
            if cut < 0:
                break
            out.append(line[:cut].rstrip(" "))
            line = indent + line[cut:].lstrip(" ")
        out.append(line)
    return out


def _grid(owner: Element, tables: dict[int, list[str]], hides: bool) -> list[str]:
    """A table's lines."""
    lines: list[str] = []
    #: Rows of cells: lines, columns, rows. None stands between groups of rows, over which no cell reaches.
    rows: list[list[tuple[list[str], int, int]] | None] = []
    text_of = lambda node, text: text if not hides or drawn(node) else ""
    strays = [text_of(owner, owner.text)]
    todo = [("open", k) for k in reversed(owner.kids)]
    while todo:
        step, node = todo.pop()
        if step == "tail":
            strays.append(text_of(node.up, node.tail))
            if node.tag in ("tbody", "thead", "tfoot"):
                rows.append(None)
            continue
        todo.append(("tail", node))
        if not visible(node):
            continue
        if node.tag == "caption":
            lines += _flow(node, tables, hides)
        elif node.tag in ("tbody", "thead", "tfoot", "colgroup"):
            strays.append(text_of(node, node.text))
            todo.extend(("open", k) for k in reversed(node.kids))
        elif node.tag == "tr":
            row = []
            for c in (k for k in node.kids if visible(k)):
                down = _number(c.attrs.get("rowspan"), 1)
                row.append((_flow(c, tables, hides, c.tag not in ("td", "th")), min(MOST_COLUMNS, max(1, _number(c.attrs.get("colspan"), 1))), MOST_ROWS if down == 0 else min(MOST_ROWS, max(1, down))))
            rows.append(row)
            if stray := _SPACE.sub(" ", " ".join(text_of(node, t) for t in [node.text, *(c.tail for c in node.kids)])).strip():
                rows.append([([stray], 1, 1)])
        elif node.tag != "col":  # misplaced content
            rows.append([(_flow(node, tables, hides, True), 1, 1)])
    if stray := _SPACE.sub(" ", " ".join(strays)).strip():
        lines.append(stray)
    # Each cell's first column: the next that no cell from above still holds.
    placed: list[list[tuple[int, int, list[str]]]] = []
    held: dict[int, int] = {}
    for row in rows:
        if row is None:
            held = {}
            continue
        own: list[tuple[int, int, list[str]]] = []
        at, after = 0, {c: n - 1 for c, n in held.items() if n > 1}
        for cell, span, down in row:
            while at in held:
                at += 1
            own.append((at, span, cell))
            if down > 1:
                after |= dict.fromkeys(range(at, at + span), down - 1)
            at += span
        held = after
        placed.append([(c, n, _wrapped(cell) if k < len(own) - 1 else cell) for k, (c, n, cell) in enumerate(own)])
    widths: dict[int, int] = {}
    for row in placed:
        for at, span, cell in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, cell[: None if at < row[-1][0] else 0]), default=0))
    for at, width in ((at, max(map(len, cell), default=0)) for row in placed for at, span, cell in row[-1:] if span == 1):
        widths[at] = max(widths.get(at, 0), min(width, WRAP))  # a last cell's long lines reach beyond their column
    # What cells over several columns need beyond these goes to their last column.
    wide = sorted(((span, at, max(map(len, cell), default=0)) for row in placed for at, span, cell in row[:-1] if span > 1), key=lambda x: x[:2])
    for span, at, width in wide:
        some = [widths.get(c) for c in range(at, at + span)]
        short = width - sum(x + 2 for x in some if x is not None) + (2 if some[-1] is not None else 0)
        if short > 0:
            widths[at + span - 1] = short + (some[-1] or 0)
    lefts, left = {}, 0
    for column in range(max(widths, default=-1) + 1):
        lefts[column] = left
        left += widths[column] + 2 if column in widths else 0
    for row in placed:
        for k in range(max((len(cell) for _, _, cell in row), default=0)):
            line = ""
            for at, _, cell in row:
                if k < len(cell) and cell[k]:
                    line = line.ljust(lefts.get(at, left)) if not line or len(line) < lefts.get(at, left) else line + "  "
                    line += cell[k]
            lines.append(line.rstrip(" "))
    return lines


def render(html: str | None) -> str:
    """The visible text of a page."""
    body = next(k for k in parse(html or "", bare=True).kids if k.tag == "body")
    if not visible(body):
        return ""
    tables: dict[int, list[str]] = {}
    hides = "visibility" in html.lower()
    for owner in reversed([n for n in body.below() if n.tag == "table"]):  # the inner ones first
        tables[id(owner)] = _grid(owner, tables, hides)
    return "\n".join(_flow(body, tables, hides)).strip("\n")


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text, error for every row of pages."""
    given = pages.select(F.col(key).alias("__key"), F.col(html).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for page in batch.column("__html").to_pylist():
                text = error = None
                try:
                    text = None if page is None else render(page)
                except Exception as failed:  # one page must not end the job; what failed is said
                    error = f"rendering failed: {failed}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["__key", "text", "error"])

    return given.mapInArrow(run, f"__key {given.schema['__key'].dataType.simpleString()}, text string, error string").withColumnRenamed("__key", key)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = extract_text(table(spark, sf_dir, "pages"))
    return made.select("page_id", F.length("text").cast("long").alias("n_chars"), "text", "error")


QUERIES = {"op3_html": op3_html}
#: In SQL only for pages of the test tables' grammar; see tests/llm.
ORACLE_SQL: dict[str, str] = {}
