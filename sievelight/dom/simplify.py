"""Page simplification: a page becomes ordered content blocks, and its own tree marked with their ids.

The tree is copied, the copy is cleaned, and blocks are read off the copy in document order: whole block elements, and runs of text
and inline elements between them. Each block that has something to show is shortened and gets the next id, which is
also put on the page's original tree, on an element or on a wrapper around the run. All work is on trees; strings are made once at the end.

Chosen behaviour where markup leaves a choice: text that follows a wholesale-removed element (script, nav, ...) goes with it;
text after an invisible element stays; `<br>` ends a run; a list whose items hold no blocks is one block, cut to its
first and last item; equal bare runs of one parent count once.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .builder import parse
from .tree import Element, one_space, outer_html

# The tags and patterns that decide what a block is and what is dropped.
INLINE = frozenset(
    "map optgroup span input time u strong small sub samp blink b code nobr strike bdo basefont abbr var i cccode-inline s"
    " pic label mark object ccmath-inline svg button a font dfn sup kbd q script acronym option img big cite em"
    " marked-tail marked-text".split()
)
TABLE_OWN = frozenset("caption colgroup col thead tbody tfoot tr td th br".split())
DROPPED = frozenset("title head style script link meta iframe frame nav".split())
NEVER_BLOCK = frozenset({"math"})
UNCOUNTED = frozenset({"math", "table"})
NAV_NAMES = frozenset({"nav"})
INVISIBLE = {"display": "none", "font-size": "0px", "color": "transparent", "visibility": "hidden", "opacity": "0"}
WRAPPER, ID, SELECT, BLOCK_TYPE = "cc-alg-uc-text", "_item_id", "cc-select", "cc-block-type"
CUTOFF, ELLIPSIS = 500, "..."

_DECLARATION = re.compile(r"<\?xml\s+.*?\??>", re.DOTALL)
_TAG_OR_TEXT = re.compile(r"<[^>]+>|[^<]+")


class Block(NamedTuple):
    item_id: str
    html: str
    content_type: str


class Page(NamedTuple):
    simplified_html: str
    map_html: str
    blocks: list[Block]


class _Run(NamedTuple):
    """A paragraph before it is shortened: its tree, its kind, and the original element it belongs to."""

    tree: Element
    kind: str
    owner: Element


# -- cleaning the copy ----------------------------------------------------------------------------------------


def _drop_wholesale(root: Element) -> None:
    for node in [n for n in root.below() if n.tag in DROPPED]:
        if node.up is not None:
            node.drop(keep_tail=False)


def _hidden(node: Element) -> bool:
    parent = node.up
    if parent is None:
        return False
    if parent.tag == "body" and (node.attrs.get("class", "") in NAV_NAMES or node.attrs.get("id", "") in NAV_NAMES):
        return True
    for rule in node.attrs.get("style", "").split(";"):
        name, colon, value = rule.partition(":")
        if colon and INVISIBLE.get(name.strip()) == value.strip():
            return True
    return parent.tag == "details" and node.tag != "summary" and "open" not in parent.attrs


def _drop_hidden(root: Element) -> None:
    for node in reversed([n for n in root.below()]):  # children before their parents
        if not _hidden(node):
            continue
        at, parent, tail = node.place(), node.up, node.tail
        node.drop(keep_tail=False)
        if not tail:
            continue
        if at == 0:
            parent.text += tail
        elif parent.kids[at - 1].tail:
            parent.kids[at - 1].tail += tail
        else:  # a neighbour without a tail takes the text in
            parent.kids[at - 1].text += tail


# -- what is a block ------------------------------------------------------------------------------------------


class _Kinds:
    """For each element of a tree whether it is a block and whether blocks lie below it; found bottom-up, once."""

    def __init__(self, root: Element):
        order = list(root.walk())
        self.data_table = {id(n): self._is_data_table(n) for n in order if n.tag == "table"}
        self.plain_list: dict[int, bool] = {}
        # Items of a list are blocks or not by whether the list is plain; a list within a list is a block in any case.
        inner = self._holding(order, lambda n: self._block(n, lists=False))
        for node in order:
            if node.tag in ("ul", "ol", "dl"):
                items = [k for k in node.kids if k.tag in ("li", "dt", "dd")]
                pure = all(k.tag in (("dt", "dd") if node.tag == "dl" else ("li",)) for k in node.kids)
                bare = node.text.strip() or any(k.tail.strip() for k in node.kids)
                self.plain_list[id(node)] = bool(items) and pure and not bare and not any(inner[id(k)] for k in items)
        self.holds = self._holding(order, self.block)

    @staticmethod
    def _holding(order: list[Element], block) -> dict[int, bool]:
        holds: dict[int, bool] = {}
        for node in reversed(order):
            holds[id(node)] = node.tag not in NEVER_BLOCK and any(block(k) or holds[id(k)] for k in node.kids)
        return holds

    @staticmethod
    def _is_data_table(table: Element) -> bool:
        if table.attrs.get("role") == "table" or table.attrs.get("data-table"):
            return True
        only_inline = True
        for node in table.below():
            own = node.tag in ("caption", "col", "colgroup") or node.tag in ("td", "th") and "headers" in node.attrs
            if own and node.up.nearest({"table"}) is table:
                return True
            if node.tag not in TABLE_OWN and node.tag not in INLINE:
                only_inline = False
        return only_inline

    def _block(self, node: Element, lists: bool = True) -> bool:
        if node.tag in ("td", "th"):
            table = node.nearest({"table"})
            return table is not None and not self.data_table[id(table)]
        if node.tag in ("li", "dt", "dd"):
            owner = node.nearest({"ul", "ol"} if node.tag == "li" else {"dl"})
            return owner is not None and not (lists and self.plain_list.get(id(owner), False))
        return node.tag not in NEVER_BLOCK and node.tag not in INLINE

    def block(self, node: Element) -> bool:
        return self._block(node)


def _segments(root: Element) -> list[_Run]:
    kinds = _Kinds(root)
    found: list[_Run] = []
    bare: set[tuple[int, str]] = set()

    def flush(node: Element, run: list[tuple[str, object]], final: bool) -> None:
        """run: ("direct" | "tail", text) and ("element", element)."""
        if not run:
            return
        sources = {source for source, _ in run}
        if sources == {"direct"} or final and "element" not in sources:
            kind = "unwrapped_text"
        else:
            kind = "inline_elements" if sources == {"element"} else "mixed"
        tree = node.shell()
        leading = []
        for k, (source, item) in enumerate(run):
            if source == "element":
                twin = tree.append(item.copy())
                if k == len(run) - 1 and twin.tag == "br":
                    twin.tail = ""
            elif not tree.kids:  # later text is already the tail of the element before it
                leading.append(item)
        tree.text = " ".join(leading)
        if not tree.kids:
            key = (id(tree.origin), tree.text)
            if key in bare:
                return
            bare.add(key)
        found.append(_Run(tree, kind, tree.origin))

    # An explicit stack: (element, its next child, the run so far). Deep pages don't exhaust Python's.
    stack: list[list] = [[root, 0, [("direct", root.text.strip())] if root.text.strip() else []]]
    while stack:
        frame = stack[-1]
        node, at, run = frame
        if at == len(node.kids):
            flush(node, run, final=True)
            stack.pop()
            continue
        frame[1] += 1
        kid = node.kids[at]
        if not kinds.block(kid) and not kinds.holds[id(kid)]:
            run.append(("element", kid))
            if kid.tail.strip():
                run.append(("tail", kid.tail.strip()))
            continue
        if kid.tag in INLINE:
            (kid.origin or kid).attrs[BLOCK_TYPE] = "true"
        if kid.tag == "br":
            run.append(("element", kid))
        flush(node, run, final=False)
        frame[2] = [("tail", kid.tail.strip())] if kid.tail.strip() else []
        if kid.tag == "br":
            continue
        if kinds.data_table.get(id(kid)) or not kinds.holds[id(kid)]:
            twin = kid.copy(tail=False)
            found.append(_Run(twin, "block_element", twin.origin))
        else:
            stack.append([kid, 0, [("direct", kid.text.strip())] if kid.text.strip() else []])
    return found


# -- shortening a block ---------------------------------------------------------------------------------------


def _trim_attributes(root: Element) -> None:
    for node in root.walk():
        old, kept = node.attrs, {}
        if node.tag == "img":
            source = old.get("src", "").strip()
            if source and not source.startswith("data:image/"):
                kept["src"] = source
            if old.get("alt", "").strip():
                kept["alt"] = old["alt"].strip()
        for name in ("class", "id"):
            if old.get(name, "").strip():
                kept[name] = old[name].strip()
        node.attrs = kept


def _shorten_lists(root: Element) -> None:
    for node in root.walk():
        kids = node.kids
        if node.tag in ("ul", "ol"):
            if len(kids) > 2:
                node.kids = [kids[0]]
                node.append(Element("span", text=ELLIPSIS))
                node.append(kids[-1])
        elif node.tag == "dl" and len(kids) > 2:
            terms = [i for i, kid in enumerate(kids) if kid.tag == "dt"]
            if len(terms) > 1:
                node.kids = kids[terms[0] : terms[1]]
                node.append(Element("span", text=ELLIPSIS))
                node.kids += kids[terms[-1] :]


def _shows_anything(root: Element) -> bool:
    """Text anywhere in it, or an image with a source. (An image's own tail counts as the image.)"""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.text.strip():
            return True
        if node.tag == "img":
            if node.attrs.get("src", "").strip():
                return True
            continue
        todo.extend(node.kids)
        if node is not root and node.tail.strip():
            return True
    return False


def _cut(root: Element, limit: int) -> None:
    """Keeps the first limit characters of text, and puts an ellipsis behind them. Text of tables and formulas is not counted and
    not cut; text behind an element in one is counted, but not cut."""
    pieces: list[tuple[Element, bool, str, bool]] = []  # element, is tail, text, may be cut
    total = 0
    todo: list[tuple[Element, bool, bool]] = [(root, False, False)]
    while todo:
        node, after, inside = todo.pop()
        if after:
            if node.tail:
                total += len(node.tail)
                pieces.append((node, True, node.tail, not inside))
            continue
        within = inside or node.tag in UNCOUNTED
        if node.text and not within:
            total += len(node.text)
            pieces.append((node, False, node.text, not inside))
        if node is not root:
            todo.append((node, True, inside))
        todo.extend((kid, False, within) for kid in reversed(node.kids))
    if total <= limit:
        return
    seen, done = 0, False
    for node, is_tail, text, may in pieces:
        if done:
            new = ""
        elif seen + len(text) <= limit or not may:
            seen += len(text)
            continue
        else:
            new, done = text[: limit - seen] + ELLIPSIS, True
            at = node
            while at.up is not None:  # nothing follows the cut, at any level
                del at.up.kids[at.place() + 1 :]
                at = at.up
        if is_tail:
            node.tail = new
        else:
            node.text = new


# -- marking the page -----------------------------------------------------------------------------------------


def _wrapper(item_id: str, owner: Element, text: str = "") -> Element:
    made = Element(WRAPPER, {ID: item_id}, text)
    if SELECT in owner.attrs:
        made.attrs[SELECT] = owner.attrs[SELECT]
    return made


def _mark_text(owner: Element, text: str, item_id: str) -> None:
    """Wraps the first bare text of owner that reads text."""
    if owner.text.strip() == text:
        made = _wrapper(item_id, owner, owner.text)
        owner.text = ""
        owner.insert(0, made)
        return
    for at, kid in enumerate(owner.kids):
        if kid.tail.strip() == text:
            made = _wrapper(item_id, owner, kid.tail)
            kid.tail = ""
            owner.insert(at + 1, made)
            return


def _mark_elements(owner: Element, parts: list[Element], item_id: str) -> None:
    """Wraps the elements from the first to the last of parts, and the text before them."""
    parts = [p for p in parts if p.up is owner]
    if not parts:
        return
    first, last = parts[0].place(), parts[-1].place()
    made = _wrapper(item_id, owner, owner.text if first == 0 else owner.kids[first - 1].tail)
    if first == 0:
        owner.text = ""
    else:
        owner.kids[first - 1].tail = ""
    for kid in owner.kids[first : last + 1]:
        made.append(kid)
    owner.kids[first : last + 1] = []
    owner.insert(first, made)
    if parts[-1].tag == "br":  # what follows the break is the next run's
        made.tail, parts[-1].tail = parts[-1].tail, ""


def _mark(run: _Run, parts: list[Element], text: str, item_id: str) -> None:
    owner = run.owner
    if run.kind == "block_element":
        owner.attrs[ID] = item_id
        chosen = next((n.attrs[SELECT] for n in owner.below() if SELECT in n.attrs), None)
        if chosen is not None:
            owner.attrs[SELECT] = chosen
    elif parts:
        if owner.tag in INLINE and owner.tag != "body" and owner.attrs.get(BLOCK_TYPE) != "true":
            owner.attrs[ID] = item_id
        else:
            _mark_elements(owner, parts, item_id)
    elif text.strip():
        _mark_text(owner, text.strip(), item_id)


def _normal_space(markup: str) -> str:
    return _TAG_OR_TEXT.sub(lambda m: m[0] if m[0][0] == "<" else one_space(m[0]), markup).strip()


def simplify(raw: str | None, cutoff: int = CUTOFF) -> Page:
    original = parse(_DECLARATION.sub("", raw or ""))
    work = original.copy()
    _drop_wholesale(work)
    _drop_hidden(work)
    blocks: list[Block] = []
    for run in _segments(work):
        tree = run.tree
        parts, text = [kid.origin for kid in tree.kids if kid.origin is not None], tree.text
        _trim_attributes(tree)
        _shorten_lists(tree)
        if not _shows_anything(tree):
            continue
        _cut(tree, cutoff)
        item_id = str(len(blocks) + 1)
        tree.attrs[ID] = item_id
        _mark(run, parts, text, item_id)
        blocks.append(Block(item_id, _normal_space(outer_html(tree)), run.kind))
    simplified = '<html><head><meta charset="utf-8"></head><body>' + "".join(b.html for b in blocks) + "</body></html>"
    return Page(simplified, outer_html(original), blocks)
