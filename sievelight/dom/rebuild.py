"""From a marked page and labels back to the main content."""

from __future__ import annotations

import html
import re

from .builder import parse
from .simplify import ID, WRAPPER
from .tree import Element, outer_html

#: What an absolute URL starts with.
ABSOLUTE = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://", "FTP://", "//")
_URL = re.compile(r'((?:href|src)=")(.*?)(")', re.IGNORECASE | re.DOTALL)


def decode_urls(markup: str) -> str:
    """Resolves character references in href and src, of absolute URLs only."""
    return _URL.sub(lambda m: m[1] + html.unescape(m[2]) + m[3] if m[2].startswith(ABSOLUTE) else m[0], markup)


def _kept(root: Element, labels: dict[str, str]) -> set[int]:
    order = list(root.walk())
    wanted = {item for item, label in labels.items() if label == "main"}
    kept: set[int] = set()
    for node in order:
        item = node.attrs.get(ID)
        if item in wanted:
            wanted.discard(item)  # only the first element of an id counts
            kept.update(id(n) for n in node.walk())
            kept.update(id(n) for n in node.ancestors())
    breaks: set[int] = set()
    for before, after in zip(order, order[1:]):
        if after.tag == "br" and before.tag != "br" and id(before) in kept:
            breaks.add(id(after))
        if before.tag == "br" and after.tag != "br" and id(after) in kept:
            breaks.add(id(before))
    return kept | breaks


def main_html(map_html: str | None, labels: dict[str, str], empty_as_blank: bool = False) -> str:
    """The page with the elements labelled main, all below and above them, and the line breaks beside them. The root
    always stays; empty_as_blank gives "" instead of an empty shell if there are no labels."""
    if not map_html or empty_as_blank and not labels:
        return ""
    root = parse(map_html)
    kept = _kept(root, labels)
    todo = [root]
    while todo:
        node = todo.pop()
        for kid in list(node.kids):
            if id(kid) in kept:
                todo.append(kid)
            else:
                kid.drop(keep_tail=False)
    for wrapper in [n for n in root.below() if n.tag == WRAPPER]:
        wrapper.unwrap()
    return decode_urls(outer_html(root))


def unescaped_html(markup: str | None) -> str:
    """Markup with all character references resolved, also those in text."""
    return html.unescape(markup or "")
