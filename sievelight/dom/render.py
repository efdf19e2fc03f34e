"""Renders HTML as Markdown or as plain text."""

from __future__ import annotations

import re

from .builder import HEADINGS, parse
from .tree import Element, one_space

#: Fixed value: images that carry no content (one-pixel, spacer or placeholder images).
SPACER_IMAGE = (
    r"""(?i)<img\b[^>]*?(?:(?:width|height)\s*=\s*["']?\s*1\b"""
    r"""|src\s*=\s*["'][^"']*(?:trans(?:parent)?|spacer|blank|pixel|1x1|clear)[^"']*["']"""
    r"""|src\s*=\s*["']data:image[^"']*["'])[^>]*>"""
)
_SPACER, _IMAGE = re.compile(SPACER_IMAGE), re.compile("<[iI\u0130\u0131][mM][gG]")
_SILENT = frozenset("head script style title template noscript".split())
_PARAGRAPH = frozenset(
    "p div section article aside header footer main nav form fieldset figure figcaption address center table details summary dl".split()
)
_MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "u": "_", "code": "`", "del": "~~", "s": "~~", "strike": "~~"}


def strip_spacer_images(markup: str) -> str:
    return _SPACER.sub("", markup) if _IMAGE.search(markup) else markup  # the short search is the fast one


class _Writer:
    """Collects blocks; text goes to the open block until a break closes it."""

    def __init__(self, links: bool):
        self.links, self.blocks, self.line = links, [], []
        self.prefix: list[str] = []
        self.first = ""

    def text(self, text: str) -> None:
        self.line.append(text)

    def close(self, tight: bool = False) -> None:
        body = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(self.line)).strip(" \n")
        self.line = []
        if body:
            indent = "".join(self.prefix)
            lines = [indent + x if x else x for x in body.split("\n")]
            if self.first:
                lines[0] = indent[: len(indent) - len(self.first)] + self.first + lines[0][len(indent) :]
                self.first = ""
            self.blocks.append(("\n".join(lines), tight))

    def result(self) -> str:
        self.close()
        out = []
        for k, (block, tight) in enumerate(self.blocks):
            if k:
                out.append("\n" if tight and self.blocks[k - 1][1] else "\n\n")
            out.append(block)
        return "".join(out).strip()


def _write(node: Element, to: _Writer, tight: bool = False) -> None:
    tag = node.tag
    if tag in _SILENT:
        return
    if tag == "br":
        to.text("  \n" if to.links else "\n")
        return
    if tag == "hr":
        to.close()
        to.text("* * *")
        to.close()
        return
    if tag == "img":
        if to.links and node.attrs.get("src"):
            to.text(f"![{node.attrs.get('alt', '')}]({node.attrs['src']})")
        return
    if tag == "pre":
        to.close()
        to.blocks.append(("\n".join("    " + x for x in node.all_text().strip("\n").split("\n")), False))
        return
    if tag in HEADINGS:
        to.close()
        to.text("#" * int(tag[1]) + " ")
        _inside(node, to)
        to.close()
    elif tag in ("ul", "ol"):
        to.close(tight)
        n = 0
        to.prefix.append("")
        to.text(one_space(node.text))
        for kid in node.kids:
            if kid.tag == "li":
                to.close(tight=True)
                n += 1
                mark = "  * " if tag == "ul" else f"  {n}. "
                to.prefix[-1] = " " * len(mark)
                to.first = mark
                _inside(kid, to, tight=True)
                to.close(tight=True)
                to.first = ""
            else:  # misplaced content, under the item before it
                _write(kid, to, tight=True)
            to.text(one_space(kid.tail))
        to.close(tight=True)
        to.prefix.pop()
    elif tag == "blockquote":
        to.close()
        to.prefix.append("> ")
        _inside(node, to)
        to.close()
        to.prefix.pop()
    elif tag == "tr":
        to.close(tight=True)
        cells = [k for k in node.kids if k.tag in ("td", "th")]
        for k, cell in enumerate(cells):
            if k:
                to.text(" | ")
            inner = _Writer(to.links)
            _inside(cell, inner)
            to.text(one_space(inner.result()))
        to.close(tight=True)
        if cells and all(c.tag == "th" for c in cells):
            to.text(" | ".join("---" for _ in cells))
            to.close(tight=True)
        to.text(one_space(node.text))  # misplaced content, after the row
        for kid in node.kids:
            if kid.tag in ("td", "th"):
                to.text(" ")
            else:
                _write(kid, to)
            to.text(one_space(kid.tail))
        to.close()
    elif tag == "dd":
        to.close(tight=True)
        to.prefix.append("    ")
        _inside(node, to)
        to.close(tight=True)
        to.prefix.pop()
    elif tag in _PARAGRAPH or tag in ("dt", "li", "body", "html", "tbody", "thead", "tfoot", "caption", "td", "th"):
        to.close(tight)
        _inside(node, to)
        to.close(tight)
    elif tag == "a" and to.links and node.attrs.get("href"):
        to.text("[")
        _inside(node, to)
        to.text(f"]({node.attrs['href']})")
    elif tag in _MARKS and to.links and node.all_text().strip():
        to.text(_MARKS[tag])
        _inside(node, to)
        to.text(_MARKS[tag])
    else:
        _inside(node, to)


def _inside(node: Element, to: _Writer, tight: bool = False) -> None:
    to.text(one_space(node.text))
    for kid in node.kids:
        _write(kid, to, tight)
        to.text(one_space(kid.tail))


def markdown(markup: str | None) -> str:
    """Markdown with links and images; spacer images are left out."""
    to = _Writer(links=True)
    _write(parse(strip_spacer_images(markup or "")), to)
    return to.result()


def plain_text(markup: str | None) -> str:
    """The same without links, images and emphasis, for scoring."""
    to = _Writer(links=False)
    _write(parse(markup or ""), to)
    return to.result()
