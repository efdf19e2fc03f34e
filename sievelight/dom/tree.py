"""A small document tree: elements with text before their first child and after themselves."""

from __future__ import annotations

from collections.abc import Iterator

#: Fixed values of HTML: elements without content, and elements whose text is not escaped.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())


class Element:
    __slots__ = ("tag", "attrs", "text", "tail", "kids", "up", "origin")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text, self.tail = tag, attrs if attrs is not None else {}, text, ""
        self.kids: list[Element] = []
        self.up: Element | None = None
        self.origin: Element | None = None

    def append(self, kid: Element) -> Element:
        kid.up = self
        self.kids.append(kid)
        return kid

    def insert(self, at: int, kid: Element) -> None:
        kid.up = self
        self.kids.insert(at, kid)

    def place(self) -> int:
        """Index below its parent; elements compare by identity."""
        return next(i for i, kid in enumerate(self.up.kids) if kid is self)

    def add_text(self, text: str) -> None:
        """Appends text behind everything in the element."""
        if self.kids:
            self.kids[-1].tail += text
        else:
            self.text += text

    def walk(self) -> Iterator[Element]:
        """The element and all below it, in document order; the tree must not change meanwhile."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            if node.kids:
                todo += node.kids[::-1]

    def below(self) -> Iterator[Element]:
        nodes = self.walk()
        next(nodes)
        return nodes

    def ancestors(self) -> Iterator[Element]:
        node = self.up
        while node is not None:
            yield node
            node = node.up

    def nearest(self, tags: frozenset[str] | set[str]) -> Element | None:
        """The element itself or its nearest ancestor of one of the tags."""
        node: Element | None = self
        while node is not None and node.tag not in tags:
            node = node.up
        return node

    def copy(self, tail: bool = True) -> Element:
        """A deep copy whose elements know the ones they were made from: origin is the first original."""
        made = self.shell()
        made.text = self.text
        made.tail = self.tail if tail else ""
        todo = [(self, made)]
        while todo:
            source, target = todo.pop()
            for kid in source.kids:
                twin = kid.shell()
                twin.text, twin.tail = kid.text, kid.tail
                target.append(twin)
                if kid.kids:
                    todo.append((kid, twin))
        return made

    def shell(self) -> Element:
        made = Element(self.tag, dict(self.attrs))
        made.origin = self.origin or self
        return made

    def drop(self, keep_tail: bool) -> None:
        """Takes the element out of its parent, with or without the text that follows it."""
        at, parent = self.place(), self.up
        if keep_tail and self.tail:
            if at:
                parent.kids[at - 1].tail += self.tail
            else:
                parent.text += self.tail
        del parent.kids[at]
        self.up = None

    def unwrap(self) -> None:
        """Puts the element's content in its place."""
        at, parent = self.place(), self.up
        if self.text:
            if at:
                parent.kids[at - 1].tail += self.text
            else:
                parent.text += self.text
        if self.kids:
            self.kids[-1].tail += self.tail
        elif self.tail:
            if at:
                parent.kids[at - 1].tail += self.tail
            else:
                parent.text += self.tail
        for kid in self.kids:
            kid.up = parent
        parent.kids[at : at + 1] = self.kids
        self.up, self.kids = None, []

    def all_text(self) -> str:
        """The text within the element."""
        parts: list[str] = []
        todo: list[tuple[Element, bool]] = [(self, False)]
        while todo:
            node, done = todo.pop()
            if done:
                parts.append(node.tail)
                continue
            parts.append(node.text)
            if node is not self:
                todo.append((node, True))
            todo.extend((kid, False) for kid in reversed(node.kids))
        return "".join(parts)


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;")


def one_space(text: str) -> str:
    """The text with each run of white space as one space."""
    words = " ".join(text.split())
    if not words:
        return " " if text else ""
    return f"{' ' if text[0].isspace() else ''}{words}{' ' if text[-1].isspace() else ''}"


def outer_html(root: Element) -> str:
    """The element as HTML, without its tail."""
    parts: list[str] = []
    todo: list[Element | str] = [root]  # strings: what follows an element's content
    while todo:
        node = todo.pop()
        if node.__class__ is str:
            parts.append(node)
            continue
        tag = node.tag
        if node.attrs:
            attrs = "".join([f' {k}="{escape_attribute(v)}"' for k, v in node.attrs.items()])
            parts.append(f"<{tag}{attrs}>")
        else:
            parts.append(f"<{tag}>")
        if node.text:
            parts.append(node.text if tag in RAW else escape_text(node.text))
        after = "" if tag in VOID else f"</{tag}>"
        if node.tail and node is not root:
            after += escape_text(node.tail)
        if node.kids:
            todo.append(after)
            todo += node.kids[::-1]
        else:
            parts.append(after)
    return "".join(parts)
