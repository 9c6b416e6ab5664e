"""Leaf blocks of HTML pages, with the ancestors, links and place of each.

A block is the visible text between two tags other than the inline ones;
script, style, noscript and title are not visible; entities are decoded, white
space is collapsed.  One forward scan with a tag tokenizer, tolerant of
unclosed and stray tags: an end tag closes up to its nearest open start tag and
is ignored without one.
"""

from __future__ import annotations

import html as _html
import re

# Tags that do not end a block, that have no content, whose text is not visible.
INLINE = frozenset("a b i em strong span".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript title".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>|<\?[^>]*>", re.S)
_HREF = re.compile(r"""(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Block:
    __slots__ = ("text", "tags", "parent", "holder", "hrefs", "linked", "cells")

    def __init__(self, text: str, tags: tuple[str, ...], parent: int, holder: int, hrefs: list[str], linked: int):
        self.text, self.tags, self.parent, self.holder, self.hrefs, self.linked = text, tags, parent, holder, hrefs, linked


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in reading order.  Null and empty pages have none."""
    out: list[Block] = []
    if not page:
        return out
    names, ids = ["#"], [0]  # open elements other than inline ones
    nodes = 0
    text: list[str] = []
    hrefs: list[str] = []
    linked, in_link = 0, False
    pos, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        joined = "".join(text)
        if joined:
            clean = " ".join((_html.unescape(joined) if "&" in joined else joined).split())
            if clean:
                out.append(Block(clean, tuple(names), ids[-1], ids[-2] if len(ids) > 1 else 0, hrefs[:], min(linked, len(clean))))
                hrefs.clear()
        text.clear()
        linked = 0

    find = _TAG.search
    while True:
        m = find(page, pos)
        piece = page[pos : m.start() if m else size]
        if piece:
            text.append(piece)
            if in_link:
                linked += len(" ".join(piece.split()))
        if not m:
            break
        pos = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        closing = m.group(1)
        if name in INLINE:
            if name == "a":
                in_link = not closing
                if in_link and (h := _HREF.search(m.group(3))):
                    hrefs.append(_html.unescape(h.group(1) or h.group(2) or h.group(3) or ""))
            continue
        flush()
        if name in HIDDEN:
            if not closing and not m.group(3).endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
                pos = end.end() if end else size
            continue
        if closing:
            if name in names:
                cut = len(names) - 1 - names[::-1].index(name)
                if cut:
                    del names[cut:], ids[cut:]
        elif name not in VOID and not m.group(3).endswith("/"):
            nodes += 1
            names.append(name)
            ids.append(nodes)
        elif name == "hr":
            nodes += 1
    flush()
    return out


_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>", re.S)
_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*>"""
_HIDDEN = "|".join(sorted(HIDDEN))
_EDGE = re.compile(rf"<(?:{_HIDDEN})(?![\w:-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>.*?(?:</(?:{_HIDDEN})\s*>|\Z)|</?(?!(?:{'|'.join(sorted(INLINE))})(?![\w:-]))[a-zA-Z]{_ATTRS}", re.S | re.I)
_INNER = re.compile(rf"</?[a-zA-Z]{_ATTRS}", re.S)


def block_texts(page: str | None) -> set[str]:
    """The distinct texts of a page's blocks, without their places: a fraction of the work of :func:`blocks`."""
    if not page:
        return set()
    if "<!" in page or "<?" in page:
        page = _COMMENT.sub("", page)
    out = set()
    for piece in _EDGE.split(page):
        if piece and not piece.isspace():
            if "<" in piece:
                piece = _INNER.sub("", piece)
            if "&" in piece:
                piece = _html.unescape(piece)
            text = " ".join(piece.split())
            if text:
                out.add(text)
    return out
