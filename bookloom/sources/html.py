"""XHTML to blocks with the standard library's parser: leaves of text, without navigation and scripts."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements that are dropped with all they hold, leaves that make blocks, and elements without an end.
DROPPED = {"script", "style", "nav", "aside", "header", "footer", "form", "button", "iframe", "svg", "audio", "video", "noscript", "head"}
LEAVES = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "li"}
VOID = {"br", "hr", "img", "meta", "link", "input", "source", "wbr", "col", "area", "base", "embed", "track"}
APPARATUS = re.compile(r"\b(?:toc|landmarks|page-?list|index|footnotes?|doc-toc|doc-index|navigation|pagebreak)\b", re.I)


class Blocks(HTMLParser):
    """Collects (kind, text) of leaf blocks; a leaf that holds leaves gives way to them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.title = ""
        self._skip: list[str] = []
        self._open: list[list] = []
        self._in_title = False

    def handle_starttag(self, tag, attrs):
        named = " ".join(v or "" for k, v in attrs if k in ("epub:type", "role", "class", "id"))
        if tag == "title":
            self._in_title = True
        if self._skip:
            if tag not in VOID:
                self._skip.append(tag)
            return
        if tag in DROPPED and tag != "head" or APPARATUS.search(named) and tag not in VOID:
            self._skip.append(tag)
            return
        if tag == "br" and self._open:
            self._open[-1][1].append("\n")
        if tag in LEAVES:
            # a paragraph ends where a block begins, an item where the next one does
            if self._open and self._open[-1][0] in ("p", tag if tag == "li" else "p"):
                self._close()
            for outer in self._open:
                outer[2] = True
            self._open.append([tag, [], False])

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        if self._skip:
            if tag in self._skip:
                while self._skip.pop() != tag:
                    pass
            return
        if tag in ("ul", "ol", "div", "section", "article", "body"):
            while self._open and self._open[-1][0] in ("p", "li") and not (tag in ("div", "section", "article") and self._open[-1][0] == "li"):
                self._close()
        if tag in LEAVES and any(o[0] == tag for o in self._open):
            while self._open and self._close() != tag:
                pass

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._skip and self._open:
            self._open[-1][1].append(data)

    def _close(self) -> str:
        tag, parts, inner = self._open.pop()
        text = re.sub(r"\s+", " ", "".join(parts)).strip()
        if text and not inner:
            self.blocks.append(("heading" if tag[0] == "h" else "list" if tag == "li" else "paragraph", text))
        return tag

    def close(self):
        super().close()
        while self._open:
            self._close()


def blocks(html: str) -> tuple[str, list[tuple[str, str]]]:
    """The title and blocks of a page; broken markup gives what can be read."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.title.strip(), parser.blocks
