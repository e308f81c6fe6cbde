"""Sections of marked-up documents."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the document, those that open a section, and those that hold its text.
SKIPPED, HEADINGS, BLOCKS = {"script", "style", "nav", "footer", "noscript", "template"}, {"h1", "h2", "h3", "h4"}, {"p", "li", "td", "th", "pre"}
#: Ids of the containers that hold a page's content, the wider first, and ids and classes of what surrounds it.
ROOTS = ("segment-content", "tabs")
CHROME_IDS, CHROME_CLASSES = {"segment-breadcrumb", "segment-footer", "segment-navbar", "segment-header"}, {"nav", "navbar"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What the start of an element closes: an open paragraph, list item or cell, up to the element that may hold another one.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"td", "th", "tr"}, {"table"})}
OPENERS = HEADINGS | {"p", "pre", "div", "ul", "ol", "table", "section", "article"}
NUMBER = re.compile(r"^((?:\d+\.)*\d+)\s+(.*)$", re.S)
SCHEMA = "section_no int, section string, heading string, body string"


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("\xa0", " ")).strip()


def _cleaned(text: str) -> str:
    """TXT-1 for a text in Python."""
    text = re.sub(r"[ \t]+", " ", text.replace("\xa0", " ").replace("\u2011", "-"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")[:40] or "sec"


class _Sections(HTMLParser):
    """Headings and blocks in the order of the document; text of a nested block belongs to all blocks around it.

    Every block has the pieces of text in it and the root containers around it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, str | None, int | None]] = []  # tag, skipped, root container, block
        self.events: list[tuple[str, list[str], set[str]]] = []
        self.roots: set[str] = set()

    def _close(self, tags: set[str], within: set[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in within:
                return
            if self.stack[k][0] in tags:
                del self.stack[k:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        if tag in OPENERS:
            self._close({"p"}, {"li", "td", "th", "div", "table"})
        elif tag in CLOSES:
            self._close(*CLOSES[tag])
        named = {k: v or "" for k, v in attrs}
        root = named.get("id") if tag == "div" and named.get("id") in ROOTS and named.get("id") not in self.roots else None
        if root:
            self.roots.add(root)
        skipped = tag in SKIPPED or named.get("id") in CHROME_IDS or bool(CHROME_CLASSES & set(named.get("class", "").split()))
        block = None
        if tag in HEADINGS | BLOCKS:
            block = len(self.events)
            self.events.append((tag, [], {r for _, _, r, _ in self.stack if r}))
        self.stack.append((tag, skipped, root, block))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and not any(skipped for _, skipped, _, _ in self.stack):
            for _, _, _, block in self.stack:
                if block is not None:
                    self.events[block][1].append(data)


def html_sections(text: str | None) -> list[tuple[int, str, str, str]]:
    """TXT-2: (number, section, heading, body) of an HTML text; sections without a body are left out.

    Only the page's content container is read, where it has one, without navigation and footers. Pieces of text of a
    block are joined by spaces. A heading's leading number is the section's id and what follows its heading; one without
    a number has its slug as id. What comes before the first heading is section 0, Preamble. Broken markup is read as far
    as it goes; a text without markup gives no section.
    """
    parser = _Sections()
    parser.feed(text or "")
    parser.close()
    root = next((r for r in ROOTS if r in parser.roots), None)
    sections: list[tuple[str, str, list[str]]] = [("0", "Preamble", [])]
    for tag, pieces, around in parser.events:
        content = " ".join(pieces)
        if not content or (root and root not in around):
            continue
        if tag in HEADINGS:
            m = NUMBER.match(content)
            sections.append((m[1], m[2], []) if m else (_slug(content), content, []))
        else:
            sections[-1][2].append(content)
    bodies = [(s, h, _cleaned("\n".join(b))) for s, h, b in sections]
    return [(k, s, h, b) for k, (s, h, b) in enumerate(bodies) if b]


def xml_sections(text: str | None, unit: str = "DIV8", head: str = "HEAD", blocks: tuple[str, ...] = ("P", "FP"), number: str = "N") -> list[tuple[int, str, str, str]]:
    """TXT-3: (number, section, heading, body) of each unit of an XML text, inner tags' text included; none if malformed."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    found = []
    for k, div in enumerate(root.iter(unit)):
        heading = div.find(head)
        body = [_squeezed(" ".join(x.itertext())) for x in div.iter() if x.tag in blocks]
        if any(body):
            found.append((k, _squeezed(div.get(number) or ""), _squeezed(" ".join(heading.itertext())) if heading is not None else "", "\n".join(b for b in body if b)))
    return found


def sections(df: DataFrame, key: str, text: str, kind: str = "html") -> DataFrame:
    """key, section_no, section, heading, body of marked-up texts; a narrow pass. Null texts give no rows."""
    parse = {"html": html_sections, "xml": xml_sections}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                found = parse(t)
                at += [row] * len(found)
                rows += found
            cols = list(zip(*rows)) or [[], [], [], []]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["_key", "section_no", "section", "heading", "body"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where("_text is not null")
    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("_key", key)
