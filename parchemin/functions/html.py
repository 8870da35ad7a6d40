"""HTML without a parser library: a light tree, the content root, sections, tables, links and dates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

from .. import vocab

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags and class parts that are never content; header and footer go too where the whole page is the root.
DROPPED = {"script", "style", "nav", "aside", "iframe", "noscript", "svg"}
PAGE_DROPPED = DROPPED | {"header", "footer"}
DROPPED_CLASSES = ("menu-push", "breadcrumb", "pager", "pagination", "nav-", "share-", "social", "cookie", "back-to-top")


class Element:
    """A tag with its attributes and children (elements and strings)."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Element]:
        """All elements in document order, itself first; iterative, so that depth is no limit."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def text(self, separator: str = " ", dropped: frozenset[str] | set[str] = frozenset()) -> str:
        """Texts of all descendants, each once, white space as one blank."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node is self or not (node.tag in dropped or node.noise(dropped)):
                stack.extend(reversed(node.children))
        return " ".join(separator.join(out).split())

    def noise(self, dropped: frozenset[str] | set[str]) -> bool:
        return bool(dropped) and any(part in self.attrs.get("class", "").lower() for part in DROPPED_CLASSES)

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1].tag == tag:
            self.open.pop()
        node = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Element:
    """Tree of a page; broken markup closes what is open, null is an empty page."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def content_root(page: Element) -> tuple[Element, bool]:
    """The first of the known content blocks, else the page; and whether a block was found."""
    tests = (lambda e: e.has_class("region-content"), lambda e: e.tag == "main", lambda e: e.tag == "article", lambda e: e.has_class("field-name-body"))
    for test in tests:
        for node in page.walk():
            if test(node):
                return node, True
    return page, False


def main_text(html: str | None, most: int | None = 4000) -> str:
    """Text of the content root; the middle of one longer than ``most`` characters is left out, nothing where that is None."""
    root, found = content_root(parse(html))
    text = root.text(dropped=DROPPED if found else PAGE_DROPPED)
    if most is None or len(text) <= most:
        return text
    half = most // 2
    return f"{text[:half]}\n[...]\n{text[-half:]}"


def preview(html: str | None, words: int = 800) -> str:
    """``Titre:`` with the first h1 or title of the page, and the first words of the content root."""
    page = parse(html)
    title = next((e.text() for e in page.walk() if e.tag in ("h1", "title")), "")
    return f"Titre: {title}\n\n" + " ".join(content_root(page)[0].text(dropped=PAGE_DROPPED).split()[:words])


def table_rows(table: Element) -> list[list[str]]:
    """Cells of each row that has any text."""
    rows = []
    for node in table.walk():
        if node.tag == "tr":
            cells = [c.text() for c in node.walk() if c.tag in ("td", "th")]
            if any(cells):
                rows.append(cells)
    return rows


def sections(html: str | None) -> list[dict]:
    """Sections in document order: h2 and h3 open one, p and ul add to it, a table stands for itself ({text, heading, rows})."""
    root, _ = content_root(parse(html))
    out: list[dict] = []
    now = {"text": "", "heading": "", "rows": None}

    def flush() -> None:
        if now["text"].strip():
            out.append({**now, "text": now["text"].strip()})

    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            continue
        if node is not root and (node.tag in PAGE_DROPPED or node.noise(DROPPED)):
            continue
        if node.tag in ("h2", "h3"):
            flush()
            now = {"text": node.text(), "heading": node.text(), "rows": None}
        elif node.tag == "table":
            flush()
            rows = table_rows(node)
            if len(rows) > 1:
                out.append({"text": "", "heading": now["heading"], "rows": rows})
            elif node.text():
                out.append({"text": node.text(), "heading": now["heading"], "rows": None})
            now = {"text": "", "heading": now["heading"], "rows": None}
        elif node.tag in ("p", "ul"):
            now["text"] += " " + node.text()
        else:
            stack.extend(reversed(node.children))
    flush()
    return out


def links(html: str | None, base: str, domain: str | None = None) -> list[tuple[str, str]]:
    """(kind, URL) of links and resources, resolved and without fragment, each once; only web URLs, of the domain if one is given."""
    found = []
    for node in parse(html).walk():
        source = {"a": "href", "img": "src", "iframe": "src", "embed": "src", "object": "data"}.get(node.tag)
        value = node.attrs.get(source, "") if source else ""
        if value:
            url = urldefrag(urljoin(base, value)).url
            place = urlparse(url)
            if place.scheme in ("http", "https") and (domain is None or place.netloc == domain or place.netloc.endswith("." + domain)):
                found.append(({"a": "link", "img": "image", "iframe": "frame"}.get(node.tag, "embed"), url))
    return list(dict.fromkeys(found))


def page_dates(html: str | None) -> list[str]:
    """ISO dates of a page: dated spans (dd/mm/yyyy), dated paragraphs (day, French month, year), then time tags."""
    page = parse(html)
    months = {name: number for number, name in enumerate(vocab.MONTHS, 1)}
    out = []
    for node in page.walk():
        if node.tag == "span" and node.has_class("element-date") and (m := re.search(r"(\d{2})/(\d{2})/(\d{4})", node.text())):
            out.append(f"{m[3]}-{m[2]}-{m[1]}")
    for node in page.walk():
        if node.tag == "p" and node.has_class("date") and (m := re.search(r"(\d{1,2})\s+(\w+)\s+(\d{4})", node.text().lower())) and m[2] in months:
            out.append(f"{m[3]}-{months[m[2]]:02}-{int(m[1]):02}")
    return out + [node.attrs["datetime"][:10] for node in page.walk() if node.tag == "time" and node.attrs.get("datetime")]
