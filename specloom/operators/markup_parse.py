"""Marked-up documents to flat tables. Arbitrary depth needs a parser: a table function in Python reads a
document event by event and gives rows of all tables, each with the kind of its table. What it holds
is the elements of CHUNK characters and of one block (or of another child of a section or of the back matter), the rows of
the blocks of open sections, and the rows of references and definitions, whose order is known at the
end only; never a document's tree. There is no shuffle."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import text as X
from specloom.operators.parsed import BLOCKS, DEFINITIONS, DOCS, REFS, SECTIONS, Parsed
from specloom.storage import materialise

KEYWORD_TAG = r"(?i)<bcp14[^>]*>([^<]+)</bcp14>"
_KNOWN_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)")
_DOCTYPE = re.compile(r"<!DOCTYPE[^\[>]*(?:\[.*?\])?\s*>", re.S)


#: Characters given to the parser at once.
CHUNK = 1 << 13


def clean(body: str) -> str:
    """Without prolog (the text is decoded already), with unknown entities as plain text."""
    text = _KNOWN_ENTITY.sub("&amp;", _DOCTYPE.sub("", body)).lstrip("\ufeff \t\r\n")
    return re.sub(r"^<\?xml[^>]*\?>", "", text)


def inner_text(node: ET.Element | None) -> str:
    """A node's own text, trimmed piece by piece; only where it has none, that of its children,
    grouped by tag in order of first appearance and joined by spaces."""
    if node is None:
        return ""
    own = "".join(p.strip() for p in [node.text or "", *(c.tail or "" for c in node)])
    if own:
        return own
    groups: dict[str, list[ET.Element]] = {}
    for c in node:
        groups.setdefault(c.tag, []).append(c)
    found = []
    for g in groups.values():  # plain loops: Python's own calls may nest as deep as elements do
        for c in g:
            if t := inner_text(c):
                found.append(t)
    return " ".join(found)


def _is_empty(node: ET.Element) -> bool:
    return not node.attrib and not len(node) and not (node.text or "").strip()


def _targets(node: ET.Element) -> list[str]:
    """Targets of the reference tags below a node: its own first, then those deeper, grouped by tag."""
    groups: dict[str, list[ET.Element]] = {}
    for c in node:
        groups.setdefault(c.tag, []).append(c)
    out = [t for c in groups.get("xref", []) if (t := c.get("target"))]
    for g in groups.values():
        for c in g:
            out += _targets(c)
    return out


def _number(text: str | None) -> int | None:
    found = re.match(r"\s*([+-]?\d+)", text or "")
    return int(found[1]) if found else None


@dataclass
class _Open:
    """An open element whose children are read one by one: the root, middle, back, sections, references."""

    kind: str
    elem: ET.Element
    path: tuple[int, ...]
    label: str
    tags: dict[str, list[int]] = field(default_factory=dict)
    seq: int | None = None
    parent: int | None = None
    depth: int = 0
    own: str | None = None
    name: ET.Element | None = None
    blocks: dict[str, list[tuple]] = field(default_factory=dict)
    number: int = 0
    refs: list[tuple[bool, tuple]] = field(default_factory=list)

    def place(self, tag: str) -> tuple[int, ...]:
        """Where a child's definitions come among those of its siblings: tags by first appearance."""
        at = self.tags.setdefault(tag, [len(self.tags), -1])
        at[1] += 1
        return (*self.path, 1, *at)


#: What is read child by child, by the kind of its parent.
_CONTAINERS = {("root", "middle"): "middle", ("root", "back"): "back", ("middle", "section"): "section", ("section", "section"): "section", ("back", "references"): "references", ("references", "references"): "references"}
_STYLES = {"ul": "symbols", "ol": "numbers"}
#: The order of a section's blocks.
_BLOCK_TAGS = ("t", "ul", "ol", "sourcecode", "artwork")


def _events(text: str) -> Iterator[tuple[str, ET.Element]]:
    pull = ET.XMLPullParser(("start", "end"))
    for begin in range(0, len(text), CHUNK):
        pull.feed(text[begin : begin + CHUNK])
        yield from pull.read_events()
    pull.close()  # the parser may hold events back until then
    yield from pull.read_events()


class Reader:
    """Rows (kind, values) of one document."""

    def __init__(self, doc_id: int) -> None:
        self.doc_id, self.title, self.n_sections, self.n_containers = doc_id, None, 0, 0
        self.refs: list[tuple] = []
        self.definitions: list[tuple] = []

    def rows(self, body: str) -> Iterator[tuple[str, tuple]]:
        text = clean(body)
        expat.ParserCreate().Parse(text, True)  # broken markup raises before any row is given
        stack: list[_Open] = []
        inside = 0  # depth below a container's child that is read whole
        place: tuple[int, ...] = ()
        root = None
        for event, elem in _events(text):
            if event == "start":
                if inside:
                    inside += 1
                elif not stack:
                    root = elem
                    stack.append(_Open("root", elem, (), ""))
                else:
                    place = stack[-1].place(elem.tag)
                    kind = _CONTAINERS.get((stack[-1].kind, elem.tag))
                    if kind:
                        stack.append(self._opened(stack[-1], kind, elem, place))
                    else:
                        inside = 1
            elif inside:
                inside -= 1
                if not inside:
                    self._child(stack[-1], elem, place)
                    del stack[-1].elem[:]
            else:
                closed = stack.pop()
                yield from self._closed(closed)
                if stack:
                    del stack[-1].elem[:]
        yield "doc", (self.doc_id, "xml", self.title or "Untitled", _number(root.get("number")), root.get("docName"))
        for i, (*_, values) in enumerate(sorted(self.refs)):
            yield "ref", (self.doc_id, i, *values)
        for i, (_, term, said, section) in enumerate(sorted(self.definitions)):
            yield "definition", (self.doc_id, i + 1, term, said, section)

    def _opened(self, parent: _Open, kind: str, elem: ET.Element, place: tuple[int, ...]) -> _Open:
        out = _Open(kind, elem, place, parent.label)
        if kind == "section":
            self.n_sections += 1
            number, anchor = elem.get("pn") or elem.get("numbered"), elem.get("anchor")
            out.own = number or anchor or ("" if parent.own is None else f"{parent.own}.")
            out.seq, out.parent, out.depth, out.label = self.n_sections, parent.seq, parent.depth + 1, elem.get("pn") or anchor or ""
        elif kind == "references":
            self.n_containers += 1
            out.number = self.n_containers
        return out

    def _child(self, parent: _Open, elem: ET.Element, place: tuple[int, ...]) -> None:
        """An element that is complete, below an open one."""
        tag = elem.tag
        if tag == "dl":
            self._defined(elem, (*parent.path, 0, parent.tags[tag][1]), parent.label)
        self._definition_lists(elem, place, (elem.get("pn") or elem.get("anchor") or "") if tag == "section" else parent.label)
        if parent.kind == "root" and tag == "front" and self.title is None and (title := elem.find("title")) is not None:
            self.title = inner_text(title)
        if tag == "name" and parent.name is None:
            parent.name = elem
        if parent.kind == "section":
            self._block(parent, tag, elem)
        elif parent.kind == "references":
            parent.refs += [(tag == "referencegroup", self._reference(r)) for r in ([elem] if tag == "reference" else elem.findall("reference") if tag == "referencegroup" else [])]

    def _block(self, section: _Open, tag: str, elem: ET.Element) -> None:
        """type, style, language, content, items, tag_targets."""
        made = section.blocks.setdefault(tag, [])
        if tag == "t":
            if said := inner_text(elem):
                made.append(("text", None, None, said, None, _targets(elem)))
        elif tag in _BLOCK_TAGS and not _is_empty(elem):
            if tag in _STYLES:
                made.append(("list", _STYLES[tag], None, None, [inner_text(li) for li in elem.findall("li")], None))
            else:
                made.append((tag, None, elem.get("type") if tag == "sourcecode" else None, inner_text(elem), None, None))

    def _closed(self, x: _Open) -> Iterator[tuple[str, tuple]]:
        if x.kind == "section":
            title = inner_text(x.name) or "Untitled Section"
            yield "section", (self.doc_id, x.seq, x.parent, x.depth, x.elem.get("pn") or x.elem.get("numbered"), x.elem.get("anchor"), x.own, title)
            for i, block in enumerate(b for tag in _BLOCK_TAGS for b in x.blocks.get(tag, [])):
                yield "block", (self.doc_id, x.seq, i, *block, x.own, title)
        elif x.kind == "references":
            said = [inner_text(x.name), x.elem.get("anchor") or "", x.elem.get("pn") or "", (x.name.get("slugifiedName") or "") if x.name is not None else ""]
            informative = not any("normative" in s.lower() for s in said)
            # normative ones first, then by container, then those of groups after the others
            self.refs += [(informative, x.number, grouped, i, ("informative" if informative else "normative", *ref)) for i, (grouped, ref) in enumerate(x.refs)]

    def _reference(self, ref: ET.Element) -> tuple:
        """anchor, rfc_number, title, target."""
        numbers = [s.get("value") for s in ref.findall("seriesInfo") if s.get("name") == "RFC"]
        return ref.get("anchor") or "", _number(numbers[-1]) if numbers else None, inner_text(ref.find("front/title")), ref.get("target")

    def _defined(self, dl: ET.Element, path: tuple[int, ...], section: str) -> None:
        pairs = zip(map(inner_text, dl.findall("dt")), map(inner_text, dl.findall("dd")))
        self.definitions += [((*path, i), term, said, section) for i, (term, said) in enumerate(pairs) if term and said]

    def _definition_lists(self, node: ET.Element, path: tuple[int, ...], section: str) -> None:
        """Those below a node: its own lists first, then those deeper, tag by tag."""
        for i, dl in enumerate(node.findall("dl")):
            self._defined(dl, (*path, 0, i), section)
        tags: dict[str, list[int]] = {}
        for c in node:
            at = tags.setdefault(c.tag, [len(tags), -1])
            at[1] += 1
            self._definition_lists(c, (*path, 1, *at), (c.get("pn") or c.get("anchor") or "") if c.tag == "section" else section)


_TABLES = {"doc": DOCS, "section": SECTIONS, "block": BLOCKS, "ref": REFS, "definition": DEFINITIONS}
_SCHEMA = "kind string, " + ", ".join(f"{name} struct<{', '.join(x.replace(' ', ': ', 1) for x in columns.split(', '))}>" for name, columns in _TABLES.items()) + ", error string"


class _Parse:
    """A row for each row of the flat tables; broken markup gives one row that says why."""

    def __init__(self) -> None:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))  # elements nest as deep as they like

    def eval(self, doc_id: int, body: str) -> Iterator[tuple]:
        at = {kind: i for i, kind in enumerate(_TABLES)}
        try:
            for kind, values in Reader(doc_id).rows(body):
                cells = [None] * len(at)
                cells[at[kind]] = values
                yield kind, *cells, None
        except (expat.ExpatError, ET.ParseError) as e:
            yield "error", (doc_id, "xml", None, None, None), *[None] * (len(at) - 1), str(e)


def parse_events(raw: DataFrame) -> DataFrame:
    """``raw`` (doc_id, body) -> kind, a struct for each table of which one is filled, error."""
    parse = F.udtf(_Parse, returnType=_SCHEMA, useArrow=False)
    normal = F.regexp_replace(F.coalesce("body", F.lit("")), KEYWORD_TAG, "$1")
    documents = raw.select(F.col("doc_id").cast("int").alias("doc_id"), normal.alias("body"))
    return documents.lateralJoin(parse(F.col("doc_id").outer(), F.col("body").outer())).drop("doc_id", "body")


def tables_of(rows: DataFrame) -> Parsed:
    """The flat tables in the rows of ``parse_events``. Documents whose markup is broken have none."""
    return Parsed(*(rows.where(F.col("kind") == kind).select(f"{kind}.*") for kind in _TABLES))


def errors_of(rows: DataFrame) -> DataFrame:
    """doc_id and error of documents whose markup is broken."""
    return rows.where("kind = 'error'").select("doc.doc_id", "error")


def parse_markup(raw: DataFrame, once: bool = False) -> Parsed:
    """``raw`` (doc_id, body) -> the flat tables. A plan that uses several of them parses once for each; with
    ``once`` the rows of all are written to the shared folder in one pass, and the tables are read there."""
    rows = parse_events(raw)
    return tables_of(materialise(rows, "parsed-markup", "kind") if once else rows)


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, tag, ord, text of a page's h1, p and li, which needn't be well formed; native."""
    def tagged(tag: str) -> Column:
        inside = F.regexp_extract_all("html", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
        return F.transform(inside, lambda x, i: F.struct(F.lit(tag).alias("tag"), i.alias("ord"), X.trim(F.regexp_replace(x, "<[^>]*>", "")).alias("text")))

    found = [tagged(tag) for tag in ("h1", "p", "li")]
    return pages.select("page_id", F.explode(F.concat(*found)).alias("b")).select("page_id", "b.*").where("text <> ''")


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, ord, href."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("ord", "href"))
