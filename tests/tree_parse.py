"""Markup read as a whole tree: the plain way, which the event parser must agree with."""

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from specloom.operators.markup_parse import _is_empty, _targets, clean, inner_text


class Document:
    """The rows of one parsed document."""

    def __init__(self, doc_id: int, body: str) -> None:
        self.root = root = ET.fromstring(clean(body))
        self.doc_id, self.sections, self.blocks, self.refs, self.definitions = doc_id, [], [], [], []
        title = inner_text(root.find("front/title")) or "Untitled"
        number = re.match(r"\s*([+-]?\d+)", root.get("number") or "")
        self.doc = {"doc_id": doc_id, "source": "xml", "title": title, "number": int(number[1]) if number else None, "doc_name": root.get("docName")}
        for sec in root.findall("middle/section"):
            self._section(sec, None, 1, None)
        for kind in ("normative", "informative"):  # each kind in document order
            for container in self._containers(root.findall("back/references")):
                if self._kind(container) == kind:
                    for ref in [*container.findall("reference"), *container.findall("referencegroup/reference")]:
                        self._reference(ref, kind)
        self._definition_lists(root, "")

    def _section(self, sec: ET.Element, parent: int | None, depth: int, parent_id: str | None) -> None:
        number, anchor = sec.get("pn") or sec.get("numbered"), sec.get("anchor")
        own = number or anchor or ("" if parent_id is None else f"{parent_id}.")
        seq = len(self.sections) + 1
        self.sections.append({"doc_id": self.doc_id, "seq": seq, "parent_seq": parent, "depth": depth, "number": number, "anchor": anchor, "section_id": own, "title": inner_text(sec.find("name")) or "Untitled Section"})
        blocks: list[dict] = [{"type": "text", "content": t, "tag_targets": _targets(p)} for p in sec.findall("t") if (t := inner_text(p))]
        for tag, style in (("ul", "symbols"), ("ol", "numbers")):
            blocks += [{"type": "list", "style": style, "items": [inner_text(li) for li in x.findall("li")]} for x in sec.findall(tag) if not _is_empty(x)]
        blocks += [{"type": "sourcecode", "language": x.get("type"), "content": inner_text(x)} for x in sec.findall("sourcecode") if not _is_empty(x)]
        blocks += [{"type": "artwork", "content": inner_text(x)} for x in sec.findall("artwork") if not _is_empty(x)]
        empty = {"style": None, "language": None, "content": None, "items": None, "tag_targets": None}
        own_title = self.sections[-1]["title"]
        self.blocks += [{"section_id": own, "section_title": own_title, "doc_id": self.doc_id, "sec_seq": seq, "block_ord": i} | empty | b for i, b in enumerate(blocks)]
        for child in sec.findall("section"):
            self._section(child, seq, depth + 1, own)

    def _containers(self, sections: list[ET.Element]) -> Iterator[ET.Element]:
        for s in sections:
            if s.find("reference") is not None or s.find("referencegroup") is not None:
                yield s
            yield from self._containers(s.findall("references"))

    def _kind(self, container: ET.Element) -> str:
        name = container.find("name")
        said = [inner_text(name), container.get("anchor") or "", container.get("pn") or "", (name.get("slugifiedName") or "") if name is not None else ""]
        return "normative" if any("normative" in x.lower() for x in said) else "informative"

    def _reference(self, ref: ET.Element, kind: str) -> None:
        numbers = [m for s in ref.findall("seriesInfo") if s.get("name") == "RFC" for m in [re.match(r"\s*([+-]?\d+)", s.get("value") or "")]]
        number = int(numbers[-1][1]) if numbers and numbers[-1] else None
        self.refs.append({"doc_id": self.doc_id, "ref_ord": len(self.refs), "kind": kind, "anchor": ref.get("anchor") or "", "rfc_number": number, "title": inner_text(ref.find("front/title")), "target": ref.get("target")})

    def _definition_lists(self, node: ET.Element, section: str) -> None:
        for dl in node.findall("dl"):
            for term, text in zip(map(inner_text, dl.findall("dt")), map(inner_text, dl.findall("dd"))):
                if term and text:
                    self.definitions.append({"doc_id": self.doc_id, "def_ord": len(self.definitions) + 1, "term": term, "definition": text, "section": section})
        groups: dict[str, list[ET.Element]] = {}
        for c in node:
            groups.setdefault(c.tag, []).append(c)
        for tag, children in groups.items():
            for c in children:
                self._definition_lists(c, (c.get("pn") or c.get("anchor") or "") if tag == "section" else section)
