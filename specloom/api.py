"""The seven calls over a corpus: names and arguments to plain results, and an error envelope."""

from __future__ import annotations

import json
import logging
from collections import OrderedDict
from collections.abc import Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom import dims
from specloom.operators import checklist, markup_parse, matching, relations, requirements, structure, text_parse
from specloom.operators.parsed import Parsed

log = logging.getLogger("specloom")

_RFC = {"rfc": {"type": "number", "required": True}}
#: Name -> arguments.
TOOLS: dict[str, dict[str, dict]] = {
    "get_rfc_structure": _RFC | {"includeContent": {"type": "boolean", "default": False}},
    "get_requirements": _RFC | {"section": {"type": "string"}, "level": {"type": "string", "enum": list(dims.LEVELS)}},
    "get_definitions": _RFC | {"term": {"type": "string"}},
    "get_rfc_dependencies": _RFC | {"includeReferencedBy": {"type": "boolean", "default": False}},
    "get_related_sections": _RFC | {"section": {"type": "string", "required": True}},
    "generate_checklist": _RFC | {"role": {"type": "string", "enum": ["client", "server", "both"], "default": "both"}, "sections": {"type": "array"}, "includeSubsections": {"type": "boolean", "default": True}},
    "validate_statement": _RFC | {"statement": {"type": "string", "required": True}},
}
#: What the markup's elements are for.
SCHEMA = {
    "version": "v3",
    "spec": "RFC 7991 (superseded by rfc7991bis)",
    "documentation": "https://authors.ietf.org/rfcxml-vocabulary",
    "keyElements": {"bcp14": "Markup for RFC 2119 keywords (MUST, SHOULD, MAY, etc.)", "xref": "Internal and external references", "reference": "Bibliography references", "section": "Section structure", "t": "Text paragraph", "dl": "Definition list", "sourcecode": "Source code"},
}


class NotAvailable(Exception):
    """A document has no usable source."""


def validate_number(n: Any) -> int:
    if isinstance(n, bool) or not isinstance(n, int | float):
        raise ValueError(f"RFC number must be a number, got {type(n).__name__}")
    if n != n or n in (float("inf"), float("-inf")) or n != int(n):
        raise ValueError(f"RFC number must be an integer, got {n}")
    if n < dims.MIN_NUMBER:
        raise ValueError(f"RFC number must be positive, got {n}")
    if n > dims.MAX_NUMBER:
        raise ValueError(f"RFC number {n} seems invalid (too large)")
    return int(n)


def parse(raw: DataFrame) -> Parsed:
    """``raw`` (doc_id, source, body): marked-up and plain documents to one set of flat tables."""
    own = raw.select(F.col("doc_id").cast("int").alias("doc_id"), "source", "body")
    return markup_parse.parse_markup(own.where("source = 'xml'")).union(text_parse.parse_text(own.where("source = 'text'")))


class Recent:
    """The least recently used entry goes when a new one has no place; what goes is released."""

    def __init__(self, most: int, release=lambda x: None) -> None:
        self.most, self._release, self._kept = most, release, OrderedDict()

    def get(self, key):
        if key not in self._kept:
            return None
        self._kept.move_to_end(key)
        return self._kept[key]

    def set(self, key, value) -> None:
        self._kept.pop(key, None)
        while len(self._kept) >= self.most:
            self._release(self._kept.popitem(last=False)[1])
        self._kept[key] = value

    def has(self, key) -> bool:
        return key in self._kept

    def delete(self, key) -> bool:
        if key not in self._kept:
            return False
        self._release(self._kept.pop(key))
        return True

    def clear(self) -> None:
        for value in self._kept.values():
            self._release(value)
        self._kept.clear()

    def __len__(self) -> int:
        return len(self._kept)

    def stats(self) -> dict[str, int]:
        return {"size": len(self), "maxSize": self.most}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _present(d: dict) -> dict:
    return {k: v for k, v in d.items() if v is not None}


class Engine:
    """Calls on single documents of a corpus ``raw`` (doc_id, source, body, and optionally error).

    What a call brings to the driver is one document's result. Corpus-wide work goes through the
    operators, which take all documents at once.
    """

    def __init__(self, spark: SparkSession, raw: DataFrame, remembered: int = 50) -> None:
        self.spark, self.raw = spark, raw
        self.cache = Recent(remembered, lambda x: x[0].unpersist())

    def document(self, number: Any) -> tuple[Parsed, str]:
        n = validate_number(number)
        if (known := self.cache.get(n)) is None:
            own = self.raw.where(F.col("doc_id") == n)
            columns = ["source", *(["error"] if "error" in self.raw.columns else [])]
            found = own.select(*columns).head()
            if found is None or found["source"] is None:
                raise NotAvailable((found["error"] if found is not None and "error" in columns else None) or f"Could not fetch RFC {n}.")
            known = (parse(own).persist(), found["source"])
            self.cache.set(n, known)
            log.debug("parsed %s from %s", n, known[1])
        return known

    def _source(self, source: str, context: str) -> dict:
        return {"_source": source} | ({"_sourceNote": dims.TEXT_NOTES[context]} if source == "text" else {})

    def get_rfc_structure(self, rfc: int, includeContent: bool = False) -> dict:
        parsed, _ = self.document(rfc)
        return json.loads(structure.structure_json(parsed, includeContent).head()["structure"])

    def _requirement(self, r: dict) -> dict:
        names = {"id": "id", "level": "level", "text": "text", "subject": "subject", "action": "action", "condition": "condition", "exception": "exception", "section": "section", "section_title": "sectionTitle", "full_context": "fullContext"}
        return _present({new: r.get(old) for old, new in names.items()})

    def get_requirements(self, rfc: int, section: str | None = None, level: str | None = None) -> dict:
        parsed, source = self.document(rfc)
        found = _rows(requirements.extract_requirements(parsed, [section] if section else [], level).orderBy("req_ord"))
        by_level: dict[str, int] = {}
        for r in found:
            by_level[r["level"]] = by_level.get(r["level"], 0) + 1
        return {"rfc": rfc, "filter": {"section": section or "all", "level": level or "all"}, "stats": {"total": len(found), "byLevel": by_level}, "requirements": [self._requirement(r) for r in found]} | self._source(source, "requirements")

    def get_definitions(self, rfc: int, term: str | None = None) -> dict:
        parsed, source = self.document(rfc)
        found = [{k: d[k] for k in ("term", "definition", "section")} for d in _rows(relations.search_definitions(parsed.definitions, term).orderBy("def_ord"))]
        return _present({"rfc": rfc, "searchTerm": term, "count": len(found), "definitions": found}) | self._source(source, "definitions")

    def get_rfc_dependencies(self, rfc: int, includeReferencedBy: bool = False) -> dict:
        parsed, source = self.document(rfc)
        refs = _rows(parsed.refs.orderBy("ref_ord"))
        sides = {k: [_present({"rfcNumber": r["rfc_number"], "title": r["title"], "anchor": r["anchor"]}) for r in refs if r["kind"] == k] for k in ("normative", "informative")}
        extra = {"referencedBy": [], "_note": "referencedBy is not implemented (requires IETF Datatracker API integration)"} if includeReferencedBy else {}
        return {"rfc": rfc, **sides} | self._source(source, "dependencies") | extra

    def get_related_sections(self, rfc: int, section: str) -> dict:
        parsed, source = self.document(rfc)
        target = relations.find_section(parsed.sections, section).head()
        if target is None:
            return {"error": f"Section {section} not found"}
        related = _rows(relations.related_sections(parsed).where(F.col("sec_seq") == target["seq"]).orderBy("related_ord"))
        return {"rfc": rfc, "section": section, "title": target["title"], "relatedSections": [{"number": r["related_number"], "title": r["related_title"]} for r in related]} | self._source(source, "sections")

    def generate_checklist(self, rfc: int, role: str | None = None, sections: Sequence[str] = (), includeSubsections: bool = True) -> dict:
        parsed, source = self.document(rfc)
        items = checklist.items(requirements.extract_requirements(parsed, list(sections or ()), with_subsections=includeSubsections), role)
        counts = _rows(checklist.stats(items))
        stats = {k: counts[0][k] if counts else 0 for k in ("must", "should", "may", "total")}
        stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        text = checklist.markdown(parsed.docs, items, role, stamp).head()["markdown"]
        return {"rfc": rfc, "role": role or "both", "stats": stats, "markdown": text} | self._source(source, "checklist")

    def validate_statement(self, rfc: int, statement: str) -> dict:
        parsed, source = self.document(rfc)
        at = matching.index(requirements.extract_requirements(parsed))
        found = at.requirements
        said = self.spark.createDataFrame([(0, rfc, statement)], "stmt_id int, doc_id int, statement string")
        about = _rows(matching.validity(said, at))[0]
        matches = [self._requirement(r) | {"_matchScore": r["score"], "_matchedKeywords": r["matched_keywords"], "_subjectMatch": r["subject_match"], "_levelMatch": r["level_match"]} for r in _rows(matching.best_matches(matching.scored(said, at, dims.TOP_MATCHES)).orderBy("rank"))]
        against = [{"requirement": self._requirement(r), "reason": r["reason"]} for r in _rows(matching.conflicts(said, found).orderBy("req_ord"))]
        out = {"rfc": rfc, "statement": statement, "analysis": {"detectedLevel": about["stmt_level"], "detectedSubject": about["stmt_subject"]}, "isValid": about["is_valid"], "matchingRequirements": matches, "conflicts": against}
        return out | ({"suggestions": about["suggestions"]} if about["suggestions"] else {}) | self._source(source, "validation")

    def call(self, tool: str, **arguments) -> dict:
        """The result as JSON text; a failure gives its message and is_error."""
        try:
            if tool not in TOOLS:
                raise ValueError(f"Unknown tool: {tool}")
            return {"text": json.dumps(getattr(self, tool)(**arguments), indent=2, ensure_ascii=False), "is_error": False}
        except Exception as e:  # the envelope is what callers see of any failure
            return {"text": json.dumps({"error": str(e)}, indent=2, ensure_ascii=False), "is_error": True}

    @staticmethod
    def read_resource(uri: str) -> dict:
        if uri.rpartition("://")[2] != "schema":
            raise ValueError(f"Unknown resource: {uri}")
        return SCHEMA
