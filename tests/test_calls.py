"""Tables of calls: equal to the calls one by one, and each failure a row."""

import json

import pytest

from pyspark.sql import functions as F

from specloom import api
from specloom.operators import calls

from .test_parsing import MARKUP, TEXT

STAMP = "2024-01-01T00:00:00.000Z"
ASKED = [
    ("get_rfc_structure", {"rfc": 8999}), ("get_rfc_structure", {"rfc": 8999, "includeContent": True}), ("get_rfc_structure", {"rfc": 4242, "includeContent": True}),
    ("get_requirements", {"rfc": 8999}), ("get_requirements", {"rfc": 8999, "section": "section-1", "level": "MUST"}), ("get_requirements", {"rfc": 4242, "level": "MUST"}), ("get_requirements", {"rfc": 4242, "section": "88"}),
    ("get_definitions", {"rfc": 8999}), ("get_definitions", {"rfc": 8999, "term": "FRAME"}), ("get_definitions", {"rfc": 4242, "term": "zzz"}),
    ("get_rfc_dependencies", {"rfc": 8999, "includeReferencedBy": True}), ("get_rfc_dependencies", {"rfc": 4242}),
    ("get_related_sections", {"rfc": 8999, "section": "1"}), ("get_related_sections", {"rfc": 8999, "section": "77"}), ("get_related_sections", {"rfc": 4242, "section": "section-1"}),
    ("generate_checklist", {"rfc": 8999, "role": "client", "sections": ["1"]}), ("generate_checklist", {"rfc": 4242}), ("generate_checklist", {"rfc": 8999, "role": "server", "sections": ["2"], "includeSubsections": False}),
    ("validate_statement", {"rfc": 4242, "statement": "The client MAY send a request"}), ("validate_statement", {"rfc": 8999, "statement": "nothing of the kind"}),
]
FAILING = [
    ("nope", {"rfc": 1}, "Unknown tool: nope"), (None, {"rfc": 1}, "Unknown tool: null"), ("get_requirements", {}, "RFC number must be a number, got undefined"), ("get_requirements", {"rfc": None}, "RFC number must be a number, got null"),
    ("get_requirements", {"rfc": "8999"}, "RFC number must be a number, got string"), ("get_requirements", {"rfc": True}, "RFC number must be a number, got boolean"), ("get_requirements", {"rfc": 1.5}, "RFC number must be an integer, got 1.5"),
    ("get_requirements", {"rfc": 0}, "RFC number must be positive, got 0"), ("get_requirements", {"rfc": 100000}, "RFC number 100000 seems invalid (too large)"), ("get_definitions", {"rfc": 77}, "Could not fetch RFC 77."),
    ("get_definitions", {"rfc": 9500}, "All sources failed: a: x"), ("get_related_sections", {"rfc": 8999}, "Missing argument: section"), ("validate_statement", {"rfc": 8999}, "Missing argument: statement"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(4242, "text", TEXT, None), (8999, "xml", MARKUP, None), (9500, None, None, "All sources failed: a: x")], "doc_id int, source string, body string, error string")


def table(spark, rows):
    rows = [(i, tool, None if a is None else json.dumps(a)) for i, (tool, a) in enumerate(rows)]
    return spark.createDataFrame(rows, "call_id long, tool string, a string").select("call_id", "tool", F.parse_json("a").alias("arguments"))


def test_batch_equals_calls_one_by_one(spark, raw):
    every = [*ASKED, *[(t, a) for t, a, _ in FAILING], ASKED[4], ("get_definitions", None), ("get_definitions", {"rfc": 4242, "term": "zzz", "extra": [1]})]
    got = {r.call_id: r for r in calls.call_batch(table(spark, every), raw, api.parse, STAMP).collect()}
    assert sorted(got) == list(range(len(every)))
    engine = api.Engine(spark, raw)
    for i, (tool, arguments) in enumerate(ASKED):
        want, have = json.loads(engine.call(tool, **arguments)["text"]), json.loads(got[i].text)
        if "markdown" in want:
            want["markdown"] = "\n".join(f"Generated: {STAMP}" if x.startswith("Generated: ") else x for x in want["markdown"].split("\n"))
        assert have == want and not got[i].is_error and got[i].tool == tool, (tool, arguments)
    for i, (tool, _, message) in enumerate(FAILING, len(ASKED)):
        assert json.loads(got[i].text) == {"error": message} and got[i].is_error and got[i].tool == tool
    n = len(ASKED) + len(FAILING)
    assert got[n].text == got[4].text and got[n + 1].is_error and got[n + 2].text == got[9].text


def test_no_calls(spark, raw):
    assert calls.call_batch(table(spark, [("nope", {})]).limit(0), raw, api.parse, STAMP).count() == 0
