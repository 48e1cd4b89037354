"""The seven calls, the error envelope, sources, sinks, streaming, and every query against its SQL."""

import json

import duckdb
import pytest

import __spark_entry__ as entry
from specloom import api
from specloom.operators import checklist, requirements, text_parse
from specloom.plans import queries
from specloom.sources import scan, sinks
from specloom.streaming import ingest

from .test_parsing import MARKUP, TEXT

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine(spark):
    raw = spark.createDataFrame([(4242, "text", TEXT, None), (8999, "xml", MARKUP, None), (9500, None, None, "All sources failed: a: x")], "doc_id int, source string, body string, error string")
    return api.Engine(spark, raw)


def test_structure(engine):
    got = engine.get_rfc_structure(8999)
    assert got["metadata"] == {"title": "Test  Document", "docName": "draft-x-01", "number": 8999} and got["referenceCount"] == {"normative": 2, "informative": 1}
    assert [s["title"] for s in got["sections"]] == ["Introduction", "Two", "Untitled Section"] and [s["title"] for s in got["sections"][1]["subsections"]] == ["Terms", "Bare"]
    assert "content" not in got["sections"][0] and "_sourceNote" not in got and got["_source"] == "xml"
    assert engine.get_rfc_structure(8999, includeContent=True)["sections"][0]["content"][4] == {"type": "sourcecode", "language": "abnf", "content": "a = b"}


def test_requirements_call(engine):
    got = engine.get_requirements(4242, level="MUST")
    assert got["stats"] == {"total": 1, "byLevel": {"MUST": 1}} and got["filter"] == {"section": "all", "level": "MUST"}
    assert got["requirements"][0]["subject"] == "client" and got["requirements"][0]["action"] == "send a request" and "Warning" in got["_sourceNote"]
    everything = engine.get_requirements(8999)
    assert everything["stats"]["total"] == sum(everything["stats"]["byLevel"].values()) == 6


def test_other_calls(engine):
    assert engine.get_definitions(8999, term="FRAME")["definitions"] == [{"term": "frame", "definition": "a unit of data", "section": "section-2.1"}]
    assert engine.get_definitions(8999, term="zzz")["count"] == 0
    deps = engine.get_rfc_dependencies(8999, includeReferencedBy=True)
    assert [r["rfcNumber"] for r in deps["normative"]] == [2119, 8174] and deps["informative"] == [{"title": "Transport", "anchor": "QUIC"}] and deps["referencedBy"] == []
    assert engine.get_related_sections(8999, "1")["relatedSections"] == [{"number": "2.1", "title": "Terms"}, {"number": "terms", "title": "Terms"}]
    assert engine.get_related_sections(8999, "77") == {"error": "Section 77 not found"}
    listed = engine.generate_checklist(8999, role="client", sections=["1"])
    assert listed["role"] == "client" and listed["stats"] == {"must": 2, "should": 1, "may": 1, "total": 4} and "Role: client" in listed["markdown"]
    said = engine.validate_statement(4242, "The client MAY send a request")
    assert not said["isValid"] and said["analysis"] == {"detectedLevel": "MAY", "detectedSubject": "client"} and said["matchingRequirements"][0]["_matchScore"] > 0 and "conflicts" in said["suggestions"][0]


def test_envelope(engine):
    assert not engine.call("get_definitions", rfc=8999)["is_error"] and json.loads(engine.call("get_definitions", rfc=8999)["text"])["count"] == 2
    for tool, arguments, part in (("nope", {}, "Unknown tool: nope"), ("get_requirements", {"rfc": 0}, "positive"), ("get_requirements", {"rfc": 77}, "Could not fetch"), ("get_requirements", {"rfc": 9500}, "All sources failed")):
        got = engine.call(tool, **arguments)
        assert got["is_error"] and part in json.loads(got["text"])["error"]
    assert set(api.TOOLS) == {m for m in dir(engine) if m.startswith(("get_", "generate_", "validate_"))}
    assert engine.read_resource("any://schema")["version"] == "v3"
    with pytest.raises(ValueError, match="Unknown resource"):
        engine.read_resource("any://else")


@pytest.mark.parametrize("n", [1, 99_999, 8650, 7.0])
def test_numbers_accepted(n):
    assert api.validate_number(n) == n


@pytest.mark.parametrize("n", ["1", None, {}, [], True, 1234.5, float("nan"), float("inf"), float("-inf"), 0, -1, 100_000])
def test_numbers_refused(n):
    with pytest.raises(ValueError):
        api.validate_number(n)


def test_recent():
    gone = []
    kept = api.Recent(2, gone.append)
    kept.set("a", 1)
    kept.set("b", 2)
    assert kept.get("a") == 1
    kept.set("c", 3)
    assert gone == [2] and kept.has("a") and not kept.has("b") and kept.get("b") is None
    kept.set("a", 4)
    kept.set("d", 5)
    assert gone == [2, 3] and kept.delete("a") and not kept.delete("a") and kept.stats() == {"size": 1, "maxSize": 2}
    kept.clear()
    assert len(kept) == 0


def test_documents_are_parsed_once(engine):
    engine.cache.clear()
    first = engine.document(8999)
    assert engine.document(8999)[0] is first[0] and len(engine.cache) == 1


def test_folder_candidates_and_fallback(spark, tmp_path):
    for name, body in (("rfc8999.xml", MARKUP), ("rfc12.xml", "<html>"), ("rfc12.txt", "RFC 12 text"), ("notes.txt", "RFC"), ("rfc9999.txt", "RFC 9999")):
        (tmp_path / name).write_text(body)
    found = {k: scan.first_valid(scan.read_folder(spark, f"file://{tmp_path}", k).selectExpr("*", "CAST(NULL AS string) AS error"), k) for k in ("xml", "text")}
    got = {r.doc_id: r for r in scan.with_fallback(found["xml"], found["text"]).collect()}
    assert got[8999].body == MARKUP
    assert (got[8999].source, got[12].source, got[9999].source) == ("xml", "text", None) and got[9999].error.startswith("Could not fetch RFC 9999")
    assert {r.doc_id: r.error for r in found["xml"].collect()}[12] == "All sources failed: folder: Invalid content"


def test_metadata(spark):
    rows = scan.metadata(spark.createDataFrame([(1, '{"title": "T", "std_level": "Historic", "stream": "IAB", "time": "2020"}'), (2, "broken"), (3, None)], "doc_id int, json string")).collect()
    assert [(r.title, r.category, r.stream, r.date) for r in rows] == [("T", "historic", "IAB", "2020"), ("RFC 2", "info", "IETF", ""), ("RFC 3", "info", "IETF", "")]


def test_http_source_reports_errors(spark, monkeypatch):
    reader = scan._HttpReader({"numbers": "1", "kind": "text"})
    reader.templates = {"a": "file:///nowhere/{n}", "b": "file:///nor/here/{n}"}
    (row,) = reader.read(reader.partitions()[0])
    assert row[:3] == (1, None, None) and row[3].startswith("All sources failed: ")


def test_sinks(spark, tmp_path):
    parsed = text_parse.parse_text(spark.createDataFrame([(4242, TEXT)], "doc_id int, body string"))
    found = requirements.extract_requirements(parsed)
    assert "condition" not in json.loads(sinks.to_json_rows(found.orderBy("req_ord")).first().value)
    sinks.write_json(found, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 4
    files = sinks.checklist_files(checklist.markdown(parsed.docs, checklist.items(found), None, "now"), parsed.docs, "test")
    sinks.write_checklists(files, f"file://{tmp_path}/md")
    assert "text format" in "".join(r.value for r in spark.read.text(f"file://{tmp_path}/md").collect())


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/rfc4242.txt").write_text(TEXT)
    stream = ingest.document_stream(spark, f"file://{tmp_path}/in")
    ingest.write_requirements(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4
    (tmp_path / "in/rfc5.txt").write_text("1.  Introduction\n\nIt MAY.\n")
    ingest.write_requirements(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5
    q = ingest.paragraph_stream(ingest.first_arrivals(stream)).writeStream.format("memory").queryName("paragraphs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("paragraphs").where("doc_id = 5").first().content == "It MAY."


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_agree_with_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
