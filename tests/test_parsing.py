"""Plain text and markup to flat tables, and what is asked of them."""

import random

import pytest
from pyspark.sql import functions as F

from specloom.operators import checklist, markup_parse, matching, relations, requirements, text_parse

TEXT = """Working Group                                   A. Author
Request for Comments: 4242

                    A Protocol for Tests of Parsers

1.  Introduction

   The client MUST send a request. A server SHOULD
   answer it.

   Some lines are wrapped: see Section 2.1 and RFC 2119.

2.  Requirements Overview

   1000 OK
   Peers MAY cache. They MUST NOT lie.

2.1.  Client Rules

   Cache: a store of earlier answers
   x - too short
   As in RFC 9000 and RFC 2119; this is RFC 4242, see Section 3.

2.2.  Server Rules
3.1.1.  Jumped Deep Section
"""

#: The first line that looks like a title is often the masthead.
MASTHEAD = TEXT.split("\n")[0].strip()

MARKUP = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE rfc [<!ENTITY x "y">]>
<rfc number="8999" docName="draft-x-01"><front><title>Test  Document</title></front>
<middle>
 <section anchor="intro" pn="section-1"><name>Introduction</name>
  <t>The client <bcp14>MUST</bcp14> send it, see <xref target="section-2.1"/> &amp; <xref target="RFC2119"/> or <xref target="terms">terms</xref>.</t>
  <t></t>
  <ol><li>The sender MUST NOT exceed it.</li><li>A receiver <bcp14 class="x">SHOULD</bcp14> check.</li></ol>
  <t>Servers MAY stop&nbsp;early. Section 2.1 says so.</t>
  <ul><li><t>Nested one</t><t>MAY be</t></li></ul>
  <sourcecode type="abnf">a = b</sourcecode><artwork>+-+</artwork>
  <figure><artwork>hidden MUST</artwork></figure>
 </section>
 <section numbered="false" anchor="two"><name>Two</name>
  <section pn="section-2.1" anchor="terms"><name>Terms</name><dl><dt>frame</dt><dd>a unit of data</dd><dt>empty</dt><dd/><dt>peer</dt><dd>the other <em>side</em> here</dd></dl></section>
  <section><name>Bare</name><t>Nothing SHALL change.</t></section>
 </section>
 <section><t>No name</t></section>
</middle>
<back><references><name>References</name>
 <references anchor="sec-normative-references"><name>N</name>
  <reference anchor="RFC2119"><front><title>Key words</title></front><seriesInfo name="BCP" value="14"/><seriesInfo name="RFC" value="2119"/></reference>
  <referencegroup anchor="g"><reference anchor="RFC8174"><front><title>Case</title></front><seriesInfo name="RFC" value="8174"/></reference></referencegroup>
 </references>
 <references anchor="inf"><name>Informative References</name><reference anchor="QUIC" target="https://example.org"><front><title>Transport</title></front></reference></references>
</references></back></rfc>"""


@pytest.fixture(scope="module")
def text(spark):
    return text_parse.parse_text(spark.createDataFrame([(4242, TEXT), (1, ""), (2, None), (3, "no headers here\nMUST not count")], "doc_id int, body string")).persist()


@pytest.fixture(scope="module")
def markup(spark):
    return markup_parse.parse_markup(spark.createDataFrame([(8999, MARKUP), (9000, "<rfc><broken>"), (9001, "<rfc/>")], "doc_id int, body string")).persist()


def test_text_sections(text):
    rows = text.sections.orderBy("seq").collect()
    assert [(r.number, r.title, r.parent_seq) for r in rows] == [("1", "Introduction", None), ("2", "Requirements Overview", None), ("2.1", "Client Rules", 2), ("2.2", "Server Rules", 2), ("3.1.1", "Jumped Deep Section", 4)]
    titles = {r.doc_id: r.title for r in text.docs.collect()}
    assert titles == {4242: MASTHEAD, 1: "RFC 1", 2: "RFC 2", 3: "no headers here"}


def test_parents_equal_a_stack(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for doc in range(40):
        stack = []
        for seq in range(1, rng.randint(2, 40)):
            depth = rng.randint(1, 5)
            while stack and stack[-1][1] >= depth:
                stack.pop()
            want[doc, seq] = stack[-1][0] if stack else None
            stack.append((seq, depth))
            rows.append((doc, seq, ".".join(["1"] * depth)))
    got = text_parse.with_parents(spark.createDataFrame(rows, "doc_id int, seq int, number string")).collect()
    assert {(r.doc_id, r.seq): r.parent_seq for r in got} == want


def test_text_requirements(text):
    rows = requirements.extract_requirements(text, with_components=False).orderBy("req_ord").collect()
    assert [(r.id, r.level, r.text) for r in rows] == [
        ("R-1-1", "MUST", "The client MUST send a request."),
        ("R-1-2", "SHOULD", "A server SHOULD\n   answer it."),
        ("R-2-3", "MAY", "1000 OK\n   Peers MAY cache."),
        ("R-2-4", "MUST NOT", "They MUST NOT lie."),
    ]
    assert all(r.subject is None and r.full_context for r in rows)


def test_text_definitions_references_and_relations(text):
    terms = {r.term: (r.definition, r.section) for r in text.definitions.collect()}
    assert terms["Cache"] == ("a store of earlier answers", "2.1") and "x" not in terms
    assert [(r.rfc_number, r.kind) for r in text.refs.orderBy("ref_ord").collect()] == [(2119, "informative"), (9000, "informative")]
    related = {(r.section_id, r.related_number): r.related_title for r in relations.related_sections(text).collect()}
    assert related == {("1", "2.1"): "Client Rules", ("2.1", "3."): "Unknown"}
    assert relations.find_section(text.sections, "section-2.2").first().title == "Server Rules" and relations.find_section(text.sections, "9").count() == 0
    assert relations.search_definitions(text.definitions, "EARLIER").count() == 1 and relations.search_definitions(text.definitions, "").count() == text.definitions.count()


def test_markup_tables(markup):
    doc = {r.doc_id: r for r in markup.docs.collect()}
    assert (doc[8999].title, doc[8999].number, doc[8999].doc_name) == ("Test  Document", 8999, "draft-x-01") and doc[9001].title == "Untitled" and 9000 not in doc
    rows = markup.sections.where("doc_id = 8999").orderBy("seq").collect()
    assert [(r.number, r.anchor, r.section_id, r.title, r.parent_seq) for r in rows] == [
        ("section-1", "intro", "section-1", "Introduction", None), ("false", "two", "false", "Two", None), ("section-2.1", "terms", "section-2.1", "Terms", 2), (None, None, "false.", "Bare", 2), (None, None, "", "Untitled Section", None),
    ]
    blocks = markup.blocks.where("sec_seq = 1").orderBy("block_ord").collect()
    assert [(b.type, b.style, b.language) for b in blocks] == [("text", None, None), ("text", None, None), ("list", "symbols", None), ("list", "numbers", None), ("sourcecode", None, "abnf"), ("artwork", None, None)]
    assert blocks[1].content == "Servers MAY stop&nbsp;early. Section 2.1 says so." and blocks[2].items == ["Nested one MAY be"]
    assert [(r.kind, r.anchor, r.rfc_number, r.title, r.target) for r in markup.refs.orderBy("ref_ord").collect()] == [
        ("normative", "RFC2119", 2119, "Key words", None), ("normative", "RFC8174", 8174, "Case", None), ("informative", "QUIC", None, "Transport", "https://example.org"),
    ]
    assert [(r.term, r.definition, r.section) for r in markup.definitions.orderBy("def_ord").collect()] == [("frame", "a unit of data", "section-2.1"), ("peer", "the otherhere", "section-2.1")]
    assert relations.reference_counts(markup.refs).first().asDict() == {"doc_id": 8999, "normative": 2, "informative": 1}


def test_markup_references(markup):
    found = markup.xrefs().where("sec_seq = 1").orderBy("block_ord", "xref_ord").collect()
    assert [(r.block_ord, r.target, r.type) for r in found] == [(0, "2.1", "section"), (0, "RFC2119", "rfc"), (0, "terms", "section"), (1, "2.1", "section")]
    related = relations.related_sections(markup).where("sec_seq = 1").orderBy("related_ord").collect()
    assert [(r.related_number, r.related_title) for r in related] == [("2.1", "Terms"), ("terms", "Terms")]


def test_markup_requirements(markup):
    rows = requirements.extract_requirements(markup).orderBy("req_ord").collect()
    assert [(r.level, r.section, r.subject) for r in rows] == [("MUST", "section-1", "client"), ("MAY", "section-1", "servers"), ("MAY", "section-1", "nested one"), ("MUST NOT", "section-1", "sender"), ("SHOULD", "section-1", "a receiver"), ("SHALL", "false.", "nothing")]
    only = requirements.extract_requirements(markup, level="MUST NOT").collect()
    assert [(r.id, r.text) for r in only] == [("R-section-1-1", "The sender MUST NOT exceed it.")]
    stats = requirements.level_stats(requirements.extract_requirements(markup)).first()
    assert stats.total == 6 and stats.by_level == {"MUST": 1, "MAY": 2, "MUST NOT": 1, "SHOULD": 1, "SHALL": 1}
    assert {r.level: r.n for r in requirements.level_rollup(requirements.extract_requirements(markup)).collect()}[None] == 6


TREE = [("section-3", "The client MUST send data."), ("section-3.5", "The server SHOULD respond."), ("section-3.5.1", "Implementations MAY cache."), ("5", "Endpoints MUST NOT close prematurely."), ("5.5", "Clients SHALL validate input.")]


@pytest.mark.parametrize(
    ("options", "n"),
    [({}, 5), ({"sections": ["3.5"]}, 2), ({"sections": ["section-3"]}, 3), ({"sections": ["section-3"], "with_subsections": False}, 1), ({"sections": ["section-3.5", "5.5"], "with_subsections": False}, 2), ({"sections": ["section-3"], "level": "SHOULD"}, 1), ({"sections": ["5"]}, 2), ({"sections": []}, 5)],
)
def test_section_filters(spark, options, n):
    options = dict(options)
    units = spark.createDataFrame([(1, i, 0, "text", 0, t, s, "t") for i, (s, t) in enumerate(TREE)], "doc_id int, sec_seq int, block_ord int, kind string, item_ord int, text string, section_id string, section_title string")
    wanted = units.where(requirements.in_sections(F.col("section_id"), options.pop("sections", []), options.pop("with_subsections", True)))
    assert requirements.extract_from(wanted, **options).count() == n


REQS = [
    (1, 1, "MUST", "The client MUST send a request.", "client", "send a request", "In all cases, the client MUST send a request to the server."),
    (1, 2, "SHOULD", "The server SHOULD respond within 5 seconds.", "server", None, "For best results, the server SHOULD respond within 5 seconds."),
    (1, 3, "MAY", "The client MAY cache the response.", "client", None, "The client MAY cache the response."),
    (1, 4, "MUST NOT", "The server MUST NOT close the connection prematurely.", "server", None, "The server MUST NOT close the connection before that."),
    (2, 1, "MUST", "A client MUST mask all frames that it sends to the server.", "client", "mask all frames that it sends to the server", ""),
    (2, 2, "MUST NOT", "A server MUST NOT mask any frames that it sends to the client.", "server", "mask any frames that it sends to the client", ""),
    (3, 1, "MUST", "The client MUST encrypt all data.", "client", "encrypt all data", None),
    (4, 1, "MUST", "The client MUST validate all input.", None, "validate all input", None),
]
CONFLICTS = [
    (2, "A WebSocket client sends unmasked frames to the server", "contradicts"), (2, "The server masks all frames sent to the client", "forbids"), (2, "The client masks all frames before sending", None), (2, "The server sends unmasked frames to the client", None),
    (2, "The client sends frames without masking", "contradicts"), (2, "The server sends unmasked data", None), (3, "The client sends unencrypted data to the server", "contradicts"), (4, "The client skips validation for performance", "contradicts"),
    (4, "The client does not validate user input", "contradicts"), (1, "The client MAY send a request", 'uses "MAY" but requirement uses "MUST"'), (1, "The client MUST send a request", None), (1, "It sends nothing", None),
]


@pytest.fixture(scope="module")
def reqs(spark):
    return spark.createDataFrame(REQS, "doc_id int, req_ord int, level string, text string, subject string, action string, full_context string")


def test_conflicts(spark, reqs):
    said = spark.createDataFrame([(i, d, s) for i, (d, s, _) in enumerate(CONFLICTS)], "stmt_id int, doc_id int, statement string")
    found = {}
    for r in matching.conflicts(said, reqs).collect():
        found.setdefault(r.stmt_id, []).append(r.reason)
    for i, (_, _, part) in enumerate(CONFLICTS):
        assert (part is None and i not in found) or (part is not None and any(part in x for x in found[i])), CONFLICTS[i]
    valid = {r.stmt_id: r for r in matching.validity(said, reqs).collect()}
    assert all(valid[i].is_valid == (part is None) for i, (_, _, part) in enumerate(CONFLICTS))
    assert valid[11].suggestions is None or "subject" not in " ".join(valid[11].suggestions)


def test_scores_and_best_matches(spark, reqs):
    said = spark.createDataFrame([(0, 1, "The client MUST send a request"), (1, 1, "zzz")], "stmt_id int, doc_id int, statement string")
    pairs = {(r.stmt_id, r.req_ord): r for r in matching.scored(said, reqs).collect()}
    first = pairs[0, 1]
    assert first.subject_match and first.level_match and first.score == 3 + 1 + 1 + 2 + 5 + 3 and first.matched_keywords == ["client", "must", "send", "request"]
    best = matching.best_matches(matching.scored(said, reqs), 2).orderBy("rank").collect()
    assert [(r.stmt_id, r.req_ord) for r in best] == [(0, 1), (0, 3)]


def test_checklists(spark, text, reqs):
    items = checklist.items(reqs.where("doc_id = 1").withColumns({"section": F.lit("1"), "id": F.lit("R")}))
    assert checklist.stats(items).first().asDict() == {"doc_id": 1, "must": 2, "should": 1, "may": 1, "total": 4}
    assert {r.req_ord for r in checklist.for_role(items, "client").collect()} == {1, 3} == {1, 2, 3, 4} - {r.req_ord for r in checklist.for_role(items, "server").collect()}
    assert checklist.for_role(items, "neither").count() == 2 and checklist.for_role(items, "both").count() == 4
    found = checklist.items(requirements.extract_requirements(text), "client")
    lines = {r.doc_id: r.markdown.split("\n") for r in checklist.markdown(text.docs, found, "client", "now").collect()}
    assert lines[4242] == ["# RFC 4242 Implementation Checklist", "", f"**{MASTHEAD}**", "", "Role: client", "", "Generated: now", "", "## Mandatory Requirements (MUST / REQUIRED / SHALL)", "", "- [ ] The client MUST send a request. (1)", "- [ ] They MUST NOT lie. (2)", "", "## Optional Requirements (MAY / OPTIONAL)", "", "- [ ] 1000 OK", "   Peers MAY cache. (2)", ""]
    assert lines[1] == ["# RFC 1 Implementation Checklist", "", "**RFC 1**", "", "Role: client", "", "Generated: now", ""]


def test_reverse_references(text):
    assert {r.doc_id: r.citing for r in relations.referenced_by(text.refs).collect()} == {2119: [4242], 9000: [4242]}


def test_html(spark):
    pages = spark.createDataFrame([(1, '<nav><li><a href="/a">A</a></li></nav><h1>T <b>x</h1><p>one<br>two</p><p> </p><script>var t="</p>"</script>'), (2, None)], "page_id int, html string")
    assert [(r.tag, r.ord, r.text) for r in markup_parse.html_blocks(pages).collect()] == [("h1", 0, "T x"), ("p", 0, "onetwo"), ("li", 0, "A")]
    assert [tuple(r) for r in markup_parse.html_links(pages).collect()] == [(1, 0, "/a")]
