"""Nested JSON of sections against a stack, markup included; answers that can't be read."""

import json
import random

from pyspark.sql import functions as F

from specloom.operators import markup_parse, structure
from specloom.operators.parsed import BLOCKS, DEFINITIONS, DOCS, REFS, SECTIONS, Parsed
from specloom.sources import scan

from .test_parsing import MARKUP


def nested(rows, blocks):
    """rows: (seq, parent_seq, number, anchor, title) in document order."""
    nodes, top = {}, []
    for seq, parent, number, anchor, title in rows:
        nodes[seq] = {k: v for k, v in (("number", number), ("title", title), ("anchor", anchor)) if v is not None} | {"content": blocks.get(seq, [])}
        (top if parent is None else nodes[parent].setdefault("subsections", [])).append(nodes[seq])
    return top


def test_trees_of_any_shape(spark):
    rng = random.Random(1)
    sections, blocks, docs, want = [], [], [], {}
    for doc in range(1, 30):
        open_, rows, own = [], [], {}
        for seq in range(1, rng.randint(0, 25) + 1):
            open_ = open_[: rng.randint(0, len(open_))]
            rows.append((seq, open_[-1] if open_ else None, rng.choice([None, f"{seq}.1"]), rng.choice([None, 'a"b']), f'T{{}}]\n"{seq}\\'))
            open_.append(seq)
            for i in range(rng.randint(0, 2)):
                own.setdefault(seq, []).append({"type": "list", "style": "symbols", "items": ["x", f"{i}"]} if i else {"type": "text", "content": "line\nnext ü"})
        docs.append((doc, "xml", f"D{doc}", None, None))
        sections += [(doc, s, p, 0, n, a, "", t) for s, p, n, a, t in rows]
        blocks += [(doc, s, i, b["type"], b.get("style"), None, b.get("content"), b.get("items"), None, "", "") for s, found in own.items() for i, b in enumerate(found)]
        want[doc] = nested(rows, own)
    parsed = Parsed(*(spark.createDataFrame(rows, schema) for rows, schema in ((docs, DOCS), (sections, SECTIONS), (blocks, BLOCKS), ([], REFS), ([], DEFINITIONS))))
    got = {r.doc_id: json.loads(r.structure) for r in structure.structure_json(parsed, with_content=True).collect()}
    assert {d: x["sections"] for d, x in got.items()} == want
    assert got[1]["metadata"] == {"title": "D1"} and got[1]["referenceCount"] == {"normative": 0, "informative": 0} and got[1]["_source"] == "xml"
    plain = {r.doc_id: json.loads(r.structure) for r in structure.structure_json(parsed).collect()}
    assert all("content" not in s for x in plain.values() for s in x["sections"])


def test_structure_of_markup(spark):
    parsed = markup_parse.parse_markup(spark.createDataFrame([(8999, MARKUP)], "doc_id int, body string"))
    got = json.loads(structure.structure_json(parsed).first().structure)
    assert [s["title"] for s in got["sections"]] == ["Introduction", "Two", "Untitled Section"] and [s["title"] for s in got["sections"][1]["subsections"]] == ["Terms", "Bare"]


def test_levels(spark):
    rows = spark.createDataFrame([([(1, None), (2, 1), (3, 2), (4, 1), (5, None), (6, 5)],), ([],)], "s array<struct<seq:int,parent_seq:int>>")
    assert [r[0] for r in rows.select(structure.levels(F.col("s"))).collect()] == [[1, 2, 3, 2, 1, 2], []]


def test_unreadable_answers_are_rescued(spark):
    answers = [(1, '{"title": "T"'), (2, "[]"), (3, '{"title": {"x": 1}, "time": "2020"}'), (4, None), (5, '{"other": 1}'), (6, '{"title": 7}')]
    got = {r.number: r for r in scan.metadata(spark.createDataFrame(answers, "doc_id int, json string")).collect()}
    assert got[1].rescued == '{"title": "T"' and got[1].title == "RFC 1" and got[4].rescued is None and got[5].rescued is None and got[5].title == "RFC 5"
    assert got[6].title == "7" and got[3].title == '{"x":1}' and got[3].date == "2020"
