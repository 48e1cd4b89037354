"""The event parser against a whole tree, on made documents of any nesting."""

import random

import pytest

from specloom.operators import markup_parse
from specloom.operators.markup_parse import Reader

from .test_parsing import MARKUP
from .tree_parse import Document

TAGS = "t t t ul ol li section section name dl dl dt dd sourcecode artwork xref em references reference referencegroup front title figure note seriesInfo".split()


def made(rng, depth=0):
    """Elements, text and attributes nested at random."""
    out = ""
    for _ in range(rng.randint(0, 5 if depth < 5 else 0)):
        tag = rng.choice(TAGS)
        attributes = "".join(f' {k}="{rng.choice(v)}"' for k, v in (("pn", ["section-1", "section-2.1", ""]), ("anchor", ["a", "normative", "b"]), ("target", ["section-3", "RFC9", "a"]), ("name", ["RFC", "BCP"]), ("value", ["12", "x", "-3z"]), ("type", ["abnf"])) if rng.random() < 0.3)
        out += f"<{tag}{attributes}>" + rng.choice(["", " ", "text ", "&nbsp; &amp;\n"]) + made(rng, depth + 1) + f"</{tag}>" + rng.choice(["", "", "tail "])
    return out


def document(rng):
    parts = [f"<front>{made(rng, 3)}</front>" if rng.random() < 0.7 else ""] + [f"<{tag}>{made(rng)}</{tag}>" for tag in rng.choices(["middle", "middle", "back", "back", "front", "other"], k=rng.randint(0, 4))]
    return f'<?xml version="1.0"?><rfc number="{rng.choice(["7", "x", " 8a"])}" docName="d">' + "".join(parts) + "</rfc>"


def as_tuples(rows, columns):
    return [tuple(r[c.split(" ")[0]] for c in columns.split(", ")) for r in rows]


@pytest.mark.parametrize("seed", range(6))
def test_events_agree_with_the_tree(seed, monkeypatch):
    monkeypatch.setattr(markup_parse, "CHUNK", 7 + 100 * seed)
    rng = random.Random(seed)
    for body in [MARKUP] * (seed == 0) + [document(rng) for _ in range(150)]:
        want = Document(5, body)
        got = {kind: [] for kind in markup_parse._TABLES}
        for kind, values in Reader(5).rows(body):
            got[kind].append(values)
        tables = {"doc": [want.doc], "section": want.sections, "block": want.blocks, "ref": want.refs, "definition": want.definitions}
        for kind, rows in tables.items():
            assert sorted(got[kind], key=lambda x: x[:3] if kind == "block" else x[:2]) == sorted(as_tuples(rows, markup_parse._TABLES[kind]), key=lambda x: x[:3] if kind == "block" else x[:2]), (kind, body)


def test_a_huge_document_is_never_a_tree():
    """Elements that are alive while rows come out stay as few as one block has."""
    body = "<rfc><middle>" + "<section pn='section-1'><name>N</name>" + "<t>It <em>MUST</em> go.</t>" * 20_000 + "</section>" * 1 + "<section pn='section-2'><t>x</t></section>" * 2000 + "</middle></rfc>"
    most = 0
    plain = Reader._child

    def watched(self, parent, elem, place):
        nonlocal most
        most = max(most, sum(1 for _ in parent.elem.iter()))
        plain(self, parent, elem, place)

    reader = Reader(1)
    reader._child = watched.__get__(reader)
    assert sum(1 for kind, _ in reader.rows(body) if kind == "block") == 22_000 and most < 1000


def test_deep_nesting_and_broken_markup(spark):
    deep = "<rfc><middle><section pn='section-1'>" + "<t>" * 5000 + "MUST" + "</t>" * 5000 + "</section></middle></rfc>"
    raw = spark.createDataFrame([(1, deep), (2, "<rfc><t></rfc>"), (3, None), (4, ""), (5, MARKUP)], "doc_id int, body string")
    rows = markup_parse.parse_events(raw)
    tables = markup_parse.tables_of(rows)
    assert sorted(r.doc_id for r in tables.docs.collect()) == [1, 5] and {r.doc_id for r in markup_parse.errors_of(rows).collect()} == {2, 3, 4}
    assert tables.blocks.where("doc_id = 1").first().content == "MUST"


def test_one_pass_serves_all_tables(spark):
    raw = spark.createDataFrame([(8999, MARKUP)], "doc_id int, body string")
    apart, once = markup_parse.parse_markup(raw), markup_parse.parse_markup(raw, once=True)
    for name in ("docs", "sections", "blocks", "refs", "definitions"):
        a, b = getattr(apart, name), getattr(once, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.columns == b.columns
        assert "PythonUDTF" in a._jdf.queryExecution().toString() and "PythonUDTF" not in b._jdf.queryExecution().toString()
