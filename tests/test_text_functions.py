"""Text functions against plain Python, with random texts."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specloom import dims
from specloom.functions import text as X

KEYWORD = re.compile(rf"\b({'|'.join(dims.LEVELS)})\b", re.ASCII)
TOKENS = ["MUST", "MUST NOT", "MUST\nNOT", "SHOULD", "NOT RECOMMENDED", "MAY", "_MAY", "MUST-10", "(MAY)", "éMUST", "OPTIONAL", "e.g.", "5.1", ".", "!", "? ", ". ", "\n", " ", "the", "client", "漢", " ", "REQUIREDX"]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def sentence_by_hand(text, pos):
    start, end = pos, pos
    while start and not (text[start - 1] in ".!?" and start < len(text) and (text[start].isspace() or text[start] == "﻿")):
        start -= 1
    while end < len(text) and text[end] not in ".!?":
        end += 1
    return text[start : end + 1].strip(X.WHITE)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(TOKENS), max_size=25), min_size=60, max_size=60))
def test_markers_and_sentences(spark, lists):
    texts = [" ".join(x) if i % 2 else "".join(x) for i, x in enumerate(lists)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", F.explode_outer(X.markers(F.col("t"))).alias("m")).select("i", "t", "m.*").withColumn("s", X.sentence(F.col("t"), F.col("pos"))).collect()
    got = sorted((r.i, r.pos, r.level, r.s) for r in rows if r.level)
    want = [(i, m.start(), m[1], sentence_by_hand(t, m.start())) for i, t in enumerate(texts) for m in KEYWORD.finditer(t)]
    assert got == sorted(want)


def test_offsets_give_the_keyword_back(spark):
    text = "The x MUST go. It SHOULD NOT stop, MAY pause."
    assert [(m.level, text[m.pos : m.pos + len(m.level)]) for m in one(spark, X.markers(F.col("t")), t=text)] == [(k, k) for k in ("MUST", "SHOULD NOT", "MAY")]


@pytest.mark.parametrize(
    ("text", "level", "want"),
    [
        ("The client MUST send it, if asked.", "MUST", ("client", "send it", "asked", None)),
        ("A client MUST wait unless told otherwise.", "MUST", ("a client", "wait unless told otherwise", "told otherwise", "told otherwise")),
        ("Peers SHALL NOT, in case of loss, retry", "SHALL NOT", ("peers", None, "of loss", None)),
        ("A server MUST\n NOT send this", "MUST", ("a server", "NOT send this", None, None)),
        ("It is OPTIONAL to stop\nhere", "OPTIONAL", (None, None, None, None)),
        ("Nobody said so", "MUST", (None, None, None, None)),
    ],
)
def test_components(spark, text, level, want):
    parts = X.components(F.col("t"), F.col("l"))
    row = spark.createDataFrame([(text, level)], "t string, l string").select(*[c.alias(n) for n, c in parts.items()]).first()
    assert (row.subject, row.action, row.condition, row.exception) == want


def test_keywords(spark):
    def bag(text):
        return {k.keyword: k.weight for k in one(spark, X.keywords(F.col("t")), t=text)}

    found = bag("The client sends a request to the server.")
    assert (found["client"], found["server"], found["request"], found["sends"]) == (3, 3, 2, 1) and "the" not in found
    assert bag("client client, CLIENT!") == {"client": 9} and bag("") == {} and bag("a an of") == {}
    assert list(bag("zeta alpha zeta")) == ["zeta", "alpha"]


def test_level_and_subject(spark):
    level, subject = X.level_of(F.col("t")), X.subject_of(F.col("t"))
    assert one(spark, level, t="you must not do it") == "MUST NOT" and one(spark, level, t="it may") == "MAY" and one(spark, level, t="nothing") is None
    assert one(spark, subject, t="Both server and client") == "server" and one(spark, subject, t="the clients") is None and one(spark, subject, t="") is None


def test_references(spark):
    refs = one(spark, X.cross_references(F.col("t")), t="See Section 3.1 and RFC 2119, rfc9000; section 4.")
    assert [(r.target, r.type) for r in refs] == [("RFC2119", "rfc"), ("RFC9000", "rfc"), ("3.1", "section"), ("4.", "section")]
    tags = one(spark, X.merged_references(F.col("t"), F.array(*map(F.lit, ["section-2", "2.4", "rfc8174", "anchor", "3.1", "section-2"]))), t="Section 3.1")
    assert [(r.target, r.type, r.section) for r in tags] == [("3.1", "section", "3.1"), ("2", "section", "2"), ("2.4", "section", "2.4"), ("RFC8174", "rfc", None), ("anchor", "section", "anchor"), ("2", "section", "2")]


HEADERS = [
    ("1", "Introduction", True), ("1.2.3.4.5.6", "Too Deep", False), ("100", "Continue Here", False), ("99", "Fine Title", True), ("1", "ab", False), ("1", "short lower", False), ("2", "this lower line is long but has no dot", False),
    ("2.1", "this lower line is long and has a dot", True), ("3", "an overview of the whole protocol", True), ("1", "error", False), ("4", "ABCD", False), ("4.1", "ABCD", True), ("5", "42 things", False), ("12345678901234567890", "Long Number", False),
]


@pytest.mark.parametrize(("number", "title", "valid"), HEADERS)
def test_header_rules(spark, number, title, valid):
    assert one(spark, X.valid_header(F.col("n"), F.col("t")), n=number, t=title) is valid


def test_enumerations_and_numbers(spark):
    assert [one(spark, X.category_of(F.col("t")), t=t) for t in ("Proposed Standard", "best current practice", "Experimental", "historic", "other")] == ["std", "bcp", "exp", "historic", "info"]
    assert [one(spark, X.stream_of(F.col("t")), t=t) for t in ("IAB", "irtf", "ise", "ietf", "?")] == ["IAB", "IRTF", "independent", "IETF", "IETF"]
    assert [one(spark, X.valid_number(F.col("n")), n=n) for n in (0, 1, 99_999, 100_000)] == [False, True, True, False]
    assert one(spark, X.section_id(F.col("t")), t="section-3.5") == "3.5" and one(spark, X.trim(F.col("t")), t=" \t x ﻿") == "x"


def test_sentences_of_other_white_space(spark):
    text = "One. The client MUST go! Two."
    assert one(spark, X.sentence(F.col("t"), F.col("p")), t=text, p=text.index("MUST")) == "The client MUST go!"
