"""Text functions over Columns, all of them built from JVM expressions.

``let`` binds an array once for lambdas that look into it: an optimizer that merges projections
could otherwise copy a costly expression into a lambda and evaluate it for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom import dims

#: What trimming strips and what separates words: ASCII and Unicode white space, BOM and NBSP included.
WHITE = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
S = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Word borders in ASCII; \b looks at Unicode letters in Java 17.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
LEVEL = f"{BEFORE}({'|'.join(dims.LEVELS)}){AFTER}"
HEADER = rf"^(\d+(?:\.\d+)*\.?){S}+(.+)$"
DEFINITION = rf"^{S}*([A-Za-z](?:[A-Za-z0-9\-]|{S})*[A-Za-z0-9]){S}*[-:]{S}+(.+)$"
DOC_REFERENCE = rf"(?i)RFC{S}*(\d+)"
SECTION_REFERENCE = rf"[Ss]ection{S}+([\d.]+)"
XREF = "struct<target:string,type:string,section:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def nonempty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


#: Values that a running sum adds up anew for each of them; longer arrays go in parts of so many.
RUN = 32


def sums_before(values: Column, levels: int = 3) -> Column:
    """For each of an array's numbers the sum of those before it. Sums of parts come first, then those inside
    the parts, so the work grows with the length, up to RUN ** (levels + 1) numbers."""

    def total(x: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(x, start, n), F.lit(0), lambda a, y: a + y)

    short = let(values, lambda v: F.transform(v, lambda x, i: total(v, F.lit(1), i)))
    if not levels:
        return short

    def long(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda b: total(v, b * RUN + 1, F.lit(RUN)))
        return let(sums_before(parts, levels - 1), lambda s: F.transform(v, lambda x, i: F.get(s, F.floor(i / RUN).cast("int")) + total(v, i - i % RUN + 1, i % RUN)))

    return F.when(F.size(values) <= RUN, short).otherwise(let(values, long))


def markers(text: Column) -> Column:
    """array<struct<level, pos>>: all keywords with their offsets, left to right. An offset is the
    length of the pieces between keywords, and of keywords, before it."""

    def place(z: Column) -> Column:
        lengths = F.transform(z["s"], lambda s, i: F.length(s) + F.coalesce(F.length(F.get(z["k"], i)), F.lit(0)))
        return let(sums_before(lengths), lambda at: F.transform(z["k"], lambda k, i: F.struct(k.alias("level"), (F.get(at, i) + F.length(F.get(z["s"], i))).alias("pos"))))

    pieces = F.struct(F.regexp_extract_all(text, F.lit(LEVEL), F.lit(1)).alias("k"), F.split(text, LEVEL, -1).alias("s"))
    return F.when(text.rlike(LEVEL), let(pieces, place)).otherwise(F.array().cast("array<struct<level:string,pos:int>>"))


def sentence(text: Column, pos: Column) -> Column:
    """From after the last end mark before ``pos`` that white space follows, to the first end mark at
    or after it."""
    before = F.substring(text, F.lit(1), pos)
    start = F.when(before.rlike(rf"[.!?]{S}"), F.regexp_extract(before, rf"(?s)^.*[.!?]({S}.*)$", 1)).otherwise(before)
    return trim(F.concat(start, F.regexp_extract(F.substring(text, pos + 1, F.length(text)), r"(?s)^[^.!?]*[.!?]?", 0)))


def cross_references(text: Column) -> Column:
    """References to documents first, then to sections, each in text order."""
    docs = F.transform(F.regexp_extract_all(text, F.lit(DOC_REFERENCE), F.lit(1)), lambda n: F.struct(F.concat(F.lit("RFC"), n).alias("target"), F.lit("rfc").alias("type"), F.lit(None).cast("string").alias("section")))
    sections = F.transform(F.regexp_extract_all(text, F.lit(SECTION_REFERENCE), F.lit(1)), lambda s: F.struct(s.alias("target"), F.lit("section").alias("type"), s.alias("section")))
    return F.concat(docs.cast(f"array<{XREF}>"), sections.cast(f"array<{XREF}>"))


def tag_references(targets: Column) -> Column:
    """References of markup targets: ``section-N`` and dotted numbers, document numbers, anchors."""

    def kind(t: Column) -> Column:
        number = F.regexp_replace(t, "^section-", "")
        is_section = t.startswith("section-") | t.rlike(r"^\d+(\.\d+)*$")
        is_doc = t.rlike(r"^(?i)RFC\d+$")
        return F.struct(F.when(is_section, number).when(is_doc, F.upper(t)).otherwise(t).alias("target"), F.when(is_doc & ~is_section, "rfc").otherwise("section").alias("type"), F.when(is_section, number).when(~is_doc, t).alias("section"))

    return F.transform(targets, kind).cast(f"array<{XREF}>")


def merged_references(text: Column, targets: Column) -> Column:
    """Those of the text, then those of markup whose target isn't among them."""
    return let(cross_references(text), lambda own: F.concat(own, let(F.transform(own, lambda r: r["target"]), lambda seen: F.filter(tag_references(targets), lambda r: ~F.array_contains(seen, r["target"])))))


def components(text: Column, level: Column) -> dict[str, Column]:
    """subject, condition, exception and action of a requirement; null where there is none."""
    action = F.lit(None).cast("string")
    for name in dims.LEVELS:  # a literal pattern for each level: compiled once
        action = F.when(level == name, F.regexp_extract(text, rf"(?i){name}{S}+(.+?)(?:\.|,|\z)", 1)).otherwise(action)
    return {
        "subject": F.lower(nonempty(F.regexp_extract(text, rf"(?i)^(?:The{S}+)?(\w+(?:{S}+\w+)?){S}+(?:MUST|SHALL|SHOULD|MAY)", 1))),
        "action": nonempty(trim(action)),
        "condition": nonempty(trim(F.regexp_extract(text, rf"(?i){BEFORE}(if|when|unless|where|in case){S}+([^,.]+)", 2))),
        "exception": nonempty(trim(F.regexp_extract(text, rf"(?i){BEFORE}(unless|except|excluding){S}+([^,.]+)", 2))),
    }


def level_of(text: Column) -> Column:
    return nonempty(F.regexp_extract(F.upper(text), LEVEL, 1))


def _words(text: Column, strip: str) -> Column:
    return F.transform(F.split(F.lower(text), f"{S}+", -1), lambda w: F.regexp_replace(w, strip, ""))


def _among(x: Column, values) -> Column:
    return x.isin(list(values))


def subject_of(text: Column) -> Column:
    return F.get(F.filter(_words(text, "[^a-z]"), lambda w: _among(w, dims.SUBJECT_TERMS)), F.lit(0))


def keyword_words(text: Column) -> Column:
    """The words that count as keywords, with repeats, in order."""
    return F.filter(_words(text, "[^a-z0-9]"), lambda w: (F.length(w) >= dims.MIN_KEYWORD) & ~_among(w, dims.STOP_WORDS))


def keyword_weight(word: Column) -> Column:
    return F.when(_among(word, dims.SUBJECT_TERMS), dims.SUBJECT_WEIGHT).when(_among(word, dims.TECHNICAL_TERMS), dims.TECHNICAL_WEIGHT).otherwise(dims.REGULAR_WEIGHT)


def keywords(text: Column) -> Column:
    """array<struct<keyword, weight>> by first occurrence; repeats add up. Sorted, equal words are runs."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k)["w"] != F.get(s, k - 1)["w"]))

        def counted(at: Column) -> Column:
            each = F.transform(at, lambda k, i: F.struct(F.get(s, k)["i"].alias("i"), F.get(s, k)["w"].alias("w"), (F.coalesce(F.get(at, i + 1), F.size(s)) - k).alias("n")))
            return F.transform(F.sort_array(each), lambda x: F.struct(x["w"].alias("keyword"), (keyword_weight(x["w"]) * x["n"]).alias("weight")))

        return F.when(F.size(s) > 0, let(starts, counted)).otherwise(F.array().cast("array<struct<keyword:string,weight:int>>"))

    return let(F.sort_array(F.transform(keyword_words(text), lambda w, i: F.struct(w.alias("w"), i.alias("i")))), runs)


def _any_of(text: Column, parts) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def does(text: Column, positive: str, negatives) -> Column:
    """Whether a lower-case text does an action: names it, and none of its negations."""
    return ~_any_of(text, negatives) & text.contains(positive)


def contradict(a: Column, b: Column) -> Column:
    """Whether one of two lower-case texts does what the other negates, for any pair."""
    found = F.lit(False)
    for positive, negatives in dims.NEGATIONS:
        found = found | (does(a, positive, negatives) & _any_of(b, negatives)) | (_any_of(a, negatives) & does(b, positive, negatives))
    return found


def does_forbidden(statement: Column, forbidden: Column) -> Column:
    """Whether a statement does an action that a prohibition names among its first words."""
    found = F.lit(False)
    for positive, negatives in dims.NEGATIONS:
        at = F.locate(positive, forbidden) - 1
        found = found | ((at >= 0) & (at <= dims.PRIMARY_WITHIN) & does(statement, positive, negatives))
    return found


def section_id(x: Column) -> Column:
    return F.regexp_replace(x, "^section-", "")


def valid_header(number: Column, title: Column) -> Column:
    """Whether a numbered line opens a section. ``number`` has no trailing dot."""
    t = trim(title)
    parts = F.split(number, r"\.", -1)
    has_word = _any_of(F.lower(t), dims.HEADER_WORDS)
    first = F.get(parts, F.lit(0))
    return (
        F.when(F.size(parts) > dims.MAX_DEPTH, False).when((F.length(first) > 9) | (F.try_to_number(F.substring(first, 1, 9), F.lit("999999999")) > dims.MAX_FIRST_NUMBER), False)
        .when(F.length(t) < 3, False).when(t.rlike("^[a-z]") & (F.length(t) < 20), False).when(has_word, True).when(t.rlike("^[A-Z]") & (F.length(t) >= 5), True).otherwise(F.size(parts) >= 2)
    )


def category_of(x: Column) -> Column:
    level = F.lower(x)
    return F.when(level.isin("proposed standard", "draft standard", "internet standard"), "std").when(level == "best current practice", "bcp").when(level == "experimental", "exp").when(level == "historic", "historic").otherwise("info")


def stream_of(x: Column) -> Column:
    return F.when(F.lower(x) == "iab", "IAB").when(F.lower(x) == "irtf", "IRTF").when(F.lower(x) == "ise", "independent").otherwise("IETF")


def source_note(source: Column, context: str) -> Column:
    return F.when(source == "text", dims.TEXT_NOTES[context])


def valid_number(x: Column) -> Column:
    return F.coalesce(x.between(dims.MIN_NUMBER, dims.MAX_NUMBER), F.lit(False))
