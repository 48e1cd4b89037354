"""Plain-text documents to flat tables. A document is cut into sections inside its own row, so the
corpus isn't shuffled; only section rows and lines of definitions are, by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom import dims
from specloom.functions import text as X
from specloom.operators.parsed import Parsed


def lines_of(body: Column) -> Column:
    return F.split(body, "\n", -1)


def _header(line: Column) -> Column:
    """struct<number, title, header, valid> of a line."""
    t = X.trim(line)
    number, title = F.regexp_replace(F.regexp_extract(t, X.HEADER, 1), r"\.$", ""), F.regexp_extract(t, X.HEADER, 2)
    is_header = t.rlike(X.HEADER)
    return X.let(F.struct(number.alias("number"), title.alias("title"), is_header.alias("header")), lambda h: F.struct(h["number"].alias("number"), h["title"].alias("title"), h["header"].alias("header"), (h["header"] & X.valid_header(h["number"], h["title"])).alias("valid")))


def title_of(lines: Column, number: Column) -> Column:
    """The first of the first lines that looks like a title."""
    head = F.transform(F.slice(lines, 1, dims.TITLE_LINES), X.trim)

    def fits(t: Column) -> Column:
        return (F.length(t) > dims.TITLE_LONGER_THAN) & (F.length(t) < dims.TITLE_SHORTER_THAN) & ~t.contains(":") & ~t.rlike(r"^\d") & ~F.lower(t).contains("request for comments")

    return F.coalesce(F.get(F.filter(head, fits), F.lit(0)), F.concat(F.lit("RFC "), number.cast("string")))


def sections_of(raw: DataFrame) -> DataFrame:
    """doc_id, seq, number, title, content: what a valid header opens, up to the next one."""
    empty = F.array().cast("array<string>")

    def cut(z: Column) -> Column:
        lines, heads = z["lines"], z["heads"]
        places = F.filter(F.transform(heads, lambda h, i: F.when(h["valid"], i)), lambda i: i.isNotNull())

        def section(p: Column, at: Column, j: Column) -> Column:
            end = F.coalesce(F.get(at, j + 1), F.size(lines))
            body = F.when(end - p > 1, F.slice(lines, p + 2, end - p - 1)).otherwise(empty)
            return F.struct((j + 1).alias("seq"), F.get(heads, p)["number"].alias("number"), F.get(heads, p)["title"].alias("title"), F.array_join(body, "\n").alias("content"))

        return X.let(places, lambda at: F.transform(at, lambda p, j: section(p, at, j)))

    found = X.let(lines_of(F.col("body")), lambda lines: X.let(F.struct(lines.alias("lines"), F.transform(lines, _header).alias("heads")), cut))
    return raw.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


def with_parents(sections: DataFrame) -> DataFrame:
    """depth and parent_seq: the nearest earlier section of smaller depth."""
    earlier = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = sections.withColumn("depth", F.size(F.split("number", r"\.", -1)))
    rows = rows.withColumns({f"_{d}": F.last(F.when(F.col("depth") == d, F.col("seq")), ignorenulls=True).over(earlier) for d in range(1, dims.MAX_DEPTH)})
    candidates = [F.when(F.col("depth") > d, F.col(f"_{d}")) for d in range(1, dims.MAX_DEPTH)]
    return rows.withColumn("parent_seq", F.greatest(*candidates)).drop(*(f"_{d}" for d in range(1, dims.MAX_DEPTH)))


def paragraphs(sections: DataFrame) -> DataFrame:
    """doc_id, sec_seq, section_id, section_title, block_ord, content: parts between blank lines, trimmed, empty ones left out."""
    parts = F.filter(F.transform(F.split("content", rf"\n{X.S}*\n", -1), X.trim), lambda p: p != "")
    return sections.select("doc_id", F.col("seq").alias("sec_seq"), F.col("number").alias("section_id"), F.col("title").alias("section_title"), F.posexplode(parts).alias("block_ord", "content"))


def cited(raw: DataFrame) -> DataFrame:
    """doc_id, ref_ord, rfc_number: other documents by first mention."""
    numbers = F.transform(F.regexp_extract_all("body", F.lit(X.DOC_REFERENCE), F.lit(1)), lambda n: n.try_cast("int"))
    others = F.filter(F.array_distinct(numbers), lambda n: n != F.col("doc_id"))
    return raw.select("doc_id", F.posexplode(others).alias("ref_ord", "rfc_number"))


def definition_lines(raw: DataFrame) -> DataFrame:
    """doc_id, def_ord, term, definition, section: ``term: text`` lines with the last numbered line
    above them. Only numbered lines and definitions are shuffled."""
    t = X.trim(F.col("line"))
    rows = raw.select("doc_id", F.posexplode(lines_of(F.col("body"))).alias("line_no", "line")).select("doc_id", "line_no", t.alias("t"))
    is_header = F.col("t").rlike(X.HEADER)
    rows = rows.where(is_header | F.col("t").rlike(X.DEFINITION)).withColumns({"_number": F.when(is_header, F.regexp_replace(F.regexp_extract("t", X.HEADER, 1), r"\.$", "")), "term": X.trim(F.regexp_extract("t", X.DEFINITION, 1)), "definition": X.trim(F.regexp_extract("t", X.DEFINITION, 2))})
    so_far = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("section", F.coalesce(F.last("_number", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    kept = rows.where(F.col("_number").isNull() & (F.length("term") >= dims.MIN_TERM) & (F.length("definition") >= dims.MIN_DEFINITION))
    return kept.select("doc_id", F.row_number().over(so_far).alias("def_ord"), "term", "definition", "section")


def parse_text(raw: DataFrame) -> Parsed:
    """``raw`` (doc_id, body) -> the flat tables. A null body has no rows but the document's own."""
    raw = raw.select("doc_id", F.coalesce("body", F.lit("")).alias("body"))
    cut = sections_of(raw)
    null = F.lit(None).cast("string")
    sections = with_parents(cut.drop("content")).select("doc_id", "seq", "parent_seq", "depth", "number", null.alias("anchor"), F.col("number").alias("section_id"), "title")
    blocks = paragraphs(cut).select("doc_id", "sec_seq", "block_ord", F.lit("text").alias("type"), null.alias("style"), null.alias("language"), "content", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<string>").alias("tag_targets"), "section_id", "section_title")
    refs = cited(raw).select("doc_id", "ref_ord", F.lit("informative").alias("kind"), F.concat(F.lit("RFC"), "rfc_number").alias("anchor"), "rfc_number", F.concat(F.lit("RFC "), "rfc_number").alias("title"), null.alias("target"))
    docs = raw.select("doc_id", F.lit("text").alias("source"), title_of(lines_of(F.col("body")), F.col("doc_id")).alias("title"), F.col("doc_id").alias("number"), null.alias("doc_name"))
    return Parsed(docs, sections, blocks, refs, definition_lines(raw))
