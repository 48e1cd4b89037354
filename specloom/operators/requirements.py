"""Requirement extraction, filters, ids and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import text as X
from specloom.operators.parsed import Parsed

ORDER = ("sec_seq", "block_ord", "item_ord", "marker_ord")


def in_sections(section: Column, wanted: Sequence[str], with_subsections: bool = True) -> Column:
    """Whether a section is one of those wanted or, by default, below one. None wanted: all."""
    if not wanted:
        return F.lit(True)
    own, found = X.section_id(section), F.lit(False)
    for w in wanted:
        w = w.removeprefix("section-")
        found = found | (own == w) | (own.startswith(w + ".") if with_subsections else F.lit(False))
    return found


def in_named_sections(section: Column, wanted: Column, with_subsections: Column) -> Column:
    """As in_sections, where each row has an array of its own; an empty or null one: all."""
    own = X.section_id(section)

    def named(w: Column) -> Column:
        w = X.section_id(w)
        return (own == w) | (with_subsections & own.startswith(F.concat(w, F.lit("."))))

    return (F.coalesce(F.size(wanted), F.lit(0)) <= 0) | F.exists(wanted, named)


def marked_units(units: DataFrame, level: str | Column | None = None) -> DataFrame:
    """A row for each keyword of each unit; a level, or each row's own, is filtered before anything is exploded."""
    found = X.markers(F.col("text"))
    marked = F.transform(found, lambda m, i: F.struct(i.alias("marker_ord"), m["level"].alias("level"), m["pos"].alias("pos")))
    if isinstance(level, Column):
        marked = F.filter(marked, lambda m: F.coalesce(m["level"] == level, F.lit(True)))
    elif level:
        marked = F.filter(marked, lambda m: m["level"] == level)
    return units.select("*", F.explode(marked).alias("m")).select(*units.columns, "m.*")


def extract_requirements(parsed: Parsed, sections: Sequence[str] = (), level: str | None = None, with_subsections: bool = True, with_components: bool = True) -> DataFrame:
    """The requirements of each document in order; ids count what the filters leave. Sections are
    filtered before their texts are searched."""
    return extract_from(parsed.units().where(in_sections(F.col("section_id"), sections, with_subsections)), level, with_components)


def unnumbered(units: DataFrame, level: str | Column | None = None, with_components: bool = True) -> DataFrame:
    """The columns of ``units`` and ORDER, with level, req_text and components: made row by row."""
    rows = marked_units(units, level)
    rows = rows.withColumn("req_text", F.when(F.col("kind") == "text", X.sentence(F.col("text"), F.col("pos"))).otherwise(X.trim(F.col("text"))))
    parts = X.components(F.when(F.col("kind") == "text", F.col("req_text")).otherwise(F.col("text")), F.col("level")) if with_components else {c: F.lit(None).cast("string") for c in ("subject", "action", "condition", "exception")}
    return rows.withColumns(parts)


def named(rows: DataFrame) -> DataFrame:
    """Requirements of rows that have their number in req_ord."""
    return rows.select(
        "doc_id", "req_ord", F.concat(F.lit("R-"), "section_id", F.lit("-"), F.col("req_ord").cast("string")).alias("id"), "level", F.col("req_text").alias("text"), "subject", "action", "condition", "exception", F.col("section_id").alias("section"), "section_title", F.col("text").alias("full_context"),
    )


def extract_from(units: DataFrame, level: str | Column | None = None, with_components: bool = True) -> DataFrame:
    """As extract_requirements, from units with section_id and section_title. One shuffle, by document."""
    order = Window.partitionBy("doc_id").orderBy(*ORDER)
    return named(unnumbered(units, level, with_components).withColumn("req_ord", F.row_number().over(order)))


def count_by_level(requirements: DataFrame) -> DataFrame:
    """doc_id, level, n; only levels that occur."""
    return requirements.groupBy("doc_id", "level").agg(F.count("*").alias("n"))


def level_rollup(requirements: DataFrame) -> DataFrame:
    """level, n, and the total with a null level."""
    return requirements.rollup("level").agg(F.count("*").alias("n"))


def level_stats(requirements: DataFrame) -> DataFrame:
    """doc_id, total, by_level as a map."""
    counts = count_by_level(requirements)
    return counts.groupBy("doc_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "n")))).alias("by_level"))
