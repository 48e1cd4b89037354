"""Checklists: roles, classes, counts and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom import dims

# Headings of the classes.
HEADINGS = {
    "must": "## Mandatory Requirements (MUST / REQUIRED / SHALL)",
    "should": "## Recommended Requirements (SHOULD / RECOMMENDED)",
    "may": "## Optional Requirements (MAY / OPTIONAL)",
}


def _one_sided(role: Column) -> Column:
    return F.coalesce(~role.isin("", "both"), F.lit(False))


def for_role(requirements: DataFrame, role: str | Column | None) -> DataFrame:
    """client: not those of the server alone. Any other role but both: as for server. A column: each row's own."""
    role = role if isinstance(role, Column) else F.lit(role).cast("string")
    subject = F.coalesce(F.lower("subject"), F.lit(""))
    client, server = subject.contains("client"), subject.contains("server")
    return requirements.where(F.when(~_one_sided(role), True).when(role == "client", client | ~server).otherwise(server | ~client))


def class_of(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, levels in dims.CLASSES.items():
        out = F.when(level.isin(list(levels)), name).otherwise(out)
    return out


def items(requirements: DataFrame, role: str | Column | None = None) -> DataFrame:
    """The requirements of a role with class and checked."""
    return for_role(requirements, role).withColumns({"class": class_of(F.col("level")), "checked": F.lit(False)})


def stats(checklist: DataFrame) -> DataFrame:
    """doc_id, must, should, may, total."""
    return checklist.groupBy("doc_id").agg(*[F.count_if(F.col("class") == c).alias(c) for c in dims.CLASSES], F.count("class").alias("total"))


def markdown(docs: DataFrame, checklist: DataFrame, role: str | Column | None, generated_at: str) -> DataFrame:
    """doc_id, markdown of each document, also of those without requirements. A document's items are
    gathered in one row, which its own size bounds. A role that is a column is one of ``docs``."""
    role = role if isinstance(role, Column) else F.lit(role).cast("string")
    line = F.concat(F.lit("- [ ] "), "text", F.lit(" ("), "section", F.lit(")"))
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("class") == c, F.struct("req_ord", line.alias("line"))))), lambda x: x["line"]).alias(c) for c in dims.CLASSES]
    rows = docs.select("doc_id", "number", "title", role.alias("_role")).join(checklist.groupBy("doc_id").agg(*lists), "doc_id", "left")
    blank = F.array(F.lit(""))
    head = [F.array(F.concat(F.lit("# RFC "), F.col("number").cast("string"), F.lit(" Implementation Checklist"))), blank, F.array(F.concat(F.lit("**"), "title", F.lit("**"))), blank]
    head += [F.when(_one_sided(F.col("_role")), F.array(F.concat(F.lit("Role: "), "_role"), F.lit(""))).otherwise(F.array().cast("array<string>"))]
    head += [F.array(F.lit(f"Generated: {generated_at}")), blank]
    parts = [F.when(F.size(F.coalesce(c, F.array())) > 0, F.concat(F.array(F.lit(HEADINGS[c]), F.lit("")), F.col(c), blank)).otherwise(F.array().cast("array<string>")) for c in dims.CLASSES]
    return rows.select("doc_id", F.array_join(F.concat(*head, *parts), "\n").alias("markdown"))
