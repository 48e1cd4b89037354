"""Results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def checklist_files(markdown: DataFrame, docs: DataFrame, generated_by: str) -> DataFrame:
    """doc_id, value: a checklist with a head line and, for text sources, a note on the source."""
    note = F.when(F.col("source") == "text", "\n> Parsed from text format; accuracy may be limited.\n").otherwise("")
    rows = markdown.join(docs.select("doc_id", "source"), "doc_id")
    return rows.select("doc_id", F.concat(F.lit(f"<!-- {generated_by} -->\n"), note, F.lit("\n"), "markdown").alias("value"))


def write_checklists(files: DataFrame, path: str) -> None:
    """A folder doc_id=N for each document."""
    files.write.mode("overwrite").partitionBy("doc_id").text(path)
