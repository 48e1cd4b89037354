"""The flat tables that a corpus of specification documents parses to."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions import text as X

DOCS = "doc_id int, source string, title string, number int, doc_name string"
SECTIONS = "doc_id int, seq int, parent_seq int, depth int, number string, anchor string, section_id string, title string"
BLOCKS = "doc_id int, sec_seq int, block_ord int, type string, style string, language string, content string, items array<string>, tag_targets array<string>, section_id string, section_title string"
REFS = "doc_id int, ref_ord int, kind string, anchor string, rfc_number int, title string, target string"
DEFINITIONS = "doc_id int, def_ord int, term string, definition string, section string"


@dataclass(frozen=True)
class Parsed:
    docs: DataFrame
    sections: DataFrame
    blocks: DataFrame
    refs: DataFrame
    definitions: DataFrame

    def where_doc(self, doc_id: int) -> Parsed:
        return replace(self, **{f.name: getattr(self, f.name).where(F.col("doc_id") == doc_id) for f in fields(self)})

    def union(self, other: Parsed) -> Parsed:
        return Parsed(**{f.name: getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)})

    def persist(self) -> Parsed:
        for f in fields(self):
            getattr(self, f.name).persist()
        return self

    def unpersist(self) -> None:
        for f in fields(self):
            getattr(self, f.name).unpersist()

    def units(self) -> DataFrame:
        """Texts that may hold requirements: text blocks whole, lists item by item. They carry what is
        said of their section, so that nothing is joined for it."""
        texts = F.when(F.col("type") == "text", F.array("content")).when(F.col("type") == "list", F.col("items"))
        return self.blocks.select("doc_id", "sec_seq", "block_ord", "section_id", "section_title", F.col("type").alias("kind"), F.posexplode(texts).alias("item_ord", "text"))

    def xrefs(self) -> DataFrame:
        """References of text blocks (lists have none)."""
        found = F.posexplode(X.merged_references(F.col("content"), F.coalesce("tag_targets", F.array().cast("array<string>"))))
        return self.blocks.where("type = 'text'").select("doc_id", "sec_seq", "block_ord", found.alias("xref_ord", "r")).select("doc_id", "sec_seq", "block_ord", "xref_ord", "r.*")
