"""Section lookup and relations, citations both ways, definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions import text as X
from specloom.operators.parsed import Parsed


def section_index(sections: DataFrame) -> DataFrame:
    """doc_id, key -> seq, title: the first section, in document order, whose number or anchor, as it
    is or without ``section-``, is the key."""
    names = F.array_distinct(F.array_compact(F.array(X.nonempty(F.col("number")), X.section_id(X.nonempty(F.col("number"))), X.nonempty(F.col("anchor")), X.section_id(X.nonempty(F.col("anchor"))))))
    keys = sections.select("doc_id", "seq", "title", F.explode(names).alias("key"))
    return keys.groupBy("doc_id", "key").agg(F.min(F.struct("seq", "title")).alias("s")).select("doc_id", "key", "s.seq", "s.title")


def find_section(sections: DataFrame, target: str) -> DataFrame:
    """The first section, in document order, that either form of ``target`` names."""
    keys = {target, target.removeprefix("section-")}
    return section_index(sections).where(F.col("key").isin(list(keys))).groupBy("doc_id").agg(F.min(F.struct("seq", "title")).alias("s")).select("doc_id", "s.*")


def related_sections(parsed: Parsed) -> DataFrame:
    """doc_id, seq, title, related_ord, related_number, related_title: what each section's text
    refers to, each target once by first mention; targets without a section are Unknown."""
    order = F.min(F.struct("block_ord", "xref_ord"))
    targets = parsed.xrefs().where("type = 'section' AND section <> ''").groupBy("doc_id", "sec_seq", F.col("section").alias("related_number")).agg(order.alias("related_ord"))
    index = section_index(parsed.sections).select("doc_id", F.col("key").alias("_key"), F.col("title").alias("related_title"))
    own = parsed.sections.select("doc_id", F.col("seq").alias("sec_seq"), "section_id", "title")
    rows = targets.withColumn("_key", X.section_id(F.col("related_number"))).join(index, ["doc_id", "_key"], "left").join(own, ["doc_id", "sec_seq"])
    return rows.select("doc_id", "sec_seq", "section_id", "title", "related_ord", "related_number", F.coalesce(X.nonempty(F.col("related_title")), F.lit("Unknown")).alias("related_title"))


def reference_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("doc_id").agg(F.count_if(F.col("kind") == "normative").alias("normative"), F.count_if(F.col("kind") == "informative").alias("informative"))


def referenced_by(refs: DataFrame) -> DataFrame:
    """doc_id (cited), n_citing, citing: over the whole corpus. A much cited document's list is as long
    as the number of documents that cite it."""
    cites = refs.where("rfc_number IS NOT NULL").select(F.col("rfc_number").alias("cited"), "doc_id").distinct()
    return cites.groupBy(F.col("cited").alias("doc_id")).agg(F.count("*").alias("n_citing"), F.sort_array(F.collect_list("doc_id")).alias("citing"))


def search_definitions(definitions: DataFrame, term: str | None) -> DataFrame:
    """Those whose term or text contains ``term`` in any case; all for an empty one."""
    if not term:
        return definitions
    t = term.lower()
    return definitions.where(F.lower("term").contains(t) | F.lower("definition").contains(t))
