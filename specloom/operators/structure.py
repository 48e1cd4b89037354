"""The nested structure of documents, as JSON made in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import text as X
from specloom.operators.parsed import Parsed


def levels(sections: Column) -> Column:
    """Of sections in document order (seq, parent_seq) the number of their ancestors, and one: a fold over the path of
    open sections, which is cut back to a section's parent."""

    def step(acc: Column, s: Column) -> Column:
        at = F.coalesce(F.array_position(acc["path"], s["parent_seq"]), F.lit(0)).cast("int")
        return F.struct(F.concat(F.slice(acc["path"], F.lit(1), at), F.array(s["seq"])).alias("path"), F.concat(acc["levels"], F.array(at + 1)).alias("levels"))

    none = F.array().cast("array<int>")
    return F.aggregate(sections, F.struct(none.alias("path"), none.alias("levels")), step, lambda acc: acc["levels"])


def _nested(sections: Column) -> Column:
    """JSON of the tree: each section's fields, then what opens or closes up to the next one. ``sections`` have json,
    an object without its end."""

    def texts(z: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            level, after = F.get(z["levels"], i), F.coalesce(F.get(z["levels"], i + 1), F.lit(1))
            end = F.when(i + 1 == F.size(z["s"]), "").when(after > level, ',"subsections":[').otherwise(",")
            return F.concat(s["json"], F.when(after <= level, F.concat(F.lit("}"), F.repeat(F.lit("]}"), level - after))).otherwise(""), end)

        return F.concat(F.lit("["), F.array_join(F.transform(z["s"], piece), ""), F.lit("]"))

    return X.let(F.struct(sections.alias("s"), levels(sections).alias("levels")), texts)


def structure_json(parsed: Parsed, with_content: bool = False) -> DataFrame:
    """doc_id, structure: metadata, nested sections (with their blocks on request) and numbers of references. A document is
    one row, as its answer is; nothing else is gathered."""
    fields = F.struct("number", "title", "anchor")
    sections = parsed.sections.select("doc_id", "seq", "parent_seq", F.to_json(fields).alias("j"))
    sections = sections.withColumn("j", F.substring("j", F.lit(1), F.length("j") - 1))
    if with_content:
        block = F.struct("block_ord", F.to_json(F.struct("type", "style", "language", "content", "items")).alias("j"))
        blocks = parsed.blocks.groupBy("doc_id", F.col("sec_seq").alias("seq")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda b: b["j"]), ",").alias("blocks"))
        sections = sections.join(blocks, ["doc_id", "seq"], "left").withColumn("j", F.concat("j", F.lit(',"content":['), F.coalesce("blocks", F.lit("")), F.lit("]")))
    trees = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "parent_seq", F.col("j").alias("json")))).alias("s"))
    counts = parsed.refs.groupBy("doc_id").agg(F.count_if(F.col("kind") == "normative").alias("normative"), F.count_if(F.col("kind") == "informative").alias("informative"))
    rows = parsed.docs.join(trees, "doc_id", "left").join(counts, "doc_id", "left").fillna(0, ["normative", "informative"])
    about = F.to_json(F.struct("title", F.col("doc_name").alias("docName"), "number"))
    tree = F.coalesce(_nested(F.col("s")), F.lit("[]"))
    note = F.to_json(F.struct(F.col("source").alias("_source"), X.source_note(F.col("source"), "structure").alias("_sourceNote")))
    whole = F.concat(F.lit('{"metadata":'), about, F.lit(',"sections":'), tree, F.lit(',"referenceCount":'), F.to_json(F.struct("normative", "informative")), F.lit(","), F.substring(note, F.lit(2), F.length(note)))
    return rows.select("doc_id", whole.alias("structure"))
