"""Mixing sources to target weights with a low-discrepancy source schedule [native].

Golden-ratio points are mapped through the sources' cumulative weights, so that every prefix of
the schedule holds each source close to its weight. The slots of a source are ranked. The source's
documents, shuffled by a hash, are laid end to end and cut into blocks of equally many words; a
source that is taken more than once goes on with a second pass, shuffled anew. The slot of rank j
takes block j. So the schedule alone says what is taken: a source's words are those of its slots,
which a few blocks separate from its target. Blocks are small: 1/65,536 of the mix or 512 words.

Defined cases: a null text or one without words has size 0 and is never taken; a null source is a
source of its own, last in order; repeated rows are separate rows; an empty table gives an empty
result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.common import BUCKETS, fresh, materialise, running_sum, words_in

GOLDEN = 0.6180339887498949
#: Slots of a mix at least, unless blocks of one word are fewer, and words of a block at most.
LEAST_SLOTS, MOST_WORDS = 65_536, 512
#: Slots ranked together in one window partition.
SLOT_RANGE = 65_536


def source_key(source: Column) -> Column:
    """Never null; keeps the order by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` (skey, source_size), one row a source -> with weight and target, by water filling:
    targets are min(cap * size, level * weight) with the one level at which they add up to
    share * all sizes."""
    everything = Window.partitionBy()
    ordered = Window.orderBy("skey")
    ranked = sizes.select("skey", "source_size", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")).alias("weight"))
    rows = ranked.withColumns({"_cap": F.col("source_size") * float(cap), "_total": F.sum("source_size").over(everything) * float(share)}).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by_ratio = Window.orderBy("_ratio", "skey")
    earlier, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(onward))
    # the level is right at the first source, by ratio, that isn't above its cap
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "skey", "_level"))).over(everything)["_level"]
    return rows.withColumn("target", F.least("_cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("skey", "source_size", "weight", "target")


def golden_points(slot: Column) -> Column:
    return F.pmod((slot + 1) * F.lit(GOLDEN), F.lit(1.0))


def schedule(sources: DataFrame, n_slots: int, n_sources: int, points: Callable[[Column], Column] = golden_points) -> DataFrame:
    """``sources`` (skey, target) -> (skey, block, slot): which slot takes block j of a source."""
    spark = sources.sparkSession
    cells = max(4096, 4 * n_sources)
    cumulative = Window.orderBy("skey")
    edges = sources.where("target > 0").withColumn("_all", F.sum("target").over(Window.partitionBy())).withColumn("_hi", F.sum("target").over(cumulative.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_all"))
    # the last border is 1 whatever the rounding, so that every point has a source
    edges = edges.withColumns({"_hi": F.when(F.lead("skey").over(cumulative).isNull(), 1.0).otherwise(F.col("_hi")), "_lo": F.coalesce(F.lag("_hi").over(cumulative), F.lit(0.0))})
    in_cells = edges.select("skey", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.floor(F.col("_hi") * cells))).alias("_cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), points(F.col("id")).alias("_u")).withColumn("_cell", F.floor(F.col("_u") * cells))
    dealt = slots.join(in_cells, "_cell").where("_lo <= _u AND _u < _hi").select("skey", "slot", F.floor(F.col("slot") / SLOT_RANGE).alias("_range"), F.lit(1).alias("_one"))
    return running_sum(dealt, ["skey"], "_range", ["slot"], "_one", "block").select("skey", "block", "slot")


def _laid_out(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, block_words: int | None, seed: int, points: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """The rows (doc_id, _text, skey, size, rid); the sources with their targets; the rows that the passes
    lay out, with the words [_from, _to) of their source that they are; the schedule; words of a block."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), source_key(F.col("source")).alias("skey"), words_in(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("rid"))
    rows = materialise(rows, "mix-sizes")
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    sources = materialise(source_targets(sizes, weights, share, cap), "mix-sources")
    total, n_sources = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    block_words = block_words or max(1, min(MOST_WORDS, int(total) // LEAST_SLOTS))
    n_slots = round(total / block_words)
    slots = materialise(schedule(sources.select("skey", "target"), n_slots, n_sources, points), "mix-schedule")
    ends = slots.groupBy("skey").agg(((F.max("block") + 1) * block_words).alias("words"))
    # a pass lays out the source's rows once, in an order of its own; only those are needed that slots reach
    # written, so that Spark knows its size, one row a source, and needn't shuffle the rows by source
    known = materialise(sources.select("skey", "source_size").join(ends, "skey"), "mix-ends")
    passes = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))).alias("_pass")
    laid = rows.where("size > 0").join(known, "skey").select("rid", "doc_id", "_text", "skey", "size", "source_size", "words", passes).where(F.col("_pass") * F.col("source_size") < F.col("words"))
    laid = laid.withColumns({"_hash": F.xxhash64(F.lit(seed), "_pass", "doc_id"), "_bucket": F.pmod(F.xxhash64("doc_id", F.lit(seed), "_pass"), F.lit(BUCKETS))})
    laid = running_sum(laid, ["skey", "_pass"], "_bucket", ["_hash", "doc_id", "size", "rid"], "size", "_at")
    laid = laid.withColumn("_from", F.col("_at") + F.col("_pass") * F.col("source_size")).withColumn("_to", F.col("_from") + F.col("size"))
    return rows, sources, laid, slots, block_words


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int | None = None, seed: int = 42, points: Callable[[Column], Column] = golden_points) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, first_slot.

    weights: of the sources by code point, repeating. share: of all words that the mix holds.
    cap: times its own size that a source gives at most (a whole number). block_words: words in a
    block. first_slot: the first slot that takes words of the row, null if none does. points: of the
    slots, in [0, 1).
    """
    rows, sources, laid, slots, block = _laid_out(docs, weights, share, cap, block_words, seed, points)
    laid = laid.where("_from < words")
    blocks = laid.select("rid", "skey", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.least("_to", "words") - 1) / block))).alias("block"))
    overlap = F.least("_to", (F.col("block") + 1) * block) - F.greatest("_from", F.col("block") * block)
    taken = blocks.select("rid", "skey", "block", overlap.alias("_words")).join(slots, ["skey", "block"]).groupBy("rid").agg(F.sum("_words").alias("taken"), F.min("slot").alias("first_slot"))
    placed = rows.join(sources.select("skey", "source_size", "target"), "skey")
    return placed.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int | None = None, seed: int = 42, points: Callable[[Column], Column] = golden_points) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: in each pass a document comes with the slot
    that takes its middle word, or not at all. Rows without words are never taken. Rows of equal doc_id
    and text share what is taken of them: the mean, rounded."""
    rows, _, laid, slots, block = _laid_out(docs, weights, share, cap, block_words, seed, points)
    middle = laid.select("doc_id", "_text", "skey", F.floor((F.col("_from") + F.floor(F.col("size") / 2)) / block).alias("block"))
    key, text, n, same = (fresh(docs, x) for x in ("_mix_id", "_mix_text", "_mix_n", "_mix_same"))
    taken = middle.join(slots.select("skey", "block"), ["skey", "block"]).groupBy("doc_id", "_text").agg(F.count("*").alias("_taken"))
    alike = rows.where("size > 0").groupBy("doc_id", "_text").agg(F.count("*").alias("_rows"))
    plan = taken.join(alike, taken.doc_id.eqNullSafe(alike.doc_id) & (taken._text == alike._text)).select(taken.doc_id.alias(key), taken._text.alias(text), F.round(F.col("_taken") / F.col("_rows")).cast("int").alias(n)).where(F.col(n) > 0)
    plan = materialise(plan, "mix-plan")  # so that no plan on the driver holds the passes and the texts
    found = docs.withColumn(same, F.xxhash64("text")).join(plan, docs["doc_id"].eqNullSafe(plan[key]) & (F.col(same) == F.col(text)))
    return found.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
