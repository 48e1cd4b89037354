"""Structured Streaming: documents as they arrive in a folder, parsed batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from specloom.operators import requirements, text_parse
from specloom.operators.requirements import extract_requirements


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, body of new .txt files; the name ends in the number."""
    rows = spark.readStream.schema("value string").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.txt$", 1).try_cast("int")
    return rows.select(number.alias("doc_id"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("arrived")).where("doc_id IS NOT NULL")


def first_arrivals(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """A document that arrives again within the delay is passed on once."""
    return stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["doc_id"])


def paragraph_stream(stream: DataFrame) -> DataFrame:
    """doc_id, sec_seq, block_ord, content: cut inside each row, so no state is kept."""
    return text_parse.paragraphs(text_parse.sections_of(stream.select("doc_id", "body")))


def write_requirements(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Requirements of each batch's documents, one folder a batch: a batch that runs again after a
    failure replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = extract_requirements(text_parse.parse_text(batch.select("doc_id", "body")))
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Numbers(StatefulProcessor):
    """State of a document: how many requirements it has had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._had = handle.getValueState("had", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order = ["piece", *requirements.ORDER]
        found = pd.concat(list(rows)).sort_values(order, kind="stable")  # what a batch brings of one document
        had = self._had.get()[0] if self._had.exists() else 0
        found["req_ord"] = range(had + 1, had + 1 + len(found))
        self._had.update((had + len(found),))
        yield found

    def close(self) -> None:
        pass


def numbered_requirements(pieces: DataFrame) -> DataFrame:
    """A stream of requirements from one of documents that arrive in pieces (doc_id, piece, body): their numbers go on
    from where the document's last batch ended, after a restart too. A piece begins at a section's header; the
    pieces of a batch count in order, and a piece that comes late counts where it comes. Needs the RocksDB state
    store (``use_rocksdb``). Pieces without doc_id are left out; a null body has no requirements."""
    raw = pieces.where("doc_id IS NOT NULL").select(F.struct("doc_id", "piece").alias("doc_id"), F.coalesce("body", F.lit("")).alias("body"))
    units = text_parse.paragraphs(text_parse.sections_of(raw)).select("doc_id.doc_id", "doc_id.piece", "sec_seq", "block_ord", "section_id", "section_title", F.lit("text").alias("kind"), F.lit(0).alias("item_ord"), F.col("content").alias("text"))
    rows = requirements.unnumbered(units)
    schema = StructType([*rows.schema.fields, StructField("req_ord", IntegerType())])
    numbered = rows.groupBy("doc_id").transformWithStateInPandas(_Numbers(), outputStructType=schema, outputMode="Append", timeMode="None")
    return requirements.named(numbered)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
