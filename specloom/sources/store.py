"""A store of parsed documents, keyed by a digest of source and body: what hasn't changed isn't parsed again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.operators.parsed import Parsed
from specloom.storage import exists

SEEN = "doc_id int, digest string"
_TABLES = [f.name for f in fields(Parsed)]


def digest(source: Column, body: Column) -> Column:
    """Of a null body or source: another one than of any text."""
    return F.sha2(F.concat(*[F.when(x.isNull(), "0").otherwise(F.concat(F.lit("1"), F.length(x).cast("string"), F.lit(":"), x)) for x in (source, body)]), 256)


class ParseStore:
    """The flat tables below ``path``, one folder a generation. An update writes the tables of changed documents, then
    the list of their digests: a generation without its list doesn't count, and the next update writes it
    anew, so an update that broke off can be repeated. A document counts in its newest generation; one that
    is gone has a null digest there. One update at a time.

    Defined cases: rows without doc_id are left out; of rows with one doc_id the one with the least digest is
    taken; a null body is a document of its own kind; no documents: all are gone."""

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[DataFrame], Parsed]) -> None:
        self.spark, self.path, self._parse = spark, path.rstrip("/"), parse

    def _read(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, generation int")
        return self.spark.read.schema(f"{schema}, generation int").parquet(f"{self.path}/{name}")

    def current(self) -> DataFrame:
        """doc_id, digest, generation of the documents that are there."""
        newest = self._read("seen", SEEN).groupBy("doc_id").agg(F.max_by("digest", "generation").alias("digest"), F.max("generation").alias("generation"))
        return newest.where("digest IS NOT NULL")

    def changes(self, raw: DataFrame) -> DataFrame:
        """doc_id, digest, change (new, changed, gone): against what is stored. Bodies aren't shuffled."""
        given = raw.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("int").alias("doc_id")).agg(F.min(digest(F.col("source"), F.col("body"))).alias("digest"))
        known = self.current().select("doc_id", F.col("digest").alias("_known"))
        both = given.join(known, "doc_id", "full")
        change = F.when(F.col("_known").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("digest") != F.col("_known"), "changed")
        return both.select("doc_id", "digest", change.alias("change")).where("change IS NOT NULL")

    def update(self, raw: DataFrame) -> DataFrame:
        """Parse the documents of ``raw`` (doc_id, source, body), which are all there are, that are new or changed.
        Gives their changes."""
        last = self._read("seen", SEEN).agg(F.max("generation")).head()[0]
        to = f"generation={(last or 0) + 1}"
        pending = f"{self.path}/pending/{to}"
        self.changes(raw).write.mode("overwrite").parquet(pending)
        changed = self.spark.read.schema(f"{SEEN}, change string").parquet(pending)
        keyed = raw.select(F.col("doc_id").cast("int").alias("doc_id"), "source", "body", digest(F.col("source"), F.col("body")).alias("digest"))
        todo = keyed.join(changed.where("change <> 'gone'").select("doc_id", "digest"), ["doc_id", "digest"], "left_semi")
        # equal rows of a document are one
        parsed = self._parse(todo.groupBy("doc_id", "digest").agg(F.first("source").alias("source"), F.first("body").alias("body")).drop("digest"))
        for name in _TABLES:
            getattr(parsed, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/{to}")
        changed.select("doc_id", "digest").write.mode("overwrite").parquet(f"{self.path}/seen/{to}")
        return changed

    def parsed(self) -> Parsed:
        """The tables of all documents that are there."""
        now = self.current().select("doc_id", "generation")
        schemas = {name: self.spark.read.parquet(f"{self.path}/{name}") for name in _TABLES}
        return Parsed(**{name: df.join(now, ["doc_id", "generation"], "left_semi").drop("generation") for name, df in schemas.items()})
