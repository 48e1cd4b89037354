"""Raw documents: folders of files, candidates from several sources, XML first and text as a fallback."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from specloom import dims
from specloom.functions import text as X
from specloom.sources.race import race

# Where documents come from, by priority.
XML_SOURCES = {"rfcEditor": "https://www.rfc-editor.org/rfc/rfc{n}.xml", "ietfTools": "https://xml2rfc.ietf.org/public/rfc/rfc{n}.xml", "datatracker": "https://datatracker.ietf.org/doc/rfc{n}/xml/"}
TEXT_SOURCES = {"rfcEditor": "https://www.rfc-editor.org/rfc/rfc{n}.txt", "ietfTools": "https://tools.ietf.org/rfc/rfc{n}.txt"}
METADATA_SOURCE = "https://datatracker.ietf.org/api/v1/doc/document/rfc{n}/"
TIMEOUT_S = 30  # of all sources of a document together


def read_folder(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """doc_id, body, source_name, priority of the files whose name ends in a number and .xml or .txt;
    one row a file."""
    ending = "xml" if kind == "xml" else "txt"
    rows = spark.read.option("pathGlobFilter", f"*.{ending}").text(path, wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_name"), rf"(\d+)\.{ending}$", 1).try_cast("int")
    return rows.select(number.alias("doc_id"), F.col("value").alias("body"), F.lit("folder").alias("source_name"), F.lit(0).alias("priority")).where("doc_id IS NOT NULL")


def is_valid(kind: str, body: Column) -> Column:
    """What a body must hold to be taken for a document of its kind."""
    parts = ("<?xml", "<rfc") if kind == "xml" else ("Request for Comments", "RFC ")
    return F.coalesce(body.contains(parts[0]) | body.contains(parts[1]), F.lit(False))


def first_valid(candidates: DataFrame, kind: str) -> DataFrame:
    """``candidates`` (doc_id, source_name, priority, body, error) -> of each document the valid body
    of the best priority, or the errors of all its sources."""
    ok = is_valid(kind, F.col("body"))
    error = F.concat("source_name", F.lit(": "), F.coalesce("error", F.lit("Invalid content")))
    best = F.min(F.when(ok, F.struct("priority", "source_name", "body"))).alias("b")
    errors = F.concat(F.lit("All sources failed: "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("priority", error.alias("e")))), lambda x: x["e"]), "; "))
    rows = candidates.groupBy("doc_id").agg(best, errors.alias("_e"))
    return rows.select("doc_id", "b.source_name", "b.body", F.when(F.col("b").isNull(), F.col("_e")).alias("error"))


def with_fallback(xml: DataFrame, text: DataFrame) -> DataFrame:
    """``xml``, ``text`` (doc_id, body, error), one row a document -> doc_id, source, body, error. Text
    stands in only where there is no XML and the document is older than XML is reliable."""
    x = xml.select("doc_id", F.col("body").alias("_x"), F.col("error").alias("_xe"))
    t = text.select("doc_id", F.col("body").alias("_t"), F.col("error").alias("_te"))
    old = F.col("doc_id") < dims.XML_FROM
    source = F.when(F.col("_x").isNotNull(), "xml").when(old & F.col("_t").isNotNull(), "text")
    message = F.when(old, F.concat(F.lit("Failed to fetch RFC "), F.col("doc_id").cast("string"), F.lit(".\nXML: "), F.coalesce("_xe", F.lit("not available")), F.lit("\nText: "), F.coalesce("_te", F.lit("not available")))).otherwise(F.concat(F.lit("Could not fetch RFC "), F.col("doc_id").cast("string"), F.lit(" XML.\nReason: "), F.coalesce("_xe", F.lit("Network error"))))
    return x.join(t, "doc_id", "full").select("doc_id", source.alias("source"), F.when(source == "xml", F.col("_x")).when(source == "text", F.col("_t")).alias("body"), F.when(source.isNull(), message).alias("error"))


def likely_xml(number: Column) -> Column:
    return number >= dims.XML_FROM


def metadata(responses: DataFrame) -> DataFrame:
    """``responses`` (doc_id, json) -> metadata rows; what can't be read gives the least there is, and is kept in
    ``rescued`` as it came."""
    schema = "title string, time string, std_level string, stream string, abstract string, _rescued string"
    j = F.from_json("json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rescued"})
    rows = responses.select("doc_id", j.alias("j"), "json")
    broken = F.col("json").isNotNull() & (F.col("j").isNull() | F.col("j._rescued").isNotNull())
    whole = F.when(~broken, F.col("j"))
    return rows.select(
        F.col("doc_id").alias("number"), F.coalesce(X.nonempty(whole["title"]), F.concat(F.lit("RFC "), F.col("doc_id").cast("string"))).alias("title"), F.array().cast("array<string>").alias("authors"), F.coalesce(whole["time"], F.lit("")).alias("date"),
        X.category_of(whole["std_level"]).alias("category"), X.stream_of(whole["stream"]).alias("stream"), X.nonempty(whole["abstract"]).alias("abstract"), F.when(broken, F.col("json")).alias("rescued"),
    )


class _Number(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class HttpDocuments(DataSource):
    """``spark.read.format("spec_http").option("kind", "xml").load().where("doc_id IN (1, 2)")``: a partition for
    each number; its sources are asked at once and the first valid answer counts. Numbers come from filters
    on doc_id, from the option ``numbers`` ("1,2"), or, where both are given, from what they share. Other
    options: ``timeout``, the seconds that all sources of a document have together, and ``sources``, JSON of names
    and addresses with ``{n}``. Filters are pushed down once ``register`` has set what Spark needs for it."""

    @classmethod
    def name(cls) -> str:
        return "spec_http"

    def schema(self) -> str:
        return "doc_id int, source_name string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HttpDocuments)


class _HttpReader(DataSourceReader):
    def __init__(self, options) -> None:
        listed = options.get("numbers")
        self.numbers = None if listed is None else sorted({int(x) for x in listed.split(",")})
        self.kind = options.get("kind", "xml")
        self.timeout = float(options.get("timeout", TIMEOUT_S))
        named = options.get("sources")
        self.templates = json.loads(named) if named else XML_SOURCES if self.kind == "xml" else TEXT_SOURCES

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("doc_id",):
                yield f
            else:
                wanted.discard(None)
                self.numbers = sorted(wanted if self.numbers is None else wanted & set(self.numbers))

    def partitions(self) -> list[InputPartition]:
        if self.numbers is None:
            raise ValueError("spec_http needs numbers: a filter on doc_id (=, IN) or the option numbers")
        return [_Number(n) for n in self.numbers]

    def _valid(self, body: str) -> bool:
        return any(x in body for x in (("<?xml", "<rfc") if self.kind == "xml" else ("Request for Comments", "RFC ")))

    def read(self, partition: _Number | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there are no partitions
            return
        n = partition.number
        answers = race({name: t.format(n=n) for name, t in self.templates.items()}, self.timeout, self._valid)
        yield n, answers.name, answers.body, None if answers.name else f"All sources failed: {'; '.join(answers.errors)}"
