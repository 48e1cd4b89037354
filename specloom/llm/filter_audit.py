"""Audit of filters that overlap: what each of them removes in any order.

Five filters look at a document (letters as in FILTERS). Four look at its text alone; the fifth, copies,
needs the table. For it rows are routed by the xxHash of their text, as an RDD: each task first keeps
chains of its own, for each hash the different texts with that hash, whole, with their smallest id. Rows
with a larger id are copies already there and travel without text; each text travels once, so a
text in a third of all rows comes once from each task. Partitions get their rows by hash, sorted by it (Spark
spills what doesn't fit), so a task holds the chain of one hash. What is not the smallest id of its text goes
out as a copy.

Then a document is a mask of five bits. A part (a source) is a vector of counts by mask, of all its documents, of
the good and of the toxic ones: ``combineByKey`` merges such vectors, at most 96 numbers a part and task. Every
order, step and Shapley value follows from a part's vector.

Defined cases: a null text is empty; a null source is the part ''; a null doc_id has no smaller one, is
smaller than none and has no label; rows that repeat doc_id and text aren't copies of each other, but count each;
of several labels of a doc_id one that says 1 is enough; an empty table has no parts; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, permutations
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the filters, bit by bit.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Limits: words; distinct words and capital letters in a hundred.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Bytes of texts in a task's own chains, and those that a partition should get.
HELD, PARTITION = 32 << 20, 256 << 20
#: Values by which null ids are spread in the join with labels.
SPREAD = 1024
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: str) -> int:
    """The bits of the filters that a text alone fails. bytes.split works on the six ASCII spaces."""
    data = text.encode()
    words = data.split()
    found = len(words) < MIN_WORDS
    found |= (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
    found |= (100 * (len(data) - len(data.translate(None, CAPITALS))) > MAX_CAPITALS * len(text)) << 2
    return int(found) | (len(data.translate(None, SYMBOLS)) < len(data)) << 3


class Chains:
    """For a hash the different texts that have it, with the smallest id and the rows of that id: (part, mask) -> number.
    ``add`` gives the rows that turn out to be copies."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.held = 0

    def add(self, hashed: int, text: bytes, doc_id: int, row: tuple[str, int], n: int) -> list[tuple]:
        chain = self.of.setdefault(hashed, [])
        for link in chain:
            if link[0] == text:
                break
        else:
            chain.append([text, doc_id, {row: n}])
            self.held += len(text) + 200
            return []
        if doc_id > link[1]:
            return [(doc_id, row, n)]
        copies = []
        if doc_id < link[1]:
            copies = [(link[1], r, k) for r, k in link[2].items()]
            link[1], link[2] = doc_id, {}
        link[2][row] = link[2].get(row, 0) + n
        return copies

    def rest(self) -> Iterator[tuple]:
        """hash, text, id, row and number of what is the smallest of its text; the chains are empty then."""
        of, self.of, self.held = self.of, {}, 0
        for hashed, chain in of.items():
            for text, doc_id, rows in chain:
                for row, n in rows.items():
                    yield hashed, text, doc_id, row, n


def _decided(doc_id: int | None, part: str, mask: int, n: int, place: int) -> tuple:
    """A row that needs no more comparing: it travels without a text, dealt by its id or place."""
    return xxhash.xxh64_intdigest(f"{doc_id} {place}"), (None, doc_id, part, mask, n)


def _own_chains(rows: Iterator) -> Iterator[tuple]:
    chains = Chains()

    def flushed() -> Iterator[tuple]:
        for hashed, text, doc_id, (part, mask), n in chains.rest():
            yield hashed, (text, doc_id, part, mask, n)

    for place, (doc_id, part, text) in enumerate(rows):
        row = part, text_mask(text)
        if doc_id is None:
            yield _decided(None, *row, 1, place)
            continue
        data = text.encode()
        for i, (p, mask), n in chains.add(xxhash.xxh64_intdigest(data), data, doc_id, row, 1):
            yield _decided(i, p, mask | COPY, n, place)
        if chains.held > HELD:
            yield from flushed()
    yield from flushed()


def _all_chains(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The rows of a partition, sorted by hash: (doc_id, part, mask, n)."""
    for hashed, same in groupby(rows, itemgetter(0)):
        chains = Chains()
        for _, (text, doc_id, part, mask, n) in same:
            if text is None:
                yield doc_id, part, mask, n
                continue
            for i, (p, m), k in chains.add(hashed, text, doc_id, (part, mask), n):
                yield i, p, m | COPY, k
        for _, _, doc_id, (part, mask), n in chains.rest():
            yield doc_id, part, mask, n


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and n: what the documents fail; n rows with equal values may come as one row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")), text)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    routed = rows.rdd.mapPartitions(_own_chains).repartitionAndSortWithinPartitions(n, lambda hashed: hashed)
    return spark.createDataFrame(routed.mapPartitions(_all_chains), "doc_id long, part string, mask int, n long")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` of ``masks`` with good and toxic. Null ids, which meet nothing, are spread over partitions."""
    one = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("spread", F.lit(0))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("part", "mask", F.monotonically_increasing_id()), F.lit(SPREAD))).otherwise(0).cast("int")
    return rows.withColumn("spread", spread).join(one, ["doc_id", "spread"], "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def count_vectors(rows: DataFrame):
    """An RDD of (part, counts): counts[0] by mask, [1] of the good, [2] of the toxic."""
    width = 1 << len(FILTERS)

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[0, mask] += n
        counts[1, mask] += n * good
        counts[2, mask] += n * toxic
        return counts

    keyed = rows.select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r[0], tuple(r[1:])))
    return keyed.combineByKey(lambda row: add(np.zeros((3, width), np.int64), row), add, lambda a, b: a + b)


def report(counts: np.ndarray) -> list[tuple]:
    """filter_order, step and the numbers of RESULT, from the counts of one part."""
    all_masks = np.arange(counts.shape[1])
    failing = {f: (all_masks >> i & 1).astype(bool) for i, f in enumerate(FILTERS)}
    bits = np.bitwise_count(all_masks)
    orders = list(permutations(FILTERS))
    each, good, toxic = counts
    # a document is removed by each of the k filters that it fails in 1 of k orders
    shapley = {f: int((each * (len(orders) // np.maximum(bits, 1)))[failing[f]].sum()) for f in FILTERS}
    rows = []
    for order in orders:
        left = np.ones(len(all_masks), bool)
        for step, f in enumerate(order, 1):
            removed = failing[f] & left
            left &= ~failing[f]
            now = int(each[removed].sum())
            rows.append(("".join(order), step, int(each[left].sum()), now, int(each[failing[f]].sum()) - now, int(each[failing[f] & (bits == 1)].sum()), int(good[removed].sum()), int(toxic[removed].sum()), shapley[f]))
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    vectors = count_vectors(labelled(masks(docs), labels))
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: [(x[0], *row) for row in report(x[1])]), RESULT)


#: The same from the masks of all rows; copies by a window over whole texts.
AUDIT_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(ws) < {MIN_WORDS})::INTEGER + (100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws))::INTEGER * 2 + (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_CAPITALS} * length(t))::INTEGER * 4
  + regexp_matches(t, '[#$%&*|]')::INTEGER * 8 + coalesce(w.doc_id > least, false)::INTEGER * 16 AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, k::INTEGER AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(k)),
x AS (SELECT part, filter_order, step, s.bit, sum(n) FILTER (mask & (before | s.bit) = 0) AS kept, sum(n) FILTER (mask & s.bit <> 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & s.bit <> 0 AND mask & before <> 0) AS redundant,
  sum(n) FILTER (mask = s.bit) AS unique_fails, sum(good) FILTER (mask & s.bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & s.bit <> 0 AND mask & before = 0) AS toxic_lost FROM g, s GROUP BY part, filter_order, step, s.bit)
SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x
"""
