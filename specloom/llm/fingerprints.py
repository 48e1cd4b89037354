"""One-permutation MinHash fingerprints.

Each shingle of a text is hashed once; the hash's high bits choose one of ``bins`` bins and each
bin keeps its smallest hash. Empty bins copy a filled one, chosen by optimal densification: a fixed
random order of the other bins for each bin, of which the first filled one is taken. Of each bin
the low-order byte is kept, as two hexadecimal digits. The share of equal bins estimates the
Jaccard likeness of the shingle sets, after correction for the 1 / 256 of unequal bins whose low
bytes agree by chance.

To compare each document with the next one (by descending doc_id, from the last to the first), the
documents are dealt into ranges of doc_id by sampled quantiles. The largest doc_id of a range is
one of its bounds, so the row that follows a range is known beforehand, and a copy of it is sent
along: one shuffle, and no task holds more than its own ranges.

Defined cases: a null text is empty; a text without words has the empty fingerprint, which is 1
like another empty one and 0 like any else; a text of fewer than five words is one shingle; rows
that share a doc_id follow each other in text order, and a null doc_id comes last; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm import bytesops as B
from specloom.llm.common import small_batches, trimmed

SHINGLE = 5
BINS = 256
_VALUES = B.byte_values(4)
_EMPTY = np.uint64((1 << 64) - 1)


def densification(bins: int) -> np.ndarray:
    """For each bin the other bins in a random order of its own."""
    rng = np.random.default_rng(1804)
    order = rng.permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)
    return order


_ORDER: dict[int, np.ndarray] = {}


def minhash(texts: pa.Array, bins: int = BINS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts, bins) low-order bytes, and which texts have words."""
    out, some = np.zeros((len(texts), bins), np.uint8), np.zeros(len(texts), bool)
    for begin, end in B.pieces(texts):
        data, at = B.utf8(texts.slice(begin, end - begin))
        starts, ends, counts = B.word_spans(data, at)
        hashes, n = B.shingle_hashes(B.word_hashes(data, starts, ends, _VALUES), counts, shingle)
        bits = U(bins.bit_length() - 1)
        least = np.full(len(counts) * bins, _EMPTY)
        np.minimum.at(least, np.repeat(np.arange(len(counts)) * bins, n) + (hashes >> (U(64) - bits)).astype(np.int64), hashes << bits >> bits)
        least = least.reshape(len(counts), bins)
        filled = least != _EMPTY
        order = _ORDER.setdefault(bins, densification(bins))
        row, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
        for t in range(bins):
            if not len(row):
                break
            source = order[bin_, t]
            ok = filled[row, source]
            least[row[ok], bin_[ok]] = least[row[ok], source[ok]]
            row, bin_ = row[~ok], bin_[~ok]
        out[begin:end] = (least & U(255)).astype(np.uint8)
        some[begin:end] = counts > 0
    return out, some


U = np.uint64


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Of fingerprints row by row, corrected for low bytes that agree by chance."""
    chance = 1 / 256
    same = ((a == b).mean(axis=1) - chance) / (1 - chance)
    return np.where(some_a & some_b, np.clip(same, 0, 1), (some_a == some_b).astype(float))


def hexadecimal(prints: np.ndarray, some: np.ndarray) -> list[str]:
    return [p.tobytes().hex() if s else "" for p, s in zip(prints, some)]


def fingerprint(docs: DataFrame, bins: int = BINS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hexadecimal(*minhash(b.column(1), bins, shingle)), pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(trimmed(run), f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, _range, _tail: rows in ranges of doc_id. A range's rows with _tail 1 are copies of
    the rows that come next after it in descending order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8
    found, largest = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], min(100 * n, 100_000)), F.max("doc_id")).first()
    bounds = sorted({*(found or []), *([] if largest is None else [largest])})  # all of them are doc_ids

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for b in batches:
            ids = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            home = np.minimum(np.searchsorted(edges, ids), max(len(edges) - 1, 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(np.zeros(len(ids)), pa.int32())], names=["doc_id", "text", "_range", "_tail"])
            edge = np.flatnonzero(edges[home] == ids) if len(edges) else np.flatnonzero(np.ones(len(ids)))
            copies = b.take(pa.array(edge))
            to = (home[edge] + 1) % max(len(edges), 1)  # descending: the range above is followed by this row
            yield pa.RecordBatch.from_arrays([*copies.columns, pa.array(to, pa.int32()), pa.array(np.ones(len(edge)), pa.int32())], names=["doc_id", "text", "_range", "_tail"])

    return rows.mapInArrow(trimmed(deal), "doc_id long, text string, _range int, _tail int")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    small_batches(docs.sparkSession)

    def results(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following)]
        # a text's fingerprint is that of the row before it, but for the first
        own, some = minhash(pa.array([*texts, following[-1]], pa.large_string()))
        if any(a is not b for a, b in zip(following[:-1], texts[1:])):  # a range ended
            other, other_some = minhash(pa.array(following, pa.large_string()))
        else:
            other, other_some = own[1:], some[1:]
        own, some = own[:-1], some[:-1]
        new, new_some = minhash(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array(hexadecimal(own, some), pa.string()),
                pa.array(hexadecimal(new, new_some), pa.string()), pa.array(likeness(own, some, new, new_some)), pa.array(likeness(own, some, other, other_some)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row: what follows it is in the next batch
        ids: list = []
        texts: list[str] = []
        following: list[str] = []
        size = 0
        for b in batches:
            for doc_id, text, home, tail in zip(*(c.to_pylist() for c in b.columns)):
                if waiting is not None and waiting[2] == home:
                    ids.append(waiting[0])
                    texts.append(waiting[1])
                    following.append(text)
                    size += len(text)
                    if size > B.PIECE:
                        yield results(ids, texts, following)
                        ids, texts, following, size = [], [], [], 0
                waiting = None if tail else (doc_id, text, home)
        if ids:
            yield results(ids, texts, following)

    dealt = with_next(docs).repartition("_range").sortWithinPartitions("_range", "_tail", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(trimmed(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
