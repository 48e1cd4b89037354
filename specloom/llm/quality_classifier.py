"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are counted on its bytes, batch by batch in numpy. Trees are grown on the
driver from a bounded sample of labelled rows (``max_rows``, those with the least hash of doc_id):
each statistic is cut into 64 quantile bins, and every split is chosen from histograms of gradients.
The trees are complete binary trees in flat arrays, so a batch is scored by indexing alone, one
level of one tree at a time; the arrays are a few kilobytes and travel with the task.

Labels come from the training fold only: rows whose crc32(doc_id as text) mod 3 is not 1.

Defined cases: a null text is empty, and an empty text has a score like any other; rows with a null
label or doc_id aren't learnt from; repeated labels of a doc_id count once, the lowest; without any
labelled row every score is 0.5; repeated rows score alike; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import bytesops as B
from specloom.llm.common import small_batches, trimmed

FEATURES = ("log_words", "word_bytes", "symbols", "exclamations", "capitals", "digits", "distinct_words", "distinct_trigrams", "same_neighbours", "short_words", "longest_word", "lines", "distinct_lines", "high_bytes", "punctuation")
MAX_ROWS = 20_000
#: LEAF and RIDGE by log loss inside the training fold: learnt on crc32 mod 3 = 0, measured on 2.
TREES, DEPTH, BINS, RATE, LEAF, RIDGE = 60, 4, 64, 0.15, 5, 1.0
_VALUES = B.byte_values(8)
_CLASSES = {"symbols": b"#*$%&|<>", "exclamations": b"!", "capitals": bytes(range(65, 91)), "digits": b"0123456789", "lines": b"\n", "high_bytes": bytes(range(128, 192)), "punctuation": b".,;:?"}


def in_fold(modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is the remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct values of each text."""
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = np.sort(row << np.uint64(43) | hashes >> np.uint64(21))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> np.uint64(43)).astype(np.int64), minlength=len(counts))


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES)."""
    out = np.zeros((len(texts), len(FEATURES)))
    for begin, end in B.pieces(texts):
        data, at = B.utf8(texts.slice(begin, end - begin))
        starts, ends, words = B.word_spans(data, at)
        n, size = np.maximum(words, 1), np.maximum(np.diff(at), 1)
        hashes = B.word_hashes(data, starts, ends, _VALUES)
        lengths, offsets = ends - starts, np.concatenate([[0], np.cumsum(words)])

        def per_text(flags: np.ndarray, places: np.ndarray = offsets) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[places[1:]] - total[places[:-1]]

        of_class = {}
        for name, members in _CLASSES.items():
            table = np.zeros(256, bool)
            table[list(members)] = True
            of_class[name] = per_text(table[data], at)
        trigrams, n3 = B.shingle_hashes(hashes, words, 3)
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[offsets[:-1][words > 0]] = False
        longest = np.zeros(len(words))
        longest[words > 0] = np.maximum.reduceat(lengths, offsets[:-1][words > 0]) if len(lengths) else 0
        line_ends = np.unique(np.concatenate([np.flatnonzero(data == 10), at[1:]]))
        line_starts = np.concatenate([[0], line_ends[:-1] + (data[line_ends[:-1]] == 10)])
        n_lines = np.bincount(np.searchsorted(at[1:], line_ends, "left"), minlength=len(words))
        lines = B.word_hashes(data, line_starts, np.maximum(line_starts, line_ends), _VALUES)
        out[begin:end] = np.stack(
            [
                np.log1p(words), per_text(lengths) / n, of_class["symbols"] / n, of_class["exclamations"] / n, of_class["capitals"] / size, of_class["digits"] / size, _distinct(hashes, words) / n, _distinct(trigrams, n3) / np.maximum(n3, 1),
                per_text(same) / n, per_text(lengths <= 3) / n, longest, of_class["lines"] / n, _distinct(lines, n_lines) / np.maximum(n_lines, 1), of_class["high_bytes"] / size, of_class["punctuation"] / n,
            ], axis=1,
        )
    return out


@dataclass
class Trees:
    """Node k of a tree has the children 2k + 1 and 2k + 2; a value goes right if above the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting on the logistic loss. Deterministic: no rows or statistics are drawn."""
    inner = (1 << DEPTH) - 1
    if not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    margin = np.full(len(y), base)
    features, borders, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, border = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-6)
            local = node - first
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * BINS + binned[:, f]
                G, H, N = (np.bincount(key, w, width * BINS).reshape(width, BINS) for w in (g, h, None))
                GL, HL, NL = (a.cumsum(axis=1)[:, :-1] for a in (G, H, N))
                GT, HT, NT = (a.sum(axis=1, keepdims=True) for a in (G, H, N))
                gain = GL**2 / (HL + RIDGE) + (GT - GL) ** 2 / (HT - HL + RIDGE) - GT**2 / (HT + RIDGE)
                gain[(NL < LEAF) | (NT - NL < LEAF)] = -1
                gain[:, len(c) :] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                won = top > best
                best[won], feature[first : first + width][won], border[first : first + width][won] = top[won], f, c[at[won]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > border[node])
        G, H = (np.bincount(node - inner, w, inner + 1) for w in (g, h))
        leaf = -RATE * G / (H + RIDGE)
        margin += leaf[node - inner]
        features.append(feature)
        borders.append(border)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(borders), np.array(leaves), base)


def sampled_labels(labels: DataFrame, column: str, held_out: Column, max_rows: int) -> DataFrame:
    """doc_id, y: at most ``max_rows`` labels outside the held-out fold, those with the least hash."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    return known.groupBy("doc_id").agg(F.min(column).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    small_batches(docs.sparkSession)
    sample = sampled_labels(labels, "quality", in_fold(3, 1), max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # max_rows bounds what is broadcast; a doc_id's first row by text is the one learnt from
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    got = rows.mapInArrow(trimmed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, y double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    return grow(np.stack(got.x.to_numpy()) if len(got) else np.zeros((0, len(FEATURES))), got.y.to_numpy())


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(statistics(b.column(1))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", in_fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns. No shuffle: texts are scored in
    place and the score is dropped after the filter."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(trees.score(statistics(b.column(b.schema.get_field_index("text")))) >= 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)
