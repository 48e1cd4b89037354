"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased; their features are single words, pairs of
neighbours and pairs with one word between, hashed into 2 ** BITS places, each present or not. The
learner is FTRL-proximal: a rate for each coordinate and L1, which leaves most weights at zero. What
is left is sent to the tasks as two short sorted arrays; a document's score needs its features with
a weight only.

Learning takes a bounded sample of labelled rows from the training fold (rows whose crc32(doc_id as text)
mod 4 is not 2): those with the least hash of doc_id, ``max_rows`` at most and so many that their texts
have ``max_bytes`` bytes at most.

Defined cases: a null text is empty and scores as the bias alone; rows with a null label or doc_id
aren't learnt from; a text is learnt from and scored by all its features, however many, but one of over a 16th
of ``max_bytes`` isn't learnt from; repeated labels of a doc_id count once, the lowest; without labelled rows every
score is 0.5; repeated rows score alike; an empty table gives an empty result; only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm import bytesops as B
from specloom.llm.common import small_batches, trimmed
from specloom.llm.quality_classifier import in_fold, sampled_labels

BITS = 20
MAX_ROWS = 6_000
#: Bytes of the texts that are learnt from, together: bounds what the driver gets (three features a word, four bytes each).
MAX_BYTES = 64 << 20
#: Chosen by log loss inside the training fold: learnt on crc32 mod 4 in (0, 1), measured on 3.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 12.0, 1.0, 5
_VALUES = B.byte_values(9)
#: Bytes that end a word: all of ASCII but letters and digits.
_BETWEEN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, row of each feature from there, feature), for pieces of the texts."""
    for begin, end in B.pieces(texts):
        data, at = B.utf8(texts.slice(begin, end - begin))
        starts, ends, words = B.word_spans(data, at, _BETWEEN)
        one = B.word_hashes(data, starts, ends, _VALUES, lower=True)
        row = np.repeat(np.arange(len(words)), words)
        rows, out = [row], [one]
        for gap in (1, 2):
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            out.append(B.mixed(one[:-gap][same] * np.uint64(2 * gap + 1) + one[gap:][same]))
        yield begin, np.concatenate(rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Weights:
    place: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.place] = self.weight
        margin = np.full(len(texts), self.bias)
        for begin, rows, found in features(texts):
            some = table[found] != 0
            pairs = np.unique((rows[some] << BITS) | found[some])
            margin += np.bincount((pairs >> BITS) + begin, table[pairs & ((1 << BITS) - 1)], len(texts))
        return 1 / (1 + np.exp(-margin))


def ftrl(rows: list[np.ndarray], y: np.ndarray) -> Weights:
    """The rows' features, each once, in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(EPOCHS if len(y) else 0):
        for idx, label in zip(rows, y):
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            bias = -zb / ((BETA + nb**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[idx] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += g * g
    place = np.flatnonzero(np.abs(z) > L1)
    weight = (np.sign(z[place]) * L1 - z[place]) / ((BETA + np.sqrt(n[place])) / ALPHA + L2)
    return Weights(place, weight.astype(np.float32), -zb / ((BETA + nb**0.5) / ALPHA))


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """doc_id, y of the rows to learn from. One task gets max_rows sizes of texts, and no texts."""
    rows = sampled_labels(labels, "toxic", in_fold(4, 2), max_rows)
    size = F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")
    sizes = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(size)
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    return sizes.where(F.col("size") <= max_bytes // 16).withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).select("doc_id", "y")


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Weights:
    small_batches(docs.sparkSession)
    sample = sampled(docs, labels, max_rows, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: list = [[] for _ in range(b.num_rows)]
            for begin, rows, found in features(b.column(2)):
                pairs = np.unique((rows << BITS) | found)
                cuts = np.searchsorted(pairs >> BITS, np.arange(int(pairs[-1] >> BITS) + 2)) if len(pairs) else [0]
                for i, (a, c) in enumerate(zip(cuts, cuts[1:])):
                    own[begin + i] = (pairs[a:c] & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "y", "x"])

    # max_rows bounds what is broadcast; a doc_id's first row by features is the one learnt from
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    seen = rows.mapInArrow(trimmed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, y double, x array<int>")
    got = seen.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    order = np.random.default_rng(1).permutation(len(got))
    return ftrl([np.asarray(got.x.iloc[i], np.int64) for i in order], got.y.to_numpy()[order])


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights.score(b.column(1)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", in_fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
