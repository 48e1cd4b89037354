"""Best matches from blocks and slices, and what joins broadcast."""

import random

from pyspark.sql import functions as F

from specloom import dims, storage
from specloom.operators import joins, matching
from tests.test_matching import SCHEMA, by_hand, made

SAID = "stmt_id int, doc_id int, statement string"


def best_by_hand(want):
    best = {}
    for (s, d, i), (score, found) in want.items():
        best.setdefault(s, []).append((-score, d, i, found))
    return {(s, d, i): (-score, found) for s, rows in best.items() for score, d, i, found in sorted(rows)[: dims.TOP_MATCHES]}


def test_slices_and_chunks_of_the_corpus(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("SLICE", 20), ("CHUNK", 5)):
        monkeypatch.setattr(matching, name, value)
    rows, said = made(random.Random(8), docs=4, reqs=30)
    said += [(200 + k, d, s) for k, (_, d, s) in enumerate(said)]  # each twice
    statements = spark.createDataFrame(said, SAID)
    got = {(r.stmt_id, r.doc_id, r.req_ord): (r.score, r.matched_keywords) for r in matching.scored(statements, spark.createDataFrame(rows, SCHEMA), dims.TOP_MATCHES, True).collect()}
    assert got == best_by_hand(by_hand(spark, rows, said, True))
    assert matching.scored(statements, spark.createDataFrame([], SCHEMA), 10, True).count() == matching.scored(statements.limit(0), spark.createDataFrame(rows, SCHEMA), 10, True).count() == 0


def test_blocks_parts_and_masks(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("SIDE", 3), ("BITS", 5)):
        monkeypatch.setattr(matching, name, value)
    rows, said = made(random.Random(9), docs=2, reqs=60)
    found = matching.ranked(storage.written(matching.analysed(spark.createDataFrame(said, SAID)), "said"), matching.index(spark.createDataFrame(rows, SCHEMA)), dims.TOP_MATCHES)
    got = {(r.stmt_id, r.doc_id, r.req_ord): (r.score, r.matched_keywords) for r in found.collect()}
    assert got == best_by_hand(by_hand(spark, rows, said, False))


def test_validity_counts_the_best(spark):
    rows, said = made(random.Random(10))
    want = best_by_hand(by_hand(spark, rows, said, False))
    got = {r.stmt_id: r.n_matches for r in matching.validity(spark.createDataFrame(said, SAID), spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {s: sum(k[0] == s for k in want) for s, _, _ in said}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_of_large_rows_are_not_broadcast(spark):
    long = storage.materialise(spark.range(2000).select("id", F.repeat(F.lit("the same words "), 500).alias("t")), "long")
    with storage.measured_broadcasts(spark):
        assert "Broadcast" not in _plan(spark.range(5000).join(long, "id"))
    assert "Broadcast" in _plan(spark.range(5000).join(long, "id"))
    halves = joins.sized_join(spark.range(5000), long, ["id"])
    assert _plan(halves).split("AdaptiveSparkPlan")[1].lstrip().splitlines()[1].count("Broadcast") == 0 and "SortMergeJoin" in _plan(halves)
