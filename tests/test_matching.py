"""Scores from the inverted index against all pairs, joins that measure their keys, linear text functions."""

import random
import time

from pyspark.sql import functions as F

from specloom import dims, storage
from specloom.functions import text as X
from specloom.operators import joins, matching

SUBJECTS = ["client", "server", "peer", None]
SCHEMA = "doc_id int, req_ord int, level string, text string, subject string, action string, full_context string"


def made(rng, docs=3, reqs=40):
    words = "send sends sender resend end mask masked unmasked client clients server frame 42ab b42 tel tell the été naïve x".split()
    rows = [(d, i, rng.choice(["MUST", "MAY", "SHOULD"]), " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.choice(SUBJECTS), None, rng.choice([None, "", " ".join(rng.choices(words, k=9)) + "."])) for d in range(1, docs + 1) for i in range(1, reqs + 1)]
    said = [(k, rng.randint(1, docs + 1), " ".join(rng.choices([*words, "MUST", "may"], k=rng.randint(0, 7)))) for k in range(30)]
    return rows, [*said, (100, 1, None), (101, None, "client"), (102, 1, " ".join(f"w{i}x" for i in range(200)) + " send")]


def by_hand(spark, rows, said, corpus):
    """(stmt_id, doc_id, req_ord) -> score and keywords of all pairs above zero."""
    about = {r.stmt_id: r for r in matching.analysed(spark.createDataFrame(said, "stmt_id int, doc_id int, statement string")).collect()}
    subject = {(r.doc_id, r.req_ord): r.s for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", "req_ord", F.coalesce(F.lower("subject"), X.subject_of(F.col("text"))).alias("s")).collect()}
    out = {}
    for stmt_id, doc_id, _ in said:
        s = about[stmt_id]
        for d, i, level, text, _, _, context in rows:
            if not corpus and d != doc_id:
                continue
            whole = f"{text} {context or ''}".lower()
            hits = [k for k in s.keywords or [] if k.keyword in whole]
            score = sum(k.weight for k in hits) + 5 * (s.stmt_subject is not None and s.stmt_subject == subject[d, i]) + 3 * (s.stmt_level == level)
            if score:
                out[stmt_id, d, i] = score, [k.keyword for k in hits]
    return out


def test_scores_equal_all_pairs(spark):
    rows, said = made(random.Random(1))
    statements, wanted = spark.createDataFrame(said, "stmt_id int, doc_id int, statement string"), spark.createDataFrame(rows, SCHEMA)
    at = matching.index(wanted)
    for corpus in (False, True):
        want = by_hand(spark, rows, said, corpus)
        got = {(r.stmt_id, r.doc_id, r.req_ord): (r.score, r.matched_keywords) for r in matching.scored(statements, at, corpus=corpus).collect()}
        assert got == want
        best = {}
        for (s, d, i), (score, _) in want.items():
            best.setdefault(s, []).append((-score, d, i))
        best = {(s, *x[1:]) for s, found in best.items() for x in sorted(found)[: dims.TOP_MATCHES]}
        top = matching.scored(statements, at, dims.TOP_MATCHES, corpus)
        assert {(r.stmt_id, r.doc_id, r.req_ord) for r in top.collect()} == best == {(r.stmt_id, r.doc_id, r.req_ord) for r in matching.best_matches(top, corpus=corpus).collect()}


def test_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 7)
    monkeypatch.setattr(matching, "BLOCKS", 2)
    monkeypatch.setattr(joins, "SIDE", 3)
    rows, said = made(random.Random(2), docs=2, reqs=60)
    got = matching.scored(spark.createDataFrame(said, "stmt_id int, doc_id int, statement string"), spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.stmt_id, r.doc_id, r.req_ord): (r.score, r.matched_keywords) for r in got} == by_hand(spark, rows, said, False)


def test_few_words_are_compared(spark):
    """At most a tenth of the keyword tests that all pairs would take."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(300)]
    rows = [(1, i, "MUST", " ".join(rng.choices(words, k=12)), None, None, None) for i in range(300)]
    said = matching.analysed(spark.createDataFrame([(k, 1, " ".join(rng.choices(words, k=6))) for k in range(40)], "stmt_id int, doc_id int, statement string"))
    at = matching.index(spark.createDataFrame(rows, SCHEMA))
    keywords = said.select("doc_id", F.explode("keywords.keyword").alias("keyword"))
    compared = matching.gram_pairs(keywords, at.words, ["doc_id"])
    assert 10 * compared.count() <= keywords.count() * len(rows)
    assert compared.where(F.col("token").contains(F.col("keyword"))).count() >= keywords.distinct().count() * 0.9


def test_empty_tables(spark):
    rows, said = made(random.Random(4))
    none, nobody = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "stmt_id int, doc_id int, statement string")
    statements, wanted = spark.createDataFrame(said, nobody.schema), spark.createDataFrame(rows, SCHEMA)
    assert matching.scored(nobody, wanted).count() == matching.scored(statements, none, 10).count() == matching.conflicts(nobody, none).count() == 0
    assert all(r.n_matches == 0 and r.is_valid for r in matching.validity(statements, none).collect())


def test_sized_join_equals_a_join(spark):
    rng = random.Random(5)
    left = [(rng.choice([0] * 9 + [1, 2, None]), i) for i in range(400)]
    right = [(rng.choice([0] * 5 + [1, 3, None]), i) for i in range(500)]
    one, other = spark.createDataFrame(left, "k int, a int").repartition(3), spark.createDataFrame(right, "k int, b int").repartition(5)
    for side in (1, 16, 10_000):
        got = sorted(map(tuple, joins.sized_join(one, other, ["k"], side).select("k", "a", "b").collect()))
        assert got == sorted((k, a, b) for k, a in left for j, b in right if k == j and k is not None)


def test_a_document_of_many_requirements_is_spread(spark):
    """One document holds 100,000 requirements and nearly all statements: tasks get about the same."""
    wanted = storage.materialise(spark.range(100_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(0).cast("int").alias("doc_id"), F.col("id").cast("int").alias("req_ord"), F.lit("client").alias("s")), "many")
    said = storage.materialise(spark.range(300).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(0).cast("int").alias("doc_id"), F.col("id").alias("stmt_id"), F.lit("client").alias("s")), "said")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for k, v in (("spark.sql.shuffle.partitions", "32"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    try:
        pairs = joins.sized_join(said, wanted, ["doc_id", "s"], 128)
        sizes = sorted(r.n for r in pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    finally:
        for k, v in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"), before):
            spark.conf.set(k, v)
    assert sum(sizes) > 29_000_000 and len(sizes) == 32 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_sums_before(spark):
    rng = random.Random(6)
    arrays = [[rng.randint(0, 99) for _ in range(n)] for n in (0, 1, 31, 32, 33, 64, 65, 1023, 1024, 1025, 5000)]
    got = spark.createDataFrame([(a,) for a in arrays], "a array<int>").select(X.sums_before(F.col("a"))).collect()
    assert [r[0] for r in got] == [[sum(a[:i]) for i in range(len(a))] for a in arrays]


def test_offsets_and_keywords_take_linear_time(spark):
    def seconds(column, text):
        df = spark.createDataFrame([(text,)] * 4, "t string").select(F.size(column).alias("n"))
        best = []
        for _ in range(3):
            began = time.perf_counter()
            n = df.first().n
            best.append(time.perf_counter() - began)
        return min(best), n

    for column, piece in ((X.markers(F.col("t")), "It MUST go on {}. "), (X.keywords(F.col("t")), "word{} again ")):
        short, n = seconds(column, "".join(piece.format(i) for i in range(3000)))
        long, m = seconds(column, "".join(piece.format(i) for i in range(30_000)))
        assert (n, m) in ((3000, 30_000), (3001, 30_001)) and long <= 12 * short


def test_keywords_of_runs(spark):
    text = "zeta Zeta alpha zeta, client! alpha of client 42"
    got = spark.createDataFrame([(text,)], "t string").select(X.keywords(F.col("t")).alias("k")).first().k
    assert [tuple(k) for k in got] == [("zeta", 3), ("alpha", 2), ("client", 6)]
