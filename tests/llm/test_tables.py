"""Exact dedup, filter audit and centroid clustering against brute force."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import centroids, exact_dedup, filter_audit

from .helpers import awkward, documents, rows_of

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- exact dedup


def owners_by_hand(rows, largest=True):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(LETTERS), []).append(i)
    best = {}
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best[t] = ((max if largest else min)(known) if known else None, len(ids))
    return best


def cased_rows():
    rng = random.Random(3)
    base = awkward(rng)
    rows = base + [(i + 100, t and t.upper() if t and t.isascii() else t, s) for i, t, s in base if i is not None]
    return rows + [(300, "É", "s"), (301, "é", "s"), (302, "ONE", "s"), (303, "One", "s")] + [(400 + k, "the Hot text " * 40, "s") for k in range(500)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_against_brute_force(spark, keep):
    rows = cased_rows()
    docs = documents(spark, rows).repartition(6)
    got = exact_dedup.mark(docs, keep).collect()
    best = owners_by_hand(rows, keep == "largest")
    digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in best.items()}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
    assert all((r.keep_id, r.group_size) == digest[r.text_sha256] for r in got)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(best) and all(r.keep_id == r.doc_id for r in got if r.kept)


def test_exact_dedup_keeps_rows_and_columns(spark):
    rows = cased_rows()
    docs = documents(spark, rows).withColumns({"row": F.lit("r"), "sha": F.lit("s"), "n": F.lit(1), "owner": F.lit(2), "a.b": F.lit(3), "pairs": F.create_map(F.lit("k"), F.lit(1))})
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    texts = [(r.text or "").translate(LETTERS) for r in kept.select("text").collect()]
    assert len(texts) == len(set(texts)) and set(texts) == set(owners_by_hand(rows))
    assert exact_dedup.deduplicated(docs.limit(0)).count() == 0 and exact_dedup.mark(docs.limit(0)).count() == 0


def test_keep_is_checked(spark):
    with pytest.raises(ValueError):
        exact_dedup.owners(documents(spark, []), "first")


def added(trie, keys):
    for i, k in enumerate(keys):
        trie.add(k, 1, i, 1)
    return trie


def test_trie_holds_every_string():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    keys += [b"x" * n for n in range(2000)]  # each a prefix of the next: no recursion
    t = added(exact_dedup.Trie(True), keys)
    found = {k: (rows, owner, ties) for k, rows, owner, ties in t.terminals(t.root)}
    assert found == {k: (keys.count(k), len(keys) - 1 - keys[::-1].index(k), 1) for k in set(keys)}
    weight = t.weight(t.root)
    assert t.size == weight - exact_dedup.NODE  # all but the root is counted


def test_trie_spills_subtrees_and_closes_what_is_final(monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUDGET", 4000)
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    trie, out = exact_dedup.Trie(False), []
    for i, k in enumerate(keys):
        trie.add(k, 1, i, 1)
        if trie.size > exact_dedup.BUDGET:
            out += trie.spill()
            assert trie.size <= 2000 and trie.size == trie.weight(trie.root) - exact_dedup.NODE
    out += trie.terminals(trie.root)
    assert sum(rows for _, rows, _, _ in out) == 400 and {k for k, *_ in out} == set(keys)
    trie, out = exact_dedup.Trie(False), []
    for k in sorted(keys * 3):
        trie.add(k, 1, None, 1)
        if trie.size > exact_dedup.BUDGET:
            out += trie.closed(k)
    out += trie.terminals(trie.root)
    assert sorted(k for k, *_ in out) == sorted(set(keys)) and all(rows == 3 * keys.count(k) for k, rows, _, _ in out)


def test_small_budgets_change_nothing(spark, monkeypatch):
    want = rows_of(exact_dedup.mark(documents(spark, cased_rows())))
    for name, value in (("BUDGET", 2000), ("OUT", 1000), ("CROWDED", 3), ("SALTS", 2)):
        monkeypatch.setattr(exact_dedup, name, value)
    assert rows_of(exact_dedup.mark(documents(spark, cased_rows()).repartition(5))) == want


def test_crowded_texts_leave_one_row_a_task(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(8)
    entries = exact_dedup._read(docs, True)
    assert entries.where("text = cast('hot' AS binary)").count() <= 8
    assert exact_dedup.mark(docs).where("group_size = 10000").count() == 10_000


# -- filter audit


def audit_by_hand(rows, labels):
    """{(part, order, step): numbers} by going through every order document by document."""
    texts, least = [(r[1] or "") for r in rows], {}
    for (i, _, _), t in zip(rows, texts):
        if i is not None:
            least[t] = min(least.get(t, i), i)
    fails = []
    for (i, _, _), t in zip(rows, texts):
        words = t.encode().split()
        f = set()
        f |= {"A"} if len(words) < 200 else set()
        f |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        f |= {"E"} if i is not None and i > least[t] else set()
        fails.append(f)
    good = [any(q == 1 for i, q, _ in labels if i == r[0] and i is not None) for r in rows]
    toxic = [any(x == 1 for i, _, x in labels if i == r[0] and i is not None) for r in rows]
    out, shapley = {}, {}
    for part in {r[2] or "" for r in rows}:
        docs = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = set(docs)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in fails[k]}
                left -= gone
                failing = {k for k in docs if f in fails[k]}
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(fails[k] == {f} for k in docs), sum(good[k] for k in gone), sum(toxic[k] for k in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(8)
    words = ["alpha", "Beta", "GAMMA", "d#lta", "eps", "ζ", "η"]
    rows = [(k, " ".join(rng.choice(words[: rng.randint(1, 7)]) for _ in range(rng.choice([3, 199, 200, 260]))), rng.choice(["a", "b", None, ""])) for k in range(40)]
    rows += [(100 + k, rows[k % 7][1], "a") for k in range(60)] + [(-5, rows[0][1], "b"), (-5, rows[0][1], "a"), (-5, rows[0][1], "a")]
    return rows + awkward(rng)


def test_audit_against_brute_force(spark, monkeypatch):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 160)] + [(3, 0, 1), (None, 1, 1), (7, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audit_by_hand(rows, labels)
    for held in (1 << 25, 500):
        monkeypatch.setattr(filter_audit, "HELD", held)
        got = filter_audit.audit(documents(spark, rows).repartition(5), table).collect()
        assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, []), none).count() == 0
    one = filter_audit.audit(documents(spark, [(1, "a", "s")]), none).collect()
    assert len(one) == 600 and {r.shapley for r in one if r.filter_order[r.step - 1] == "A"} == {120}


def test_chains_tell_texts_of_one_hash_apart():
    rows = [(7, (b"one", 3, "s", 0, 1)), (7, (b"two", 2, "s", 0, 1)), (7, (b"one", 1, "s", 1, 2)), (7, (b"two", 2, "s", 0, 1)), (7, (None, 9, "s", 16, 1))]
    assert sorted(filter_audit._all_chains(iter(rows))) == [(1, "s", 1, 2), (2, "s", 0, 2), (3, "s", 16, 1), (9, "s", 16, 1)]


def test_hot_texts_travel_once_a_task():
    rows = [(k, "s", "hot " * 300) for k in range(1000)]
    out = list(filter_audit._own_chains(iter(rows)))
    assert sum(v[0] is not None for _, v in out) == 1 and sum(v[4] for _, v in out) == 1000


# -- centroid clustering


def lloyd_by_hand(rows, k, rounds):
    """Every round over all vectors, in Python's whole numbers."""
    q = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    q = [(i, [min(max(x, -(1 << 26)), 1 << 26) for x in v]) for i, v in q]
    order = sorted(q, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c)) for _, v in q]

    for _ in range(rounds):
        at = assigned()
        for n in range(len(c)):
            mine = [v for (_, v), (_, m) in zip(q, at) if m == n]
            if mine:
                c[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, n, d, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(q, assigned())]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, q string, owner string")


@pytest.mark.parametrize("case", ["clusters", "ties", "large", "few"])
def test_delta_lloyd_against_plain_rounds(spark, case):
    rng = np.random.default_rng(4)
    if case == "clusters":
        centre = rng.normal(0, 2, (20, 64))
        rows = [(i, (centre[i % 20 if i % 3 else 0] + rng.normal(0, 0.5, 64)).astype("f4").tolist()) for i in range(240)]
    elif case == "ties":
        rows = [(i, [float(i % 4) / 64] + [0.0] * 63) for i in range(90)]
    elif case == "large":
        rows = [(i, (rng.normal(0, 1, 64) * 10.0 ** rng.integers(0, 9)).astype("f4").tolist()) for i in range(60)] + [(90, [3e38] * 64), (91, [-3e38] * 64)]
    else:
        rows = [(5, [0.1] * 64), (6, [0.5] * 64), (6, [0.5] * 64), (None, [1.0] * 64)]
    sound = list(rows)
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [None]), (1004, [float("nan")] * 64), (1005, [float("inf")] + [0.0] * 63), (1006, [1.0] * 65), (None, None)]
    want = lloyd_by_hand(rows, 16, 3)
    got = centroids.cluster_report(vectors(spark, rows).repartition(3)).collect()
    assert len(got) == len(sound)
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got))) == sorted(map(str, want))
    inertia = {}
    for _, n, d, _ in want:
        inertia[n] = inertia.get(n, 0) + d
    assert all((r.cluster_inertia, r.inertia) == (min(inertia[r.cluster], 2**63 - 1), min(sum(inertia.values()), 2**63 - 1)) for r in got)


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        out = centroids.cluster_report(vectors(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_only_moved_centroids_are_compared(monkeypatch):
    rng = np.random.default_rng(0)
    q, c = rng.integers(-20, 20, (500, 8)), rng.integers(-20, 20, (6, 8))
    owner, distance = centroids.reassigned(q, np.full(500, -1), np.zeros(500, np.int64), c, np.ones(6, bool))
    new, moved = c.copy(), np.array([False, True, False, False, True, False])
    new[moved] += 3
    seen = []
    plain = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, b: seen.append((len(a), len(b))) or plain(a, b))
    got = centroids.reassigned(q, owner, distance, new, moved)
    assert seen == [(int(moved[owner].sum()), 6), (int((~moved[owner]).sum()), 2)]
    whole = plain(q, new)
    assert (got[0] == whole.argmin(1)).all() and (got[1] == whole.min(1)).all()


def test_transfers_add_up_to_the_new_sums(spark):
    state = spark.createDataFrame([(1, [1, 2], 0, -1, 0), (2, [5, 6], 1, 0, 0), (3, [7, 7], 1, 1, 0), (4, [1, 1], 0, 1, 0)], centroids.STATE)
    got = {(r.cluster, r.part): r.s for r in centroids.transfers(state, 2, 2).groupBy("cluster", "part").agg(F.sum("total").alias("s")).collect()}
    assert {k: v for k, v in got.items() if v} == {(0, 0): 1 - 5 + 1, (0, 1): 2 - 6 + 1, (0, 2): 1, (1, 0): 5 - 1, (1, 1): 6 - 1}
