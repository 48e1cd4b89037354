"""Mixing, URL filters, quality rules, resharding."""

import random
import zlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from specloom.llm import common, mixing, quality_rules, sharding, url_filters

from .helpers import awkward, documents, rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share_of = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share_of[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | share_of
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rows = awkward()
    out = mixing.mix(documents(spark, rows), block_words=64).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    sizes, source_of = defaultdict(int), {}
    for i, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    by_size = defaultdict(list)
    for i, t, s in rows:
        by_size[i, len(WORDS.findall(t or ""))].append(s)
    want, taken = targets_by_hand(sizes), defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        (s,) = {s for s in by_size[r.doc_id, r.size] if sizes[s] == r.source_size}
        assert r.target == pytest.approx(want[s])
        taken[s] += r.taken
    # the schedule alone decides: a source is a few blocks off its target at most
    assert {s: taken[s] for s in want} == {s: pytest.approx(t, abs=3 * 64) for s, t in want.items()}
    fine = Counter()
    for r in mixing.mix(documents(spark, rows)).collect():
        (s,) = {s for s in by_size[r.doc_id, r.size] if sizes[s] == r.source_size}
        fine[s] += r.taken
    assert {s: fine[s] for s in want} == {s: pytest.approx(t, abs=6) for s, t in want.items()}
    assert rows_of(mixing.mix(documents(spark, rows[::-1]), block_words=64)) == sorted((tuple(r) for r in out), key=str)


def van_der_corput(slot):
    """The sixteen low bits of the slot, mirrored."""
    return sum((F.shiftright(slot, i).bitwiseAND(1) * 0.5 ** (i + 1) for i in range(1, 16)), slot.bitwiseAND(1) * 0.5)


@pytest.mark.parametrize("points", [mixing.golden_points, van_der_corput])
def test_schedule_prefixes_keep_the_weights(spark, points):
    sources = spark.createDataFrame([("0a", 5000.0), ("0b", 2000.0), ("0c", 1000.0)], "skey string, target double")
    slots = sorted(mixing.schedule(sources, 800, 3, points).collect(), key=lambda r: r.slot)
    assert [r.slot for r in slots] == list(range(800))
    for s, share in (("0a", 5 / 8), ("0b", 2 / 8), ("0c", 1 / 8)):
        own = [r for r in slots if r.skey == s]
        assert [r.block for r in own] == list(range(len(own)))
        for n in (50, 200, 400, 800):
            assert abs(sum(r.slot < n for r in own) - n * share) < 4


def test_points_decide_what_is_taken(spark):
    """Slots by hand: other points take other words, and the documents of the mix follow the slots."""
    docs = documents(spark, [(i, f"w{i} " * (i % 7 + 3), f"s{i % 3}") for i in range(60)])
    taken = {}
    for name, points in (("golden", mixing.golden_points), ("corput", van_der_corput), ("low", lambda slot: slot * 0.0)):
        taken[name] = {r.doc_id: r.taken for r in mixing.mix(docs, block_words=8, points=points).collect()}
    assert taken["golden"] != taken["corput"]
    assert {i % 3 for i, n in taken["low"].items() if n} == {0}
    only = mixing.mixed_documents(docs, block_words=8, points=lambda slot: slot * 0.0)
    assert {r.source for r in only.collect()} == {"s0"}
    times = Counter(r.doc_id for r in mixing.mixed_documents(docs, block_words=1).collect())
    exact = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs, block_words=1).collect()}
    assert all(abs(times[i] - t / n) < 1 for i, (t, n) in exact.items())


def test_second_pass_is_shuffled_anew(spark):
    """All of a source is taken once, half of it twice: not the half that the first pass begins with."""
    docs = documents(spark, [(i, "w " * 10, "s") for i in range(100)])
    out = {r.doc_id: r for r in mixing.mix(docs, block_words=10).collect()}
    first = sorted(out, key=lambda i: out[i].first_slot)
    twice = {i for i, r in out.items() if r.taken == 20}
    assert sum(r.taken for r in out.values()) == 1500 and len(twice) == 50 and twice != set(first[:50])


def test_mixed_documents_keep_columns_and_skip_wordless(spark):
    docs = documents(spark, awkward())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert all(WORDS.search(r.text) for r in out.collect())
    assert mixing.mixed_documents(documents(spark, [])).count() == 0 == mixing.mix(documents(spark, [])).count()


def ledger_by_hand(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def test_quality_ledger(spark):
    rows = awkward() + [(60, "a b c a b c\na b\n\na b", "s0"), (61, "x" * 10 + " # $%&|<>*", "s1"), (62, "go go go go go", "s1"), (63, "a\n\n\na\r\na", "s2")]
    got = sorted(tuple(r) for r in quality_rules.judge(documents(spark, [r for r in rows if r[0]])).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted((i, *ledger_by_hand(t)) for i, t, _ in rows if i)
    judged = quality_rules.judge(documents(spark, rows)).collect()
    for r in judged:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.failed & quality_rules.POLICIES["v2"] == 0) and not (r.kept and r.base_failed)
    assert quality_rules.judge(documents(spark, [])).count() == 0


def test_ablations_count_bits(spark):
    rows = [(i, "# " * (i % 3 * 40) + "w%d " % i * (i % 2 * 60), "s") for i in range(20)]
    ledger = quality_rules.ledger(documents(spark, rows)).cache()
    masks = [r.failed & quality_rules.POLICIES["v2"] for r in ledger.collect()]
    for r in quality_rules.ablations(ledger).collect():
        assert (r.n_failed, r.n_only_this) == (sum(m >> r.bit & 1 for m in masks), sum(m == 1 << r.bit for m in masks))


URLS = [
    None, "", "no scheme/path", "http://", "http://Host.EXAMPLE.com", "HTTP://a.example.net/en/x?y#z", "https://example.net", "https://example.net/", "https://x.net/EN/1", "ftp://example.com/de/", "https://sub.example.com/de/7?q=/fr/",
    "https://notexample.com/de/1", "https://a.org/fr/9", "https://a.org#/fr/", "https://a.org/fr", "a://b://c/d", "https://casino.example.org/en/1", "https://casino.example.org/en/2", "http://h.io/" + "deep/" * 300, "http://h.io/a\nb?c",
]


def test_url_rules_and_parts(spark):
    out = {r.page_id: r for r in url_filters.judge(spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")).collect()}
    assert len(out) == len(URLS)
    for i, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        rule = max((r for _, r in url_filters.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), key=len, default=None)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        if rule:
            assert out[i].verdict == dict((r, v) for v, r in url_filters.RULES)[rule]
    assert out[16].verdict == "block"
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_one_host_has_kept_and_rejected_templates(spark):
    """No rule fits the rows asked about: on a mixed host one template goes by its labelled neighbours."""
    urls = [f"https://mixed.example.com/{p}/{i}" for i in range(40) for p in ("news", "promo")]
    urls += [f"https://other.example.com/{p}/{i}" for i in range(40) for p in ("news", "promo")]
    urls += [f"https://new.example.com/{p}/{i}" for i in range(3) for p in ("news", "promo")] + [f"https://downloads-alphabets.org/a/{i}" for i in range(5)] + ["https://free-bets.org/a/1"]
    rules = (("block", "mixed.example.com/promo/"), ("block", "other.example.com/promo/"), ("allow", "other.example.com/news/"))
    out = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    open_ = {(r.host, r.path.split("/")[1]): r.verdict for r in out if r.rule is None}
    assert open_ == {("mixed.example.com", "news"): "allow", ("new.example.com", "news"): "allow", ("new.example.com", "promo"): "block", ("downloads-alphabets.org", "a"): "allow", ("free-bets.org", "a"): "block"}


def test_null_page_ids_are_judged(spark):
    out = url_filters.judge(spark.createDataFrame([(None, "https://a.net/x"), (None, None), (None, None)], "page_id long, url string")).collect()
    assert Counter((r.page_id, r.host, r.verdict) for r in out) == {(None, "a.net", "block"): 1, (None, "", "allow"): 2}


def test_url_templates_agree_with_sql(spark):
    rng = random.Random(2)
    rows = [(i, f"https://{rng.choice(['a', 'bets', 'c'])}{rng.randint(0, 3)}.example.{rng.choice(['com', 'org'])}/{rng.choice(['en', 'fr', 'x'])}/{rng.choice(['news', 'tag', str(rng.randint(0, 99)), 'deadbeef01'])}/{rng.randint(0, 9)}.html") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    c = duckdb.connect()
    c.register("pages", pages.toPandas())
    cols = ["page_id", "host", "path", "rule", "verdict", "template"]
    got = url_filters.judge(pages).select(*cols)
    assert rows_of(got) == sorted((tuple(r) for r in c.execute(f"SELECT {', '.join(cols)} FROM ({url_filters.JUDGE_SQL})").fetchall()), key=str)
    assert any("*" in r.template for r in got.collect())


def test_flow_moves_the_fewest_bytes():
    flow = sharding.min_cost_flow([70, 10, 40], [40, 40, 40], [[int(i != j) for j in range(3)] for i in range(3)])
    assert [sum(r) for r in flow] == [70, 10, 40] and [sum(c) for c in zip(*flow)] == [40, 40, 40]
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 30
    # a dearer link is avoided, by a detour that frees a nearer place
    flow = sharding.min_cost_flow([10, 10], [10, 10], [[1, 2], [1, 9]])
    assert flow == [[0, 10], [10, 0]]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], [[0]])


def test_reshard(spark):
    rng = random.Random(1)
    rows = awkward() + [(100 + i, "w" * rng.randint(1, 400), "s") for i in range(3000)] + [(5000 + i, "the same text " * 9, "s") for i in range(900)]
    out = sharding.reshard(documents(spark, rows), shards=8, old_shards=8).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert set(by) <= set(range(8)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    loads = [sum(r.size for r in by[s]) for s in range(8)]
    # two rows are larger than an eighth each: they stand alone, and the rest is level
    alone = [s for s in range(8) if any(r.size > sum(loads) / 8 for r in by[s])]
    others = [loads[s] for s in range(8) if s not in alone]
    assert len(alone) == 2 == sum(len(by[s]) for s in alone) and max(others) - min(others) < 1000
    assert {r.doc_id: r.size for r in out}[40] == 16 and {r.doc_id: r.text_crc32 for r in out}[40] == 0
    assert sharding.reshard(documents(spark, [])).count() == 0


def test_rewrite_affected_leaves_other_shards(spark, tmp_path):
    rows = [(i, "w" * (i % 50), "s") for i in range(400)]
    docs = documents(spark, rows)
    plan = sharding.reshard(docs, shards=4, old_shards=4)
    written = sharding.rewrite_affected(docs, plan, f"file://{tmp_path}/out").collect()
    affected = {s for r in plan.collect() if r.shard != r.old_shard for s in (r.shard, r.old_shard)}
    assert {r.shard for r in written} == affected
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == sum(r.rows for r in written)


def test_rewrite_affected_beside_shards_already_there(spark, tmp_path):
    """Shards 0 to 3 lie there; 0 loses a row to 1, 2 loses all of its rows, 3 keeps its own."""
    rows = [(1, "a", 0, 0), (1, "b", 0, 1), (1, "b", 1, 1), (None, "c", 1, 1), (None, None, 0, 0), (5, "d", 2, 1), (6, "e", 3, 3)]
    docs = documents(spark, [(i, t, "s") for i, t, _, _ in rows])
    path = f"file://{tmp_path}/out"
    docs.join(spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2), ("e", 3)], "text string, shard int"), "text").withColumn("slot", F.lit(0).cast("long")).select(*docs.columns, "slot", "shard").write.partitionBy("shard").parquet(path)
    before = {f.name for f in (tmp_path / "out" / "shard=3").iterdir()}
    plan = [(i, 16 + len(t or ""), zlib.crc32((t or "").encode()), new, k, old) for k, (i, t, old, new) in enumerate(rows)]
    plan = spark.createDataFrame(plan, "doc_id long, size long, text_crc32 long, shard int, slot long, old_shard int")
    assert {(r.shard, r.rows) for r in sharding.rewrite_affected(docs, plan, path).collect()} == {(0, 2), (1, 4)}
    out = Counter((r.doc_id, r.text, r.shard) for r in spark.read.parquet(path).collect())
    assert out == Counter((i, t, new) for i, t, _, new in rows)
    assert {f.name for f in (tmp_path / "out" / "shard=3").iterdir()} == before


def test_written_tables_can_be_released(spark):
    kept = common.materialise(spark.range(5), "numbers")
    folder = f"{common.shared_dir(spark)}/specloom/{spark.sparkContext.applicationId}"
    assert kept.count() == 5
    common.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
