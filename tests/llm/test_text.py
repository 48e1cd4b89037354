"""Suffix dedup, fingerprints, SimHash, classifiers, SentencePiece."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import sentencepiece
import xxhash

from specloom.llm import fingerprints, quality_classifier, sentencepiece_scan, simhash, suffix_dedup, toxicity

from .helpers import awkward, documents, words


def removals_by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        keep = np.ones(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                keep[i : i + length] = False
        gone = np.concatenate([[False], ~keep])
        left = np.frombuffer(b, np.uint8)[keep].tobytes()
        out.append((len(b), int((~keep).sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return out


def repetitive(rng, n=40):
    passage, periodic = words(rng, 30), "ab" * 150
    texts = []
    for i in range(n):
        parts = [words(rng, rng.randint(0, 40)), passage[rng.randint(0, 20) : rng.randint(60, 180)], periodic[: rng.randint(0, 300)], words(rng, rng.randint(0, 9)), passage if rng.random() < 0.3 else ""]
        rng.shuffle(parts)
        texts.append("".join(parts))
    return texts + texts[:3]


@pytest.mark.parametrize("hot", [1 << 20, 1000, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot):
    """Also where anchors with more bytes are cut by finer keys, down to single windows."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [*repetitive(random.Random(3)), None, "", "é" * 100]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    ranges = {r.s1: r.ranges for r in suffix_dedup.repeated_ranges(docs, suffix_dedup.keyed_rows(docs), 60, 16).collect()}
    for i, want in enumerate(removals_by_hand(texts, 60)):
        data = np.frombuffer((texts[i] or "").encode(), np.uint8)
        left, spans, gone = suffix_dedup._kept(data, ranges.get(i))
        assert (len(data), gone, spans, hashlib.sha256(left).hexdigest()) == want


def passages_by_hand(texts, n):
    """Bytes that windows of n words cover which also start elsewhere."""
    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    windows = [[(w[i][0], w[i + n - 1][1]) for i in range(len(w) - n + 1)] for w in found]
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[x:y] for b, w in zip(data, windows) for x, y in w)
    return [{k for x, y in w if seen[b[x:y]] > 1 for k in range(x, y)} for b, w in zip(data, windows)]


@pytest.mark.parametrize("hot", [1 << 20, 2])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    rng = random.Random(13)
    shared = [words(rng, 20).split() for _ in range(3)] + [["ab"] * 30]
    texts = []
    for _ in range(40):
        parts = [words(rng, rng.randint(0, 30)).split(), rng.choice(shared)[: rng.randint(5, 30)], words(rng, rng.randint(0, 5)).split(), rng.choice(shared)]
        rng.shuffle(parts)
        texts.append(rng.choice([" ", "  ", "\n"]).join(w for p in parts for w in p))
    texts += [texts[0], texts[1] + " end", None, "", "x" * 3000 + " " + " ".join(shared[0]), " ".join(words(rng, 1) * 200 for _ in range(12))] + ["many " + " ".join(shared[1]) + f" {i}" for i in range(30)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.s1: {k for x in r.ranges for k in range(x.a, x.b)} for r in suffix_dedup.repeated_ranges(docs, suffix_dedup.keyed_rows(docs), 10, words=True).collect()}
    assert [got.get(i, set()) for i in range(len(texts))] == passages_by_hand(texts, 10)


def test_every_shared_passage_of_51_words_goes(spark):
    """Words of one letter and long ones, inside texts and at their ends; 50 words stay."""
    rng = random.Random(17)
    passages = [[rng.choice("abcdefghij") for _ in range(51)], words(rng, 51).split(), ["".join(rng.choice("xyz") for _ in range(30)) for _ in range(51)], [rng.choice("abcdefghij") for _ in range(50)]]
    texts = [f"{words(rng, rng.randint(0, 40))} {' '.join(p)} {words(rng, rng.randint(0, 40))}" for p in passages for _ in range(3)]
    clean = [words(rng, 150) for _ in range(10)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts + clean)])
    out = {r.doc_id: r.text for r in suffix_dedup.deduplicated(docs, suffix_dedup.PASSAGE, words=True).collect()}
    for i, t in enumerate(texts):
        p = " ".join(passages[i // 3])
        assert (p in out[i]) == (i // 3 == 3)
        if i // 3 < 3:
            assert out[i] == t.replace(p, "")
    assert [out[i + len(texts)] for i in range(10)] == clean
    marked = {r.doc_id: r.n_passages for r in suffix_dedup.removals(docs).collect()}
    assert marked == {i: int(i < 9) for i in range(len(texts) + 10)}


def test_suffix_dedup_awkward_rows(spark):
    rows = awkward()
    rows.append((-(1 << 63), rows[0][1], "s"))
    got = sorted(tuple(r)[:5] for r in suffix_dedup.removals(documents(spark, rows)).fillna(-1, ["doc_id"]).collect())
    assert got == sorted((-1 if i is None else i, *x) for (i, _, _), x in zip(rows, removals_by_hand([t for _, t, _ in rows], 400)))
    assert suffix_dedup.removals(documents(spark, [])).count() == 0


def test_suffix_dedup_keeps_columns_and_cuts_whole_characters(spark):
    rng = random.Random(8)
    shared = "é漢" * 200
    docs = documents(spark, [(1, "aé" + shared + words(rng, 9), "s"), (2, "b漢" + shared, "s"), (3, None, "s"), (4, words(rng, 200), "s")])
    out = {r.doc_id: r for r in suffix_dedup.deduplicated(docs).collect()}
    assert suffix_dedup.deduplicated(docs).columns == docs.columns
    assert len(out[1].text) < 80 and out[1].n_chars == len(out[1].text)
    assert out[3].text is None and len(out[4].text) > 500


def test_long_texts_are_cut_in_overlapping_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 500)
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 3000).astype(np.uint8).tobytes()
    seen = set()
    for _, offset, part, at in suffix_dedup._parts(pa.array([data.decode()]), 60):
        text, a, b, _, _ = suffix_dedup.runs_of(part, at, 60, 16)
        seen |= {offset + i for x, y in zip(a, b) for i in range(x, y + 1)}
    assert seen == set(range(3000 - 60 + 1))


def test_run_length_index_statistics():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 80))) for _ in range(12)] + [b"abc" * 300, b"abc" * 250]
    index = suffix_dedup.RunLengthIndex([np.frombuffer(s, np.uint8) for s in strings])
    stats, text = index.matching_statistics(), index.text
    assert len(index.run_heads) < index.n
    places = [int(p) for begin, s in zip(index.begins, strings) for p in range(begin, begin + len(s))]
    for p in places[::7]:
        best = 0
        for q in range(index.n):
            if q != p:
                n = 0
                while n < suffix_dedup.DEPTH and p + n < len(text) and q + n < len(text) and text[p + n] == text[q + n]:
                    n += 1
                best = max(best, n)
        assert stats[p] == best


def windows_by_hand(strings, counts, length, words):
    """Windows that occur elsewhere: string, begin, end."""
    units = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+" if words else rb"(?s).", s)] for s in strings]
    spans = [[(u[i][0], u[i + length - 1][1]) for i in range(len(u) - length + 1)] for u in units]
    seen = Counter()
    for s, n, own in zip(strings, counts, spans):
        for x, y in own:
            seen[s[x:y]] += n
    return {(i, x, y) for i, (s, own) in enumerate(zip(strings, spans)) for x, y in own if seen[s[x:y]] > 1}


def repeated(strings, counts, length, words):
    found = suffix_dedup.repeated_windows([np.frombuffer(s, np.uint8) for s in strings], counts, length, words)
    return set(zip(*(x.tolist() for x in found)))


def test_strings_that_begin_alike():
    """The middle one of three in order isn't sampled for a change of the byte before it."""
    rng = random.Random(23)
    shared = words(rng, 40).encode()
    strings = [shared[:100] + b"c" + words(rng, 30).encode(), shared[:40] + b"a" + words(rng, 30).encode(), shared[:100] + b"b" + words(rng, 30).encode()]
    assert repeated(strings, [1, 1, 1], 60, False) == windows_by_hand(strings, [1, 1, 1], 60, False) != set()


@pytest.mark.parametrize("by_words", [False, True])
def test_repeated_windows_equal_brute_force(by_words):
    rng = random.Random(29)
    for _ in range(400):
        pool = ["".join(rng.choice("ab  \n" if by_words else "ab") for _ in range(rng.randint(6, 120))) for _ in range(3)]
        cuts = [(rng.choice(pool), rng.randint(0, 5), rng.choice(["", "a", "bab", "ab ba"])) for _ in range(rng.randint(1, 8))]
        strings = list(dict.fromkeys((x[i : rng.randint(i, len(x))] + end).strip().encode() or b"a" for x, i, end in cuts))
        counts, length = [rng.choice([1, 1, 2]) for _ in strings], rng.choice([1, 2, 3, 5, 9, 28])
        assert repeated(strings, counts, length, by_words) == windows_by_hand(strings, counts, length, by_words)


def test_an_index_orders_only_what_can_match(monkeypatch):
    """Passages are indexed by words, not by bytes; suffixes shorter than a window aren't sorted to its end."""
    built = []
    whole = suffix_dedup.RunLengthIndex.__init__
    monkeypatch.setattr(suffix_dedup.RunLengthIndex, "__init__", lambda self, *args: (whole(self, *args), built.append(self))[0])
    rng = random.Random(31)
    shared = words(rng, 60)
    strings = [f"{shared} {words(rng, 60)}".encode() for _ in range(3)]
    for length, by_words in ((51, True), (400, False)):
        assert repeated(strings, [1] * 3, length, by_words) == windows_by_hand(strings, [1] * 3, length, by_words)
    assert built[0].n == 3 * 120
    assert built[1].run_heads.max() < sum(len(s) - 399 for s in strings)


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints_estimate_likeness(spark):
    rng = random.Random(2)
    base = words(rng, 600).split()
    for changed in (0, 10, 40, 200):
        other = list(base)
        for i in rng.sample(range(600), changed):
            other[i] = "changed%d" % i
        a, b = " ".join(base), " ".join(other)
        prints, some = fingerprints.minhash(pa.array([a, b]))
        true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert abs(fingerprints.likeness(prints[:1], some[:1], prints[1:], some[1:])[0] - true) < 0.12


def test_fingerprints_of_next_and_edited(spark):
    rows = [r for r in awkward() if r[0] not in (None, 50)]
    out = {r.doc_id: r for r in fingerprints.compare_with_next(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert set(out) == {r[0] for r in rows}
    for (i, t, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(following)
        if not a or not b:
            assert out[i].near_next == float(not a and not b)
        else:
            assert abs(out[i].near_next - len(a & b) / len(a | b)) < 0.12
    assert out[30].fingerprint == out[31].fingerprint != "" == out[40].fingerprint == out[42].fingerprint


def test_fingerprints_ties_nulls_and_empty_tables(spark):
    rows = awkward()
    out = fingerprints.compare_with_next(documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert fingerprints.compare_with_next(documents(spark, [])).count() == 0
    (alone,) = fingerprints.compare_with_next(documents(spark, [(7, "only one here", "s")])).collect()
    assert (alone.near_next, alone.edited_sha256) == (1.0, hashlib.sha256(b"only on" + b"only o").hexdigest())
    assert fingerprints.fingerprint(documents(spark, rows)).count() == len(rows)


def fp_by_hand(text):
    w = bytes(text or "", "utf8").lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components_by_hand(prints, radius=3):
    prints, root = sorted(set(prints)), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize(("bucket", "radius", "parts"), [(4096, 3, 1), (3, 3, 1), (4096, 7, 2), (3, 9, 2)])
def test_covering_search_loses_no_link(spark, monkeypatch, bucket, radius, parts):
    """Chains at the radius and dense balls, also where all but the smallest buckets are dealt again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        x = rng.choice(prints)
        for i in rng.sample(range(64), rng.choice([1, 2, radius - 1, radius, radius, radius + 1, radius + 2])):
            x ^= 1 << i
        prints.append(x)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in set(prints)], "fp long")
    found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(frame, radius, parts)).collect()}
    want = components_by_hand(prints, radius)
    groups = lambda f: sorted(map(sorted, {frozenset(q for q in want if f(q) == f(p)) for p in want}))
    assert groups(lambda p: found.get(p, p)) == groups(want.get)


def test_masks_cover_and_keep_enough_bits():
    rng = random.Random(1)
    for radius, parts, least in ((simhash.RADIUS, 1, 30), (simhash.WIDE, simhash.PARTS, 16)):
        masks = simhash.covering_masks((1 << 64) - 1, radius, parts)
        assert min(m.bit_count() for m in masks) >= least
        for _ in range(300):
            apart = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(not m & apart for m in masks)


def test_wider_links_are_checked(spark):
    """A copy with a few words changed goes; a text that only looks near by its fingerprint stays."""
    rng = random.Random(11)
    base = words(rng, 400).split()
    rows = [(1, " ".join(base), "s")]
    for i in range(2, 12):
        other = list(base)
        for k in rng.sample(range(400), 3):
            other[k] = f"changed{k}x{i}"
        rows.append((i, " ".join(other), "s"))
    rows += [(i, words(rng, 300), "s") for i in range(20, 40)]
    docs = documents(spark, rows)
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    prints = {i: fp_by_hand(t) for i, t, _ in rows}
    linked = {i for i in range(2, 12) if (prints[i] ^ prints[1]).bit_count() <= simhash.WIDE}
    assert len(linked) >= 5 and kept == {1, *range(20, 40)} | ({*range(2, 12)} & kept) and not linked & kept
    far = {r.doc_id for r in simhash.deduplicated(documents(spark, rows), radius=40, parts=11, similarity=0.8).collect()}
    assert far == {1, *range(20, 40)}


def near_pairs(rng, sizes, apart, wanted):
    """Texts and copies with a few words changed that keep 0.8 of the shingles, so many bits apart."""
    pairs = []
    while len(pairs) < wanted:
        base = words(rng, rng.randint(*sizes)).split()
        other = list(base)
        for k in rng.sample(range(len(base)), max(1, len(base) // 45)):
            other[k] = words(rng, 2).replace(" ", "")
        x, y = " ".join(base), " ".join(other)
        if alike_by_hand(x, y) >= 0.8 and (fp_by_hand(x) ^ fp_by_hand(y)).bit_count() in apart:
            pairs.append((x, y))
    return pairs


def alike_by_hand(x, y):
    one, other = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (x.lower().split(), y.lower().split()))
    return len(one & other) / len(one | other)


def test_copies_ten_and_eleven_bits_apart_go(spark):
    """All pairs of the fixture reach 0.8: 127 words and more, as at sf0.1."""
    pairs = near_pairs(random.Random(7), (127, 248), (10, 11), 12)
    docs = documents(spark, [(2 * i + k, t, "s") for i, p in enumerate(pairs) for k, t in enumerate(p)])
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == {2 * i for i in range(len(pairs))}


def test_unlike_texts_stay_however_near_their_fingerprints(spark):
    """Repeated shingles decide the bits: other words beside them leave equal and near fingerprints."""
    rng = random.Random(5)
    same = " ".join(["alpha beta gamma"] * 200)
    rows = [(i, f"{same} {words(rng, 60)}", "s") for i in range(1, 7)] + [(9, f"  {same.upper()}", "s"), (10, same, "s")]
    assert len({fp_by_hand(t) for _, t, _ in rows[:6]}) == 1
    assert all(alike_by_hand(x, y) < 0.8 for _, x, _ in rows[:6] for _, y, _ in rows[:6] if x != y)
    assert {r.doc_id for r in simhash.deduplicated(documents(spark, rows)).collect()} == {1, 2, 3, 4, 5, 6, 9}


@pytest.mark.parametrize(("nearest", "small"), [(8, 8), (1, 2)])
def test_links_behind_links_that_fail_are_found(spark, monkeypatch, nearest, small):
    """One crowded bucket, texts of almost one fingerprint: the unlike ones hide no pair that is alike,
    whatever the bucket's size, the pairs given at first and the order of the rows."""
    monkeypatch.setattr(simhash, "NEAREST", nearest)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(3)
    same, texts = " ".join(["alpha beta gamma"] * 300), []
    for _ in range(30):
        own = words(rng, 150).split()
        texts += [f"{same} {' '.join(own)}", f"{same} {' '.join(own[:-2])} {words(rng, 2)}"]
    want = components_by_hand_of([[i for i in range(60) if alike_by_hand(x, texts[i]) >= 0.8] for x in texts])
    assert want == set(range(0, 60, 2))
    for _ in range(2):
        rows = [(i, t, "s") for i, t in enumerate(texts)]
        rng.shuffle(rows)
        assert {r.doc_id for r in simhash.deduplicated(documents(spark, rows)).collect()} == want


def components_by_hand_of(near):
    least = list(range(len(near)))
    for _ in near:
        least = [min(least[j] for j in x) for x in near]
    return set(least)


def test_simhash_groups_of_documents(spark):
    rows = awkward()
    out = simhash.near_groups(documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    want = components_by_hand([fp_by_hand(t) for _, t, _ in rows])
    least = {}
    for i, t, _ in rows:
        if i is not None:
            root = want[fp_by_hand(t)]
            least[root] = min(i, least.get(root, i))
    expected = Counter((i, f"{fp_by_hand(t):016x}", least[want[fp_by_hand(t)]]) for i, t, _ in rows)
    assert Counter(tuple(r) for r in out) == expected
    assert simhash.near_groups(documents(spark, [])).count() == 0


def test_simhash_dedup_keeps_one_of_each_group(spark):
    docs = documents(spark, awkward())
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[30] == 1 and 31 not in ids and ids[40] == 1 and 41 not in ids and ids[None] == 2
    assert ids.pop(50) == 2 and max(v for k, v in ids.items() if k) == 1  # 50 has two unlike texts, one of them repeated


def test_unlike_texts_of_one_doc_id_stay(spark):
    rng = random.Random(9)
    one, other = words(rng, 80), words(rng, 80)
    docs = documents(spark, [(3, one, "a"), (7, one, "b"), (7, other, "b"), (7, other, "c"), (7, f"  {one}", "d")])
    kept = [(r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()]
    assert sorted(kept) == sorted([(3, one), (7, other)])


def test_boilerplate_makes_few_pairs(spark, monkeypatch):
    """Unlike texts with 100 words in common: no more than a few pairs a text are ever compared."""
    seen = []
    plain = simhash.checked
    monkeypatch.setattr(simhash, "checked", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    for n in (300, 600):
        rng = random.Random(n)
        common = words(rng, 100)
        seen.clear()
        assert simhash.deduplicated(documents(spark, [(i, f"{common} {words(rng, 24)}", "s") for i in range(n)])).count() == n
        assert sum(seen) <= n


def test_rare_shingles_find_every_alike_pair(spark):
    """Against all pairs, for texts of 1 to 60 words, copies with one to three words changed, cut or moved."""
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        base = words(rng, rng.randint(1, 60)).split()
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(other))
                other = rng.choice([other[:k] + [words(rng, 1)] + other[k + 1 :], other[k + 1 :] or other, other[:k] or other, other + words(rng, 2).split()])
            texts.append(other)
    texts = sorted({" ".join(t) for t in texts})
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    nodes = docs.select(F.col("doc_id").alias("node"), F.struct(F.lit(False).alias("none"), "doc_id", F.xxhash64("text").alias("text_hash")).alias("first"))
    rootless = spark.createDataFrame([], "node long, root long")
    first = simhash.first_shingles(simhash.shingle_sets(nodes, docs), 0.8)
    pairs = simhash.rare_pairs(first, rootless, 0.8)
    found = {(r.a, r.b) for r in pairs.collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if alike_by_hand(texts[i], texts[j]) >= 0.8}
    assert want and want <= found
    assert {(r.a, r.b) for r in simhash.checked(pairs, docs, nodes, 0.8).where("alike").collect()} == want
    assert simhash.rare_pairs(first, rootless, 0.8, stars=True).count() <= first.count()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def labelled(spark, rng, column):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(rng, rng.randint(30, 90))
        if column == "quality" and bad:
            text = " ".join(w.upper() + "###" for w in text.split())
        if column == "toxic" and bad:
            text = text.replace(" ", " you Foul! ", 2)
        rows.append((i, text, "s"))
        labels.append((i, None if i % 50 == 1 else int(bad == (column == "toxic")), 0))
    frame = spark.createDataFrame([*labels, labels[0], (None, 1, 0)], f"doc_id long, {column} int, extra int")
    return rows, {i: y for i, y, _ in labels}, frame


def test_quality_classifier_holds_out(spark):
    rows, truth, labels = labelled(spark, random.Random(1), "quality")
    docs = documents(spark, rows + [(900, None, None), (901, "", None), (None, "text", None)])
    trees = quality_classifier.learn(docs, labels)
    out = {r.doc_id: r for r in quality_classifier.score(docs, trees).collect()}
    assert all(r.held_out == (i is not None and fold(i, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out and truth.get(i) is not None]
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.97
    # labels of the held-out fold change nothing
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.learn(docs, flipped)).collect()}
    assert again == {i: r.score for i, r in out.items()}
    kept = quality_classifier.accepted(docs, trees)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}


def test_classifiers_without_labels(spark):
    docs, none = documents(spark, [(1, "some words", "s")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.score(docs, quality_classifier.learn(docs, none)).first().score == 0.5
    assert toxicity.score(docs, toxicity.learn(docs, none)).first().score == 0.5
    empty = documents(spark, [])
    assert quality_classifier.score(empty, quality_classifier.learn(empty, none)).count() == 0 == toxicity.score(empty, toxicity.learn(empty, none)).count()


def test_tree_traversal_equals_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    trees = quality_classifier.grow(x, (x[:, 0] * x[:, 1] > 0).astype(float))

    def walk(t, row):
        node = 0
        while node < trees.feature.shape[1]:
            node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
        return trees.leaf[t, node - trees.feature.shape[1]]

    assert np.allclose(trees.margin(x), [trees.base + sum(walk(t, r) for t in range(len(trees.feature))) for r in x])
    assert ((trees.score(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_statistics_by_hand():
    texts = ["a b a b\nLine TWO!! 3#", "", None, "x x x\nx x x\n\nq", "é è"]
    got = quality_classifier.statistics(pa.array(texts))
    name = {n: i for i, n in enumerate(quality_classifier.FEATURES)}
    assert got[0][name["symbols"]] == 1 / 7 and got[0][name["exclamations"]] == 2 / 7 and got[0][name["distinct_words"]] == 5 / 7
    assert got[3][name["same_neighbours"]] == 5 / 7 and got[3][name["distinct_lines"]] == 0.75 and got[4][name["high_bytes"]] == 2 / 5
    assert (got[1] == got[2]).all() and np.isfinite(got).all()


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    ids = [i for i in range(200) if fold(i, 4) != 2][:6]
    long, seen = " ".join(f"w{i}" for i in range(30_000)), []
    docs = documents(spark, [(ids[0], long, "s"), *[(i, f"plain text number {i}", "s") for i in ids[1:5]], (ids[5], None, "s")])
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "ftrl", lambda rows, y: seen.append(rows))
    toxicity.learn(docs, labels)
    got = sorted(map(len, seen.pop()))
    assert len(got) == 6 and got[0] == 0 and got[-1] > 80_000  # 89,997 features, a few of them in one place
    toxicity.learn(docs, labels, max_bytes=16 * 60)  # too little for the long one
    assert max(map(len, seen[-1])) < 20 and len(seen.pop()) == 5
    toxicity.learn(docs, labels, max_bytes=16 * len(long))
    assert len(seen.pop()) == 6
    sizes = [len(f"plain text number {i}") for i in ids[1:5]]
    few = toxicity.sampled(docs.where("doc_id <> %d" % ids[0]), labels, 100, 16 * max(sizes)).count()
    assert few == 5 and toxicity.sampled(docs, labels, 2, 1 << 30).count() == 2


def test_toxicity_holds_out(spark):
    rows, truth, labels = labelled(spark, random.Random(2), "toxic")
    docs = documents(spark, rows + [(900, None, None), (901, "", None), (902, "x " * 100_000 + "foul", None)])
    weights = toxicity.learn(docs, labels)
    assert len(weights.place) < 2000
    out = {r.doc_id: r for r in toxicity.score(docs, weights).collect()}
    assert all(r.held_out == (fold(i, 4) == 2) and r.predicted == (r.score >= 0.3) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out and truth.get(i) is not None]
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.97
    assert out[900].score == out[901].score
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, flipped)).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_ftrl_equals_plain_updates():
    """One coordinate at a time, in a dict, as the method is written down."""
    rng = random.Random(3)
    rows = [np.array(sorted(rng.sample(range(40), 8))) for _ in range(300)]
    y = np.array([float(3 in r or (7 in r and 9 not in r)) for r in rows])
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, l1, l2):
        return 0.0 if abs(z[i]) <= l1 else (np.sign(z[i]) * l1 - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + l2)

    for _ in range(toxicity.EPOCHS):
        for r, label in zip(rows, y):
            w = {i: weight(i, toxicity.L1, toxicity.L2) for i in r.tolist()} | {"bias": weight("bias", 0, 0)}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    got = toxicity.ftrl(rows, y)
    want = {i: weight(i, toxicity.L1, toxicity.L2) for i in range(40) if abs(z[i]) > toxicity.L1}
    assert want and got.place.tolist() == sorted(want) and np.allclose(got.weight, [want[i] for i in sorted(want)], rtol=1e-4)
    assert got.bias == pytest.approx(weight("bias", 0, 0), rel=1e-6)


def test_toxicity_learns_once_from_a_repeated_doc_id(spark):
    rows, _, labels = labelled(spark, random.Random(4), "toxic")
    one = toxicity.learn(documents(spark, rows), labels)
    again = toxicity.learn(documents(spark, rows + rows[:200]), labels)
    assert one.place.tolist() == again.place.tolist() and (one.weight == again.weight).all() and one.bias == again.bias


@pytest.fixture(scope="module")
def models():
    model = sentencepiece_scan.read_model()
    return sentencepiece_scan.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)


PARTS = ["the", "un", "believ", "able", " ", "  ", "     ", "\n", "漢字", "🎉", "é", "ing", "12", "==", "aaaa", "\t", "▁", "http://", "\x00"]


def chunked(pieces, text, chunk):
    own = text.replace(" ", "▁")
    own = "▁" + own
    matrices, parts = [], []
    for at in range(0, len(own), chunk):
        low, end = max(0, at - pieces.longest), min(len(own), at + chunk)
        part = own[low : end + pieces.longest]
        entry, leave, m, *_ = pieces.transfer(part, at - low, end - low)
        matrices.append(([(a + low, b + low) for a, b in entry], [(a + low, b + low) for a, b in leave], m))
        parts.append((part, low, at, end))
    out = []
    for (part, low, at, end), (x, y) in zip(parts, sentencepiece_scan.states_on_path(matrices, len(own))):
        out += pieces.trace_chunk(part, at - low, end - low, (x[0] - low, x[1] - low), (y[0] - low, y[1] - low))
    return out


def test_encoding_equals_the_library(models):
    pieces, library = models
    rng = random.Random(6)
    for _ in range(600):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40)))
        want = library.encode(text)
        assert pieces.encode(text) == want == pieces.piece_ids(pieces.best_path("▁" + text.replace(" ", "▁")))
        assert chunked(pieces, text, rng.randint(1, 9)) == want == chunked(pieces, text, rng.randint(10, 60))
        assert pieces.decode(want) == text.replace("▁", " ")


def test_merges_of_many_at_once(models):
    pieces, _ = models
    rng = random.Random(9)
    segments = ["".join(rng.choice(PARTS).replace(" ", "▁") for _ in range(rng.randint(1, 9))) for _ in range(500)] + ["", "a", "\ud800"[:0], "aaaaaaa", "🎉🎉"]
    assert pieces.merge_all(segments) == [tuple(pieces.piece_ids(pieces.merge(s))) for s in segments]
    assert pieces.merge_all([]) == []


@pytest.mark.parametrize("size", [1, 3, 16, 100])
def test_chunks_of_any_size_give_the_same_ids(models, monkeypatch, size):
    """Ordinary texts go through the matrices of their chunks, with and without borders in them."""
    monkeypatch.setattr(sentencepiece_scan, "CHUNK", size)
    pieces, library = models
    rng = random.Random(size)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["z" * 300, "unbelievable" * 30, "", "a"]
    assert pieces.encode_texts(texts) == [library.encode(t) for t in texts]


def test_path_through_the_tree_equals_the_chain(models):
    pieces, _ = models
    own = "▁" + "unbelievableness the ".replace(" ", "▁") * 9
    for size in (5, 7, 13, 64):
        ms = [pieces.transfer(own, at, min(len(own), at + size)) for at in range(0, len(own), size)]
        path = sentencepiece_scan.states_on_path(ms, len(own))
        assert all(x[1] == y[0] for x, y in zip(path, path[1:])) and path[-1][1][1] == len(own)
        got = [i for at, (x, y) in zip(range(0, len(own), size), path) for i in pieces.trace_chunk(own, at, min(len(own), at + size), x, y)]
        assert got == pieces.piece_ids(pieces.best_path(own))


def test_matrices_combine_associatively(models):
    pieces, _ = models
    own = "▁" + "unbelievableness" * 6
    ms = [pieces.transfer(own, at, min(len(own), at + 13))[2] for at in range(0, len(own), 13)]
    c = sentencepiece_scan.combine
    assert c(c(ms[0], ms[1]), c(ms[2], ms[3])) == c(c(c(ms[0], ms[1]), ms[2]), ms[3]) == c(ms[0], c(ms[1], c(ms[2], ms[3])))


def test_encoding_of_tables(spark, models):
    _, library = models
    rows = awkward() + [(70, "z" * 3000, "s"), (71, "no " * 2000, "s")]
    out = sentencepiece_scan.encode_and_check(documents(spark, rows), chunk=500).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, tuple(library.encode(t or ""))) for i, t, _ in rows)
    texts = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == texts
    encoded = sentencepiece_scan.encode(documents(spark, rows[:20]))
    assert {r.doc_id: r.text for r in sentencepiece_scan.decode(encoded).collect()} == {i: t or "" for i, t, _ in rows[:20]}
    assert sentencepiece_scan.encode_and_check(documents(spark, [])).count() == 0
