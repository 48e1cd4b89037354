"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Each of its 64
bits gets a nonzero vector of radius + 1 bits; each of the 2 ** (radius + 1) - 1 nonzero vectors v
gives a table whose mask holds the bits with an odd inner product with v. Up to ``radius`` differing
bits span less than the whole vector space, so some v is orthogonal to them all: in its table the
two fingerprints have equal keys. No pair within the radius is lost.

A larger radius takes more tables than rows are long. Then the bits are dealt into ``parts``: of up to
``radius`` differing bits one part holds radius // parts at most, and each part is covered for that
many. Keys are shorter in return, so parts suit a corpus of up to some hundred million texts.

For dropping near copies a link counts only if the two texts' sets of five-word shingles are at least so
alike, however near the fingerprints are. What is compared are distinct texts (by a 64-bit hash of their
words); texts of equal words are one. Fingerprints are searched once each, and a bucket gives all its pairs
within the radius, unless a fingerprint has over NEAREST of them there. Such crowded fingerprints, those that
several texts have, and short texts are joined exactly instead, by their rarest shingles
(``rare_pairs``): boilerplate that many texts share makes no pairs there. What is found alike before counts as
one, and pairs inside it aren't made again.

For the groups by fingerprint alone only distinct fingerprints are searched. Buckets of up to SMALL are compared many at once. Larger ones
are compared in blocks inside one task, which returns a spanning forest of their links and no other
pairs. A bucket of more than BUCKET fingerprints is dealt
again by a covering of the bits that its mask leaves free; for the query's radius what remains has
16 free bits or so, which bounds it whatever the input. Components come from alternating star
contractions, written to the shared folder each round.

Defined cases: a null text is empty; a text without words has fingerprint zero, linked like any
other; repeated rows are separate rows of one component; an empty table gives an empty result; a
null doc_id never names a component unless no other one is in it; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm import bytesops as B
from specloom.llm.common import fresh, materialise, small_batches, trimmed
from specloom.operators.joins import sized_join

RADIUS = 3
SHINGLE = 3
#: For dropping near copies from a corpus: texts with 0.8 of their five-word shingles in common are
#: mostly within eleven bits, which take 126 tables of two parts.
WIDE, PARTS, SIMILARITY, CHECKED_SHINGLE = 11, 2, 0.8, 5
#: Fingerprints of a bucket that one task compares without dealing them again.
BUCKET = 4096
#: Fingerprints of a bucket of the wide search that are compared at all; those of larger ones, and those with
#: more than NEAREST near ones in a bucket, go by rare shingles.
WIDE_BUCKET, NEAREST = 1 << 14, 8
#: Texts of fewer words all go by rare shingles: a few changed words move their fingerprints too far. Of texts
#: that are alike the longer one has at most a quarter more shingles, so pairs of up to 128 words are whole.
SHORT = 164
#: Words of 64 bits that hold the parities of a text's shingles.
PARITY = 8
#: Fingerprints of a bucket that is compared with others at once.
SMALL = 24
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 14


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """bytes.lower and bytes.split work on A-Z and on the six ASCII spaces, as the words need it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    at = np.cumsum([0, *(len(w) + 1 for w in words)])
    n = max(len(words) - shingle + 1, 1)
    ends = (at[min(shingle, len(words)) :] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(at[:n].tolist(), ends)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        counts += np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([simhash(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, fp long")


def covering_masks(bits: int, radius: int, parts: int = 1) -> list[int]:
    """Masks over the set bits of ``bits``: any ``radius`` of these bits are outside some mask. A part of
    few bits gets vectors with a common bit, which leaves no mask with less than half of the bits (they
    are a first-order Reed-Muller code, if the bits are as many as the vectors)."""
    places = [i for i in range(64) if bits >> i & 1]
    half = 1 << radius // parts
    masks = []
    for part in (places[k::parts] for k in range(parts)):
        vectors = {i: half + k if len(part) <= half else k % (2 * half - 1) + 1 for k, i in enumerate(part)}
        masks += [sum(1 << i for i in part if (vectors[i] & v).bit_count() & 1) for v in range(1, 2 * half)]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(masks: list[int], fp: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("k")


def spanning_links(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, each of its links one within the radius."""
    n, bits = len(members), members.view(np.uint64)  # of signed values numpy counts the bits of the amount
    root, pairs = np.arange(n), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, (1 << 20) // n)
    for least, most in ((0, RADIUS), (RADIUS + 1, radius)):  # the surer links first
        for begin in range(0, n if least <= radius else 0, step):
            apart = np.bitwise_count(bits[begin : begin + step, None] ^ bits[None, :])
            for i, j in zip(*np.nonzero(np.triu((apart >= least) & (apart <= min(most, radius)), begin + 1))):
                a, b = find(begin + i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    pairs.append((begin + i, j))
    one, other = np.array(pairs, np.int64).reshape(-1, 2).T
    return members[one], members[other]


def _dealt(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """``prints`` (fp and others), once for each table: with t, key, t2, key2, the names of its bucket."""
    masks, kept = covering_masks((1 << 64) - 1, radius, parts), prints.columns
    keyed = prints.select(*kept, _tables(masks, F.col("fp"))).select(*kept, "k.t", "k.key")
    large = materialise(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("t", "key"), "large-buckets")
    few = keyed.join(large, ["t", "key"], "left_anti").select("t", "key", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("key2"), *kept)
    again = [(t, u, _signed(x)) for t, m in enumerate(masks) for u, x in enumerate(covering_masks(~m & ((1 << 64) - 1), radius, parts))]
    again = prints.sparkSession.createDataFrame(again, "t int, t2 int, mask long")  # as many rows as there are tables, squared
    many = keyed.join(large, ["t", "key"]).join(F.broadcast(again), "t").select("t", "key", "t2", F.col("fp").bitwiseAND(F.col("mask")).alias("key2"), *kept)
    return few.unionByName(many)


def links(prints: DataFrame, radius: int = RADIUS, parts: int = 1) -> DataFrame:
    """``prints`` (fp, distinct) -> a, b: links that connect what lies within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            group, small = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes <= SMALL, sizes)
            bits, found = fps.view(np.uint64), []
            for k in range(1, SMALL):  # small buckets all at once, each row against the k-th after it
                pair = np.flatnonzero((group[k:] == group[:-k]) & small[k:])
                pair = pair[np.bitwise_count(bits[pair] ^ bits[pair + k]) <= radius]
                found.append((fps[pair], fps[pair + k]))
            found += [spanning_links(fps[cuts[i] : cuts[i + 1]], radius) for i in np.flatnonzero(sizes > SMALL)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

        keys, fps = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)  # of the bucket that isn't complete
        for b in batches:
            keys = np.concatenate([keys, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:4]], axis=1)])
            fps = np.concatenate([fps, b.column(4).to_numpy()])
            if len(keys) and (done := len(keys) - int((keys[::-1] == keys[-1]).all(axis=1).argmin() or len(keys))):
                yield out(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
        if len(keys):
            yield out(keys, fps)

    order = ["t", "key", "t2", "key2"]
    dealt = _dealt(prints, radius, parts).repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(trimmed(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> node, root (the least node of its component) for every node with an edge,
    roots excepted. Alternates large-star and small-star contractions until nothing changes; the
    number of rounds grows with the logarithm of the nodes."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = materialise(small, "links")
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def text_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, node (a hash of the text's words in lower case), n_words and fp of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [t.encode().lower().split() for t in b.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in said], np.uint64).view(np.int64)
            prints = np.array([simhash(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array(list(map(len, said)), pa.int64()), pa.array(prints)], names=["doc_id", "text_hash", "node", "n_words", "fp"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, text_hash long, node long, n_words long, fp long")


def nearest_pairs(fps: np.ndarray, radius: int, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs within the radius: of each place all, or, if it has more than ``nearest``, the nearest one; and
    the places that have more. A pair may come both ways round. A pair that is left out has more at both ends."""
    n, bits, found, more = len(fps), fps.view(np.uint64), [], []
    step = max(1, (1 << 20) // n)
    for begin in range(0, n, step):
        apart = np.bitwise_count(bits[begin : begin + step, None] ^ bits[None, :])
        fits = apart <= radius
        fits[np.arange(len(fits)), begin + np.arange(len(fits))] = False
        over = np.flatnonzero(fits.sum(axis=1) > nearest)
        if len(over):
            one = np.where(fits[over], apart[over], 255).argmin(axis=1)
            fits[over] = False
            fits[over, one] = True
            more.append(begin + over)
        i, j = np.nonzero(fits)
        found.append((begin + i, j))
    return *(np.concatenate(x) for x in zip(*found)), np.concatenate([np.zeros(0, np.int64), *more])


def in_buckets(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """``prints`` (fp, distinct), once for each table: bucket, a hash of the table and of its key, and fp."""
    keyed = prints.select("fp", _tables(covering_masks((1 << 64) - 1, radius, parts), F.col("fp")))
    return keyed.select(F.xxhash64("k.t", "k.key").alias("bucket"), "fp")


def candidates(dealt: DataFrame, radius: int, nearest: int, limit: int) -> DataFrame:
    """``dealt`` (bucket, fp) -> a, b: pairs of fingerprints within the radius; and rows without b, for each fingerprint
    that has pairs besides these: more than ``nearest`` in a bucket, or a bucket of over ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(one: np.ndarray, other: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
            b = pa.concat_arrays([pa.array(np.maximum(one, other)), pa.nulls(len(crowded), pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.minimum(one, other), crowded])), b], names=["a", "b"])

        def out(rows: np.ndarray) -> pa.RecordBatch:
            keys, fps = rows
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            after = np.repeat(cuts[1:], sizes)
            bits, found, crowded = fps.view(np.uint64), [(fps[:0], fps[:0])], [fps[:0]]
            live = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
            for k in range(1, SMALL):  # small buckets all at once, each row against the k-th after it
                live = live[live + k < after[live]]
                if not len(live):
                    break
                pair = live[np.bitwise_count(bits[live] ^ bits[live + k]) <= radius]
                found.append((fps[pair], fps[pair + k]))
            for i in np.flatnonzero(sizes > SMALL):
                own = fps[cuts[i] : cuts[i + 1]]
                if sizes[i] > limit:
                    crowded.append(own)
                    continue
                one, other, more = nearest_pairs(own, radius, nearest)
                found.append((own[one], own[other]))
                crowded.append(own[more])
            return told(*(np.concatenate(x) for x in zip(*found)), np.concatenate(crowded))

        rows, none, full = np.zeros((2, 0), np.int64), np.zeros(0, np.int64), None  # rows of the bucket that isn't complete
        for b in batches:
            new = np.stack([c.to_numpy() for c in b.columns])
            if full is not None:  # the bucket is over the limit already, so its rows aren't held
                same = new[0] == full
                yield told(none, none, new[1, same])
                new = new[:, ~same]
                full = full if not new.shape[1] else None
            rows = np.concatenate([rows, new], axis=1)
            if rows.shape[1] and (done := int(np.searchsorted(rows[0], rows[0, -1]))):
                yield out(rows[:, :done])
                rows = rows[:, done:]
            if rows.shape[1] > limit:
                full = rows[0, 0]
                yield told(none, none, rows[1])
                rows = rows[:, :0]
        if rows.shape[1]:
            yield out(rows)

    dealt = dealt.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInArrow(trimmed(run), "a long, b long").distinct()


def shingle_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, hs and parity of ``nodes`` (node, first), written: hashes of the different shingles of a node's text, in order,
    and for each remainder of these by 64 * PARITY a bit that tells whether an odd number has it. The
    text is that of the node's least doc_id; only texts of these nodes are moved."""
    first = nodes.select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    texts = texts.join(first, texts.doc_id.eqNullSafe(first._id) & (texts.text_hash == first._hash)).groupBy("node").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = B.byte_values(6)
        for batch in batches:
            for begin, end in B.pieces(batch.column(1)):
                data, at = B.utf8(batch.column(1)[begin:end])
                starts, ends, counts = B.word_spans(data, at)
                hashes, n = B.shingle_hashes(B.word_hashes(data, starts, ends, values, lower=True), counts, CHECKED_SHINGLE)
                sets = [np.unique(x.view(np.int64)) for x in np.split(hashes, np.cumsum(n)[:-1])]
                odd = [np.bincount((x.view(np.uint64) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY).astype(np.uint8) & 1 for x in sets]
                parity = [np.packbits(x).view(np.int64) for x in odd]
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], *(pa.array(x, pa.list_(pa.int64())) for x in (sets, parity))], names=["node", "hs", "parity"])

    return materialise(texts.mapInArrow(trimmed(run), "node long, hs array<long>, parity array<long>"), "shingles")


def checked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``alike``: whether the shingles of the two nodes' texts are. Each text's are hashed once."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = shingle_sets(nodes.join(ends, "node", "left_semi"), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x, y = one.values.to_numpy(), other.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], names=["a", "b", "alike"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b")
    return materialise(both.select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long, alike boolean"), "checked")


def first_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """``sets`` (node, hs, parity) -> node, n, own, i, h, parity, written: of each text the first of its n shingles, in an order that is one
    for all texts: by number of texts, so common passages come last. Two texts that are so alike share one of the
    first ones of each: all but similarity * n, and one. Shingles of a single text (own of them, in front) pair with
    nothing, so they are left out, and a text with enough of them drops out at once."""
    rows = sets.select("node", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    shared = sized_join(rows, rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), ["h"])
    listed = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    own = F.col("n") - F.size("s")
    wanted = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - own
    first = listed.where(wanted > 0).join(sets.select("node", "parity"), "node").select("node", "n", "parity", own.alias("own"), F.posexplode(F.slice("s", F.lit(1), wanted.cast("int"))).alias("i", "x"))
    return materialise(first.select("node", "n", "own", "i", "x.h", "parity"), "first-shingles")


def rare_pairs(first: DataFrame, roots: DataFrame, similarity: float, stars: bool = False) -> DataFrame:
    """``first`` (of first_shingles), ``roots`` (node, root) -> a, b: every pair of different roots whose shingles can be
    so alike. With ``stars`` of each shingle only the pairs with its least node: as many as there are rows, which
    bring large groups of near copies together, so that few pairs of different roots are left. The shingles that
    are in texts of different roots are written first, as both sides of the join read them, and twice."""
    first = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = first.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("h")
    first = materialise(first.join(apart, "h", "left_semi"), "apart-shingles")
    # of a pair the one with fewer shingles has more of them in common, so fewer of its own suffice
    fewer = F.col("own") + F.col("i") < F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9) + 1
    columns = ("node", "n", "own", "i", "root", "parity")
    centres = first.groupBy("h").agg(F.min(F.struct(*columns)).alias("x")).select("h", "x.*") if stars else first.where(fewer)
    one, other = (x.select("h", *(F.col(c).alias(c + k) for c in columns)) for x, k in ((centres, "1"), (first, "2")))
    ordered = F.col("node1") != F.col("node2") if stars else (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
    fits = ordered & (F.col("root1") != F.col("root2"))
    # what may be in common: shared shingles before this one, and all from this one on
    rest = F.least(F.col("n1") - F.col("own1") - F.col("i1"), F.col("n2") - F.col("own2") - F.col("i2"))
    enough = similarity / (1 + similarity) * (F.col("n1") + F.col("n2")) - 1e-9
    # bits of parity that differ: at most as many as there are shingles of one text only
    differ = sum((F.bit_count(F.col("parity1")[k].bitwiseXOR(F.col("parity2")[k])) for k in range(1, PARITY)), F.bit_count(F.col("parity1")[0].bitwiseXOR(F.col("parity2")[0])))
    fits &= (F.least("i1", "i2") + rest >= enough) & ((F.col("n1") + F.col("n2") - differ) / 2 >= enough)
    pairs = sized_join(one, other, ["h"]).where(fits)
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def alike_groups(docs: DataFrame, radius: int, shingle: int, parts: int, similarity: float) -> DataFrame:
    """doc_id, text_hash and root (equal within a group) of each row of ``docs``; groups are connected by
    pairs that are alike: those within the radius, and all those of short texts."""
    prints = materialise(text_prints(docs, shingle), "text-prints")
    nodes = prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n_words").alias("n_words"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    nodes = materialise(nodes, "nodes")
    alone = nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.min("n_words").alias("n_words"))
    found = materialise(candidates(in_buckets(alone.select("fp"), radius, parts), radius, NEAREST, WIDE_BUCKET), "candidates")
    # texts that are joined by rare shingles: of crowded fingerprints, of one that several have, and short ones
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp"), F.lit(True).alias("crowded")).distinct()
    alone = alone.join(crowded, "fp", "left").withColumn("open", F.coalesce("crowded", F.lit(False)) | (F.col("n") > 1) | (F.col("n_words") < SHORT))
    alone = materialise(alone.select("fp", "node", "n", "open"), "fingerprints")
    a, b = (alone.select(F.col("fp").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "open"))) for x in ("a", "b"))
    # two crowded ones are open both, so only the surest of their pairs are of use
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > RADIUS
    pairs = found.where("b IS NOT NULL")
    for x in ("a", "b"):
        pairs = pairs.join(crowded.select(F.col("fp").alias(x), F.col("crowded").alias(f"{x}_crowded")), x, "left")
    pairs = pairs.where(~far | F.col("a_crowded").isNull() | F.col("b_crowded").isNull()).select("a", "b")
    paired = materialise(pairs.join(a, "a").join(b, "b"), "paired")
    # the others' pairs, and of open texts the surest, so that copies are one group before the join
    sure = paired.where("a_n = 1 AND b_n = 1").where(~(far & F.col("a_open") & F.col("b_open")))
    tried = checked(sure.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")), docs, nodes, similarity)
    roots = materialise(components(tried.where("alike").select("a", "b")), "roots")
    beside = paired.where("a_n > 1 OR b_n > 1").select(F.explode(F.array("a", "b")).alias("fp"))
    open_nodes = nodes.join(alone.where("open").select("fp").unionByName(beside).distinct(), "fp", "left_semi")
    first = first_shingles(shingle_sets(open_nodes, docs), similarity)
    for stars in (True, False):
        # written, as the check reads them twice: joined once, and no plan on the driver holds the join and the check
        rare = materialise(rare_pairs(first, roots, similarity, stars).join(tried, ["a", "b"], "left_anti"), "rare-pairs")
        tried = tried.unionByName(checked(rare, docs, nodes, similarity))
        roots = materialise(components(tried.where("alike").select("a", "b")), "roots")
    return prints.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, parts: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint, component_id."""
    small_batches(docs.sparkSession)
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    found = components(links(distinct.select("fp"), radius, parts))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = WIDE, shingle: int = SHINGLE, parts: int = PARTS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of ``alike_groups``: the one with the least doc_id, of several the
    first by a hash of text and of the other columns. Rows without doc_id stay. Rows are told apart by doc_id
    and text, so unlike texts of one doc_id are in groups of their own."""
    place, digest = fresh(docs, "_place"), fresh(docs, "_text_hash")
    groups = alike_groups(docs, radius, shingle, parts, similarity).where("doc_id IS NOT NULL")
    keep = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.doc_id", F.col("k.text_hash").alias(digest))
    others = [c for c, kind in docs.dtypes if not kind.startswith("map") and c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", digest).orderBy("text", F.xxhash64(F.lit(0), *others))
    rows = docs.withColumn(digest, F.xxhash64(F.coalesce("text", F.lit(""))))
    once = rows.join(keep, ["doc_id", digest], "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return once.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
