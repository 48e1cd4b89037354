"""Suffix-array dedup: find every byte that a repeated string covers.

The strings are windows of ``length`` bytes, or, for passages, of ``words`` whole words with what
stands between them. Texts are first cut into runs so that any two equal windows meet. A window has
an anchor, its least gram hash (leftmost of equals); neighbouring windows of one anchor form a run.
Equal windows have equal anchors at equal places, so they are in runs with equal anchor hashes, and
runs whose anchor hash occurs once are done. The bytes of the others, each distinct run once with
the number of its occurrences, go by anchor hash into run-length indexes.

An index holds the run-compressed Burrows-Wheeler transform of 32 KiB or so of such strings (128 KiB
of passages, whose symbols are pairs of neighbouring words): equal suffixes of a string that occurs n
times fill a BWT run of n, so it is entered once. Only suffixes as long as a window are in its order.
Matching statistics are sampled where a BWT run begins or ends, and at the begin of each string that
occurs again; inside a run the value falls by one for each step along the text, so one streaming
pass from the samples gives all of them. Windows whose value reaches their length are marked.

Anchors whose runs are too many bytes for one index are cut once more, by finer keys: the least gram
of each quarter of a window, then the window itself. What is shared under a finer key goes into
indexes of its own. Under the last key all strings are equal, so no index grows with the input, and
no result comes by another way. Runs are the same only if 127 bits of their bytes' BLAKE2 digests are.

Nothing is capped or sampled, and no step gathers a group that grows with the input. Both searches of
``removals`` go through the same steps at once; texts are read once for their runs and shuffled twice
by row, for the bytes of shared runs and for the result.

Defined cases: a null text is empty; a text without a window is kept whole; a string that overlaps
its own repeat counts; rows that repeat doc_id and text repeat each other; a null doc_id stays null
and is a row like others; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm import bytesops as B
from specloom.llm.common import discard, fresh, materialise, small_batches, trimmed

LENGTH = 400
#: Words of a passage: over fifty.
PASSAGE = 51
#: Bytes of one anchor hash that go into one index; more are cut by finer keys.
HOT = 1 << 20
#: Bytes of an index, four times as many if its symbols are words: its arrays stay in a core's cache.
INDEX = 1 << 15
#: Depth to which suffixes are sorted, if the windows asked for aren't longer.
DEPTH = 512
#: Bytes of a text worked on at once; what is longer is worked on in overlapping parts.
PART = 1 << 19
#: Parts of a window whose anchors make its key, level by level; 0: the window itself.
LEVELS = (1, 4, 0)
_VALUES = B.byte_values(31)
_PLACE = np.uint64((1 << 24) - 1)
_SEPARATOR = 255  # no byte of UTF-8


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64((1 << 64) - 1))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def units_of(data: np.ndarray, at: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of what windows are made of, bytes or words, and how many each text has."""
    if words:
        return B.word_spans(data, at)
    places = np.arange(len(data))
    return places, places + 1, np.diff(at)


def runs_of(data: np.ndarray, at: np.ndarray, length: int, gram: int, words: bool = False, parts: int = 1) -> tuple[np.ndarray, ...]:
    """For the texts data[at[i]:at[i + 1]]: of each run of windows of ``length`` units the text, the
    begins of its first and last window and the end of the last one (from the text's begin), and its
    key, from the anchors of ``parts`` parts of a window."""
    starts, ends, sizes = units_of(data, at, words)
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.any():
        return (np.zeros(0, np.int64),) * 5
    offsets = np.cumsum(sizes) - sizes
    # a window is told by its first unit; cut: where a run or a text begins
    some = np.flatnonzero(counts)
    begins, after = offsets[some], (offsets + counts)[some]
    n = len(starts) - length + 1
    inside = np.zeros(n + 1, np.int8)
    inside[begins] += 1
    inside[after] -= 1
    inside = np.cumsum(inside[:n], dtype=np.int8).view(bool)
    prefix = B.prefix_hash(_VALUES[data])
    cut = np.ones(n, bool)
    if parts:
        part = -(-length // parts)
        gram = min(gram, max(1, part // 3)) if parts > 1 else gram
        places = np.arange(len(starts) - gram + 1)
        if words:
            grams = B.mixed(B.span_hash(prefix, starts[places], ends[places + gram - 1]))
        else:
            grams = B.mixed((prefix[gram:] - prefix[:-gram]) * B.powers(len(prefix))[1][: len(places)])
        least = (_least(grams & ~_PLACE | places.astype(np.uint64), part - gram + 1) & _PLACE).astype(np.int64)
        shifts = [min(k * part, length - part) for k in range(parts)]
        np.not_equal(least[1:n], least[: n - 1], out=cut[1:])
        for x in shifts[1:]:
            cut[1:] |= least[x + 1 : x + n] != least[x : x + n - 1]
        cut[begins] = True
        first = np.flatnonzero(cut & inside)
        key = np.zeros(len(first), np.uint64)
        for x in shifts:
            key = grams[least[first + x]] if parts == 1 else B.mixed(key + grams[least[first + x]])
    else:
        first = np.flatnonzero(inside)
        key = B.mixed(B.span_hash(prefix, starts[first], ends[first + length - 1]))
    text = np.repeat(some, np.diff(np.searchsorted(first, np.append(begins, n))))
    # a run's last window is before the next run's first, or the last of its text
    last = np.minimum(np.append(first[1:], n), (offsets + counts)[text]) - 1
    return text, starts[first] - at[text], starts[last] - at[text], ends[last + length - 1] - at[text], key.view(np.int64)


def _digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    view, digest = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    joined = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist())])
    return tuple(np.frombuffer(joined, np.int64).reshape(-1, 2).T)


def _parts(texts: pa.Array, length: int, words: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, offset in it, bytes, begins): whole texts, or parts of one long text that overlap
    by what a window needs."""
    for begin, end in B.pieces(texts):
        data, at = B.utf8(texts.slice(begin, end - begin))
        if end - begin > 1 or len(data) <= PART:
            yield begin, 0, data, at
            continue
        starts, ends, _ = units_of(data, np.array([0, len(data)]), words)
        i = 0
        while i == 0 or i + length <= len(starts):
            # as many units as a part has room for, and those of one window at least
            j = max(i + length, int(np.searchsorted(ends, starts[i] + PART, "right"))) if len(starts) else 0
            j = min(j, len(starts))
            part = data[starts[i] : ends[j - 1]] if j else data[:0]
            yield begin, int(starts[i]) if j else 0, part, np.array([0, len(part)])
            i = j - length + 1
            if j >= len(starts):
                break


#: Length of the windows, of the grams that anchor them, and whether in words; up to two are made at once.
Search = tuple[int, int, bool]
_RUNS = "s1 long, s2 long, a long, b long, h long, d1 long, d2 long, n long, more array<struct<a:long,b:long>>"
_RANGES_TYPE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _range_lists(of: np.ndarray, froms: np.ndarray, tos: np.ndarray, n: int) -> pa.Array:
    """Ranges, ordered by the row that they are of, as lists; null for rows without any."""
    counts = np.bincount(of, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(froms, pa.int64()), pa.array(tos, pa.int64())], names=["a", "b"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs, mask=pa.array(counts == 0)) if n else pa.array([], _RANGES_TYPE)


def runs(sources: DataFrame, searches: list[Search], level: int = 0) -> DataFrame:
    """``sources`` (s1, s2, w, data) -> _RUNS: the distinct runs of each text, by digest, with the bytes
    [a, b) of the first; n: how often they occur, times w; more: all their ranges if over one. The
    lowest bit of h and d1 is the search's number. Below the first level, s1 and s2 are digests of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, (length, gram, words) in enumerate(searches):
                own = batch.filter(pa.array(batch.column(0).to_numpy() & 1 == number)) if level else batch
                s1, s2, w = (own.column(i).to_numpy() for i in range(3))
                for first, offset, data, at in _parts(own.column(3), length, words):
                    text, a, _, b, h = runs_of(data, at, length, gram, words, LEVELS[level])
                    if not len(text):
                        continue
                    d1, d2 = _digests(data, a + at[text], b + at[text])
                    key = B.mixed(d1.view(np.uint64) ^ B.mixed(text.astype(np.uint64)))
                    _, lead, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    again = np.flatnonzero(n[group] > 1)
                    froms, tos, of = merged(group[again], a[again], b[again])
                    row = text[lead] + first
                    more = _range_lists(of, froms + offset, tos + offset, len(lead))
                    h, d1 = (x[lead] & ~1 | number for x in (h, d1))
                    columns = [s1[row], s2[row], a[lead] + offset, b[lead] + offset, h, d1, d2[lead], n * w[row]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), more], names=["s1", "s2", "a", "b", "h", "d1", "d2", "n", "more"])

    return sources.select("s1", "s2", "w", "data").mapInArrow(trimmed(run), _RUNS)


def merged(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of half-open ranges, by text: begins, ends, texts. Ranges that touch are one."""
    if not len(text):
        return start, end, text
    order = np.lexsort([start, text])
    text, start, end = text[order], start[order], end[order]
    shift = text * np.int64(1 << 40)
    reach = np.maximum.accumulate(end + shift)
    cut = np.ones(len(text), bool)
    cut[1:] = start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(cut)
    return start[first], (reach - shift)[np.concatenate([first[1:], [len(text)]]) - 1], text[first]


class RunLengthIndex:
    """Run-compressed BWT of some strings that occur ``counts`` times, with the suffixes at its runs'
    ends and their longest matches elsewhere (up to ``depth``) as samples. Strings are of bytes, or of
    other symbols: whole numbers from 0 on, each of which is less than how many symbols there are.

    Matches of less than ``least`` may be sampled as shorter than they are. Only suffixes that have
    ``least`` symbols left in their string can match for so long, and only with each other; so the order
    has no others."""

    def __init__(self, strings: list[np.ndarray], counts: list[int] | None = None, depth: int = DEPTH, least: int = 0) -> None:
        self.sizes = np.array([len(s) + 1 for s in strings])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.depth = depth
        n = self.n = int(self.sizes.sum())
        #: how many ranks go into a key of 64 bits
        self.fan = 3 if n < 1 << 21 else 2
        own = strings[0].dtype == np.uint8
        separator = _SEPARATOR if own else n
        text = np.full(n + depth + 16, separator, np.uint8 if own else np.int64)
        for at, s in zip(self.begins, strings):
            text[at : at + len(s)] = s
        self.text = text
        # the symbols from each place on, as numbers in the symbols' order
        if own:
            self.bits, self.width = 8, 8
            words = np.ndarray(n + depth + 8, ">u8", text, strides=(1,)).astype(np.uint64)
        else:
            self.bits, self.width = 63 // self.fan, self.fan
            words = text[: n + depth + 8].astype(np.uint64)
            for k in range(1, self.width):
                words = words << np.uint64(self.bits) | text[k : n + depth + 8 + k].astype(np.uint64)
        order, common = self._sorted(words, least)
        bwt = text[order - 1]
        bwt[order == 0] = separator
        head = np.ones(len(order) + 1, bool)
        head[1:-1] = bwt[1:] != bwt[:-1]
        self.run_heads = np.flatnonzero(head[:-1])
        self.run_bytes = bwt[self.run_heads]
        # a string's begin isn't known from the place before it
        border = head[:-1] | head[1:] | (bwt == separator)
        tied = common >= depth  # of the neighbours i - 1 and i in order
        most = np.minimum(np.maximum(self.fan * common, self.width), depth)
        i = np.flatnonzero((border[1:] | border[:-1]) & ~tied[1:-1] & (most[1:-1] > least)) + 1
        common[i] = self._common(words, order[i - 1], order[i], common[i])
        sampled = border | tied[:-1] | tied[1:]
        again = np.zeros(0, np.int64) if counts is None else np.flatnonzero(np.asarray(counts) > 1)
        self.sample_at = np.concatenate([order[sampled], self.begins[again]])
        self.sample = np.concatenate([np.maximum(common[:-1], common[1:])[sampled], self.sizes[again] - 1])

    def _steps(self, least: int) -> list[tuple[int, list[int], np.ndarray | None]]:
        """Depths that suffixes are sorted to, one after another; the distances of the ranks that make the
        key; and which suffixes are wanted (None: all)."""
        depths = [min(self.width, self.depth)]
        while depths[-1] < self.depth:
            depths.append(min(self.fan * depths[-1], self.depth))
        wanted = None
        if least > 1:  # a string's separator has one symbol left
            left = np.repeat(self.begins + self.sizes, self.sizes) - 1 - np.arange(self.n)
            wanted = left >= least
        steps = []
        for depth, before in zip(depths[:0:-1], depths[-2::-1]):
            away = sorted({min(k * before, depth - before) for k in range(1, self.fan)} - {0})
            steps.append((depth, away, wanted))
            if wanted is not None:
                wider = wanted.copy()
                for x in away:
                    wider[x:] |= wanted[:-x]
                wanted = wider
        return [(depths[0], [], wanted), *reversed(steps)]

    def _sorted(self, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order of their first ``depth`` symbols, and how many of them neighbours i - 1 and i
        agree in at least: 0 (they agree in less than ``width``), ``depth``, or over a ``fan``-th of them."""
        (reached, _, wanted), *steps = self._steps(least)
        order = np.arange(self.n) if wanted is None else np.flatnonzero(wanted)
        own = words >> np.uint64(self.bits * (self.width - reached))
        order = order[np.argsort(own[order])]
        place = np.arange(len(order))  # in the order as it first was; ranks are such places
        rank = np.zeros(self.n + self.depth + 1, np.int32)
        fresh = np.ones(len(order), bool)
        own = own[order]
        fresh[1:] = own[1:] != own[:-1]
        rank[order] = np.maximum.accumulate(np.where(fresh, place, 0)) + 1
        common = np.zeros(len(order) + 1, np.int64)
        common[:-1][~fresh] = reached
        for depth, away, wanted in steps:
            if wanted is not None:
                stay = np.flatnonzero(wanted[order])
                if 0 < len(stay) and (depth == self.depth or 4 * len(stay) < 3 * len(order)):
                    # what two agree in is the least that those between them agree in
                    between = np.minimum.reduceat(common, np.concatenate([[0], stay + 1]))
                    common = np.concatenate([[0], between[1:-1], [0]])
                    order, place = order[stay], place[stay]
            same = common == reached
            at = np.flatnonzero(same[:-1] | same[1:])
            if not len(at):
                break
            places, slots = order[at], place[at]
            key = rank.take(places).astype(np.int64)
            for x in away:
                key <<= 63 // self.fan
                key |= rank.take(places + x)
            by = np.argsort(key)
            places, key = places[by], key[by]
            order[at] = places
            fresh = np.ones(len(at), bool)
            fresh[1:] = key[1:] != key[:-1]
            rank[places] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
            common[at[~fresh]] = depth
            reached = depth
        return order, common

    def _common(self, words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, whose ``known`` first symbols are common."""
        out = known.copy()
        live = np.arange(len(a))
        while len(live):
            apart = words[a[live] + out[live]] ^ words[b[live] + out[live]]
            some = apart != 0
            # the symbols before the first that differs: the exponent of a float has the highest bit
            out[live[some]] += (self.bits * self.width - 1 - _high_bit(apart[some])) // self.bits
            live = live[~some]
            out[live] += self.width
            live = live[out[live] < self.depth]
        return np.minimum(out, self.depth)

    def matching_statistics(self) -> np.ndarray:
        """For each place of the text, the longest match that starts elsewhere (up to ``depth``)."""
        value = np.zeros(self.n, np.int64)
        np.maximum.at(value, self.sample_at, self.sample)
        places = np.arange(self.n)
        return np.maximum.accumulate(value + places) - places


def _high_bit(x: np.ndarray) -> np.ndarray:
    """Place of the highest bit that is set, of values that aren't 0."""
    high = x >> np.uint64(32)
    upper = high != 0
    return np.frexp(np.where(upper, high, x).astype(np.float64))[1] - 1 + 32 * upper


_CONTEXTS = "h long, d1 long, d2 long, n long, size long, data binary"
_MARKS = "d1 long, d2 long, marks array<struct<a:long,b:long>>"


def _contexts(sources: DataFrame, need: DataFrame) -> DataFrame:
    """``need`` (s1, s2, a, b, h, d1, d2, n, size) with the bytes [a, b) of its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # rows that repeat a source give its bytes once
        for batch in batches:
            needs, datas = batch.column(3), batch.column(2)
            flat, at = needs.values, needs.offsets.to_pylist()
            a, b = (flat.field(x).to_numpy() for x in ("a", "b"))
            out, places = [], []
            for key, data, x, y in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), datas, at, at[1:]):
                if key not in seen:
                    seen.add(key)
                    view = memoryview(data.as_buffer())
                    out += [view[p:q].tobytes() for p, q in zip(a[x:y].tolist(), b[x:y].tolist())]
                    places += range(x, y)
            own = flat.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.field(x) for x in ("h", "d1", "d2", "n", "size")), pa.array(out, pa.binary())], names=["h", "d1", "d2", "n", "size", "data"])

    grouped = need.groupBy("s1", "s2").agg(F.collect_list(F.struct("a", "b", "h", "d1", "d2", "n", "size")).alias("need"))
    return sources.join(grouped.hint("shuffle_hash"), ["s1", "s2"]).select("s1", "s2", "data", "need").mapInArrow(trimmed(run), _CONTEXTS)


def _word_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, paired: bool) -> np.ndarray:
    """A number for each two neighbouring words and what stands between them, or for each word; equal for
    equal bytes."""
    borders = np.empty(2 * len(starts), np.int64)
    borders[0::2], borders[1::2] = starts, ends
    pieces = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(data)])
    ids = pieces.dictionary_encode().indices.to_numpy().astype(np.int64)
    if not paired:
        return np.unique(ids[0::2], return_inverse=True)[1]
    left = np.unique(ids[0:-1:2] << 32 | ids[1::2], return_inverse=True)[1]
    return np.unique(left << 32 | ids[2::2], return_inverse=True)[1]


def repeated_windows(strings: list[np.ndarray], counts: list[int], length: int, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of strings and how often they occur: string, begin and end (from the string's begin) of each window
    that occurs elsewhere in them."""
    data, at = np.concatenate(strings), np.concatenate([[0], np.cumsum(list(map(len, strings)))])
    starts, ends, sizes = units_of(data, at, words)
    offsets, n = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
    of = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    window = place + offsets[of]
    wanted = length
    if words:
        # a window of words is one of pairs of neighbouring words, which are the symbols of the index
        wanted = max(length - 1, 1)
        pairs = _word_pairs(data, starts, ends, length > 1)
        strings = [pairs[x : x + k + wanted - length] for x, k in zip(offsets.tolist(), sizes.tolist())]
    index = RunLengthIndex(strings, counts, wanted, wanted)
    ok = index.matching_statistics()[index.begins[of] + place] >= wanted
    return of[ok], (starts[window] - at[of])[ok], (ends[window + length - 1] - at[of])[ok]


def _indexed(contexts: DataFrame, searches: list[Search]) -> DataFrame:
    """Contexts -> _MARKS: byte ranges, from a context's begin, that repeat among those of its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, 0

        def out() -> pa.RecordBatch:
            length, _, words = searches[last & 1]
            of, begins, ends = repeated_windows([np.frombuffer(x[3].as_buffer(), np.uint8) for x in held], [x[2] for x in held], length, words)
            froms, tos, of = merged(of, begins, ends)
            some = np.unique(of)
            lists = _range_lists(np.searchsorted(some, of), froms, tos, len(some))
            return pa.RecordBatch.from_arrays([*(pa.array([held[i][k] for i in some], pa.int64()) for k in (0, 1)), lists], names=["d1", "d2", "marks"])

        for batch in batches:
            for h, d1, d2, n, data in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(5)):
                if held and h != last and (size >= INDEX << 2 * searches[last & 1][2] or (h ^ last) & 1):  # a key's runs stay together
                    yield out()
                    held, size = [], 0
                last = h
                held.append((d1, d2, n, data))
                size += len(data.as_buffer())
        if held:
            yield out()

    return contexts.repartition("h").sortWithinPartitions(F.col("h").bitwiseAND(1), "h").mapInArrow(trimmed(run), _MARKS)


def _repeated(scan: DataFrame, dealt: DataFrame, searches: list[Search], level: int = 0) -> DataFrame:
    """Sources (s1, s2, w, data) -> s1, s2 and _names(searches), a row for each source: what repeated
    windows cover. ``dealt`` are s1, s2, data of ``scan``."""
    cut = materialise(runs(scan, searches, level), "runs")
    anchors = cut.groupBy("h").agg(F.sum("n").alias("_n")).where("_n > 1").select("h")
    shared = materialise(cut.join(anchors.hint("shuffle_hash"), "h", "left_semi"), "shared-runs")
    discard(cut)
    contents = materialise(shared.groupBy("h", "d1", "d2").agg(F.sum("n").alias("n"), *(F.first(x).alias(x) for x in ("s1", "s2", "a", "b"))), "contents")
    sizes = contents.groupBy("h").agg(F.sum(F.col("b") - F.col("a")).alias("size"))
    contexts = _contexts(dealt, contents.join(sizes, "h"))
    if level + 1 == len(LEVELS) or sizes.where(F.col("size") > HOT).isEmpty():
        marks = materialise(_indexed(contexts, searches), "marks")
    else:
        contexts = materialise(contexts, "contexts")
        again = contexts.where(F.col("size") > HOT).select(F.col("d1").alias("s1"), F.col("d2").alias("s2"), F.col("n").alias("w"), "data")
        finer = _repeated(again, again.drop("w"), searches, level + 1)
        # a run belongs to one search
        finer = finer.select(F.col("s1").alias("d1"), F.col("s2").alias("d2"), F.concat(*_names(searches)).alias("marks"))
        marks = materialise(_indexed(contexts.where(F.col("size") <= HOT), searches).unionByName(finer), "marks")
        discard(contexts)
    discard(contents)
    # a run that occurs twice in one text is repeated as a whole, at all its places
    places = F.coalesce("more", F.transform("marks", lambda m: F.struct((m["a"] + F.col("a")).alias("a"), (m["b"] + F.col("a")).alias("b"))))
    found = shared.join(marks, ["d1", "d2"]).select("s1", "s2", F.col("d1").bitwiseAND(1).alias("number"), places.alias("ranges"))
    # rows that repeat a source have given the same ranges
    lists = [F.flatten(F.collect_set(F.when(F.col("number") == i, F.col("ranges")))).alias(x) for i, x in enumerate(_names(searches))]
    spans = materialise(found.groupBy("s1", "s2").agg(*lists), "spans")
    discard(shared)
    discard(marks)
    return spans


def _names(searches: list[Search]) -> list[str]:
    return ["ranges", "passages"][: len(searches)]


def _keys() -> dict[str, Column]:
    """Two numbers that tell rows apart by doc_id and text; s2 is odd where doc_id is null."""
    none = F.col("doc_id").isNull().cast("long")
    return {"s1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "s2": F.shiftleft(F.xxhash64(F.coalesce("text", F.lit(""))), 1).bitwiseOR(none)}


def keyed_rows(docs: DataFrame) -> DataFrame:
    """s1, s2, data: the rows by a key that also tells rows with the same doc_id apart."""
    keys = _keys()
    return docs.select(keys["s1"].alias("s1"), keys["s2"].alias("s2"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))


def _search(length: int, words: bool, gram: int | None = None) -> Search:
    return length, gram or max(1, length * 8 // 25), words


def _all_repeated(docs: DataFrame, dealt: DataFrame, searches: list[Search]) -> DataFrame:
    small_batches(docs.sparkSession)
    return _repeated(keyed_rows(docs).withColumn("w", F.lit(1).cast("long")), dealt, searches)


def repeated_ranges(docs: DataFrame, dealt: DataFrame, length: int = LENGTH, gram: int | None = None, words: bool = False) -> DataFrame:
    """s1, s2, ranges: half-open ranges of bytes that repeated windows of ``length`` bytes, or words, cover;
    one row for each row of ``docs`` that has any. ``dealt``: keyed_rows(docs), dealt by s1 and s2."""
    return _all_repeated(docs, dealt, [_search(length, words, gram)])


def _kept(data: np.ndarray, ranges: list | None) -> tuple[bytes, int, int]:
    """What is left, and the number of spans and of bytes that went."""
    if not ranges:
        return data.tobytes(), 0, 0
    a, b = np.array([[x["a"], x["b"]] for x in ranges], np.int64).T
    froms, tos, _ = merged(np.zeros(len(a), np.int64), a, b)
    keep = np.ones(len(data), bool)
    for x, y in zip(froms, tos):
        keep[x:y] = False
    return data[keep].tobytes(), len(froms), int((tos - froms).sum())


def removals(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 for strings of
    ``length`` bytes; n_passages and passage_bytes, the spans and bytes that repeated passages of
    ``passage`` words cover (nothing is removed for these)."""
    dealt = keyed_rows(docs).repartition("s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = B.utf8(batch.column(1))
            of, froms, tos, spans, gone = _spans(batch.column(2))
            marked = _spans(batch.column(3))[3:]
            columns = [np.diff(at), gone, spans, *marked]
            hashes = _hashes_without(data, at, of, froms, tos)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(hashes, pa.string())], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "n_passages", "passage_bytes", "kept_sha256"]
    found = _all_repeated(docs, dealt, [_search(length, False), _search(passage, True)]).hint("shuffle_hash")
    joined = dealt.join(found, ["s1", "s2"], "left").select(F.when(F.col("s2").bitwiseAND(1) == 0, F.col("s1")).alias("doc_id"), "data", "ranges", "passages")
    out = joined.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, n_passages long, passage_bytes long, kept_sha256 string")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")


def _spans(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """Lists of ranges, a row each -> row, begin and end of their unions; number and bytes of these by row."""
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    froms, tos, of = merged(rows, flat.field("a").to_numpy(), flat.field("b").to_numpy())
    at = np.searchsorted(of, np.arange(len(lists) + 1))
    return of, froms, tos, np.diff(at), np.diff(np.concatenate([[0], np.cumsum(tos - froms)])[at])


def _hashes_without(data: np.ndarray, at: np.ndarray, of: np.ndarray, froms: np.ndarray, tos: np.ndarray) -> list[str]:
    """SHA-256 of each text data[at[i]:at[i + 1]] without its ranges."""
    view = memoryview(np.ascontiguousarray(data))
    cuts = np.searchsorted(of, np.arange(len(at))).tolist()
    froms, tos, at = (froms + at[of]).tolist(), (tos + at[of]).tolist(), at.tolist()
    out = []
    for begin, end, x, y in zip(at, at[1:], cuts, cuts[1:]):
        left = hashlib.sha256()
        for a, b in zip([begin, *tos[x:y]], [*froms[x:y], end]):
            left.update(view[a:b])
        out.append(left.hexdigest())
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH, words: bool = False) -> DataFrame:
    """``docs`` with what repeats (windows of ``length`` bytes, or of so many words) cut out of ``text``;
    ``n_chars``, if there, follows. A character that a cut goes through is cut out whole. Rows stay,
    those left without text too."""
    spans = repeated_ranges(docs, keyed_rows(docs).repartition("s1", "s2"), length, words=words)
    names, text_at = docs.columns, docs.columns.index("text")
    kind = dict(docs.dtypes)["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column(text_at), batch.column(batch.num_columns - 1)):
                own = ranges.as_py()
                texts.append(text.as_py() if not own else _kept(np.frombuffer(text.as_buffer(), np.uint8), own)[0].decode(errors="ignore"))
            columns = [pa.array(texts, batch.schema.field(text_at).type) if i == text_at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    one, two, own_ranges = (fresh(docs, x) for x in ("_s1", "_s2", "_ranges"))
    keys = _keys()
    rows = docs.withColumns({one: keys["s1"], two: keys["s2"]})
    found = spans.select(F.col("s1").alias(one), F.col("s2").alias(two), F.col("ranges").alias(own_ranges))
    out = rows.join(found.hint("shuffle_hash"), [one, two], "left").select(*names, own_ranges).mapInArrow(trimmed(run), docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns and kind == "string" else out
