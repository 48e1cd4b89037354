"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model at hand merges greedily by score (BPE). Its encoding is also the one best path through the
lattice of all pieces that match the text, if a step from piece a to piece b weighs 0 where the
merges turn a + b into exactly [a, b] and minus infinity elsewhere: the merges cross no border of the
result, hence none of any two neighbours, and the other way round. So the encoding is a max-plus
problem whose states are the pieces, and it can be scanned in parallel.

Every text is cut into chunks of CHUNK characters, anywhere. The state at a cut is the piece that
holds the character before it. Each chunk gives, for itself alone, the matrix from the states at its
begin to those at its end; with weights 0 and minus infinity a row is a set of states, kept as bits.
The matrices are combined in a tree - the product is associative - and from the tree's root down each
cut gets its state on the feasible path. Given its two states, each chunk is traced back for itself.
Where no piece has a certain pair of characters inside, every path has a border (before a word,
mostly): the matrix is of rank one there, and what stands between two such borders is encoded once
and remembered. Segments that a batch doesn't know are merged all at once.

A text longer than ``chunk`` characters is spread over tasks: each of its parts is scanned as a text
is, up to the root of its tree, and the parts' roots are combined the same way.

Ids equal those of the sentencepiece library. Decoding gives the text back, but for U+2581, which the
model reads as a space.

Defined cases: a null or empty text has no ids and decodes to the empty text; characters outside the
vocabulary become their UTF-8 bytes' pieces; repeated rows are separate rows; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import materialise, small_batches, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, and of the part of a text that one task scans.
CHUNK, SPREAD = 1 << 12, 1 << 16
SPACE = "▁"
#: Segments of a generation that a worker remembers (it keeps two), and the longest that it does.
REMEMBERED, SHORT = 200_000, 48
#: Segments that are merged at once: their arrays stay in a core's cache.
AT_ONCE = 4096


class Segments(NamedTuple):
    """Certain borders of a text, its begin and end included, and the ids of what stands between them."""

    borders: list[int]
    ids: list[tuple[int, ...]]


class Chunk(NamedTuple):
    """States at a chunk's ends, the matrix between them, and the lattices at its ends."""

    entry: list[tuple[int, int]]
    leave: list[tuple[int, int]]
    matrix: list[int]
    head: tuple[dict, dict]
    tail: tuple[dict, dict] | None


class Pieces:
    """A SentencePiece BPE model with byte fallback, no normalisation and a dummy prefix."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.text: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.text.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.text.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # a border before each space that follows another character, if no piece has that inside; and
        # around characters that no piece has beside others
        alone = re.escape("".join(x for x in "\n\r\t" if not any(x in pair for pair in inside)))
        words = rf"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" if not any(a != SPACE and b == SPACE for a, b in inside) else rf"[^{alone}]+" if alone else r"(?s:.+)"
        self.segment = re.compile(rf"[{alone}]|{words}" if alone else words)
        self._pair_tables()
        self._fits: dict[tuple[str, str], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _pair_tables(self) -> None:
        """Which pairs of pieces make a piece, as sorted numbers, with the piece and its score; and the
        piece that each character is."""
        pairs = sorted((self.ids[p[:k]] * len(self.text) + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self._pairs, self._joined = (np.array(x, np.int64) for x in zip(*[*pairs, (1 << 62, 0)]))
        self._scores = np.full(len(self.text), -np.inf)
        self._scores[list(self.ids.values())] = [self.scores[p] for p in self.ids]
        self._chars = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self._chars[ord(p)] = i

    def merge_all(self, segments: list[str]) -> list[tuple[int, ...]]:
        """What ``merge`` gives for each, as ids: in each step all segments make their best merge."""
        pieces = self._chars[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        of = np.repeat(np.arange(len(segments)), list(map(len, segments)))
        known = np.ones(len(segments), bool)
        known[of[pieces < 0]] = False  # a character that is no piece
        pieces, of = pieces[known[of]], of[known[of]]
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def scored(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """What the places i and i + 1 make, and how good it is."""
            j = np.minimum(i + 1, len(pieces) - 1)
            key = pieces[i] * len(self.text) + pieces[j]
            at = np.searchsorted(self._pairs, key)
            makes = np.where((self._pairs[at] == key) & (of[i] == of[j]) & (i < j), self._joined[at], -1)
            return makes, np.where(makes >= 0, self._scores[makes], -np.inf)

        makes, score = scored(np.arange(len(pieces)))
        while len(pieces):
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sizes = np.diff(np.concatenate([begins, [len(of)]]))
            best = np.repeat(np.maximum.reduceat(score, begins), sizes)
            live = best > -np.inf
            hits = np.flatnonzero(live & (score == best))
            first = np.ones(len(hits), bool)
            first[1:] = of[hits[1:]] != of[hits[:-1]]
            hits = hits[first]  # the leftmost of equals
            pieces[hits] = makes[hits]
            keep = np.ones(len(pieces), bool)
            keep[hits + 1] = False
            done.append((of[~live], pieces[~live]))
            keep &= live
            shift = np.cumsum(~keep)
            hits = hits - shift[hits]
            pieces, of, makes, score = pieces[keep], of[keep], makes[keep], score[keep]
            for changed in (hits, hits[hits > 0] - 1):
                makes[changed], score[changed] = scored(changed)
        of, pieces = (np.concatenate(x) for x in zip(*done)) if done else (of, pieces)
        order = np.argsort(of, kind="stable")
        flat, at = pieces[order].tolist(), np.searchsorted(of[order], np.arange(len(segments) + 1)).tolist()
        return [tuple(flat[x:y]) if ok else tuple(self.piece_ids(self.merge(s))) for s, x, y, ok in zip(segments, at, at[1:], known.tolist())]

    def learn(self, segments: set[str]) -> None:
        """Remember what these segments encode to. Those of the older generation that are met again move
        to the newer one, so frequent ones stay when the newer becomes the older."""
        new = segments - self._known.keys()
        if len(self._known) + len(new) > REMEMBERED:
            self._known, self._older, new = {}, self._known, segments
        older = self._older
        self._known.update((s, older[s]) for s in new if s in older)
        new = [s for s in new if s not in older and len(s) <= SHORT]
        for i in range(0, len(new), AT_ONCE):
            self._known.update(zip(new[i : i + AT_ONCE], self.merge_all(new[i : i + AT_ONCE])))

    def merge(self, text: str) -> list[str]:
        """The greedy merges: best score first, leftmost of equals."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) != none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether b may follow a: the weight of the step is 0."""
        if (a, b) not in self._fits:
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            self._fits[a, b] = self.merge(a + b) == [a, b]
        return self._fits[a, b]

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in p.encode())
        return out

    def matches(self, text: str, at: int, limit: int) -> list[int]:
        """Ends, up to a limit, of the pieces that match at a place; a character of its own always does."""
        ids = self.ids
        return [at + 1, *[e for e in range(at + 2, min(limit, at + self.longest) + 1) if text[at:e] in ids]]

    def encode_segment(self, text: str) -> tuple[int, ...]:
        """Ids of what stands between two borders."""
        ids = self._known.get(text)
        if ids is None:
            ids = self._older.get(text) or tuple(self.piece_ids(self.merge(text) if len(text) <= SHORT else self.best_path(text)))
        return ids

    def segmented(self, text: str, found: list[str] | None = None) -> Segments:
        """A text's borders and what stands between them, encoded."""
        found = found or self.segment.findall(text)
        ids = list(map(self._known.get, found))
        if None in ids:
            ids = [self.encode_segment(s) if x is None else x for s, x in zip(found, ids)]
        return Segments([0, *accumulate(map(len, found))], ids)

    def best_path(self, text: str) -> list[str]:
        """The feasible path over a whole text."""
        lattice = self.forward(text, [(0, 0)], 0, len(text), len(text))
        return self._between(text, lattice, 1, *lattice[0][len(text)])

    def forward(self, text: str, states: list[tuple[int, int]], begin: int, end: int, limit: int) -> tuple[dict, dict]:
        """From states (pieces as spans; (begin, begin) stands for the text's begin), the set of
        states, as bits, from which each piece that begins in [begin, end) is reached, by the
        piece's end; and for each piece the pieces before it on feasible paths. limit: a border at or
        after the end."""
        reach: dict[int, dict[tuple[int, int], int]] = {}
        came: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, s in enumerate(states):
            reach.setdefault(s[1], {})[s] = reach.get(s[1], {}).get(s, 0) | 1 << i
        for at in range(begin, end):
            if at not in reach:
                continue
            before = [(s, text[s[0] : s[1]], bits) for s, bits in reach[at].items()]
            for e in self.matches(text, at, limit):
                piece, bits = text[at:e], 0
                for s, p, b in before:
                    if not p or self.fits(p, piece):
                        bits |= b
                        came.setdefault((at, e), []).append(s)
                if bits:
                    reach.setdefault(e, {})[at, e] = bits
        return reach, came

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        own = [marked(t) for t in texts]
        found = list(map(self.segment.findall, own))
        self.learn(set(chain.from_iterable(found)))
        return [self.trace(x, 0, len(x), (0, 0), None, self.segmented(x, f)) if x else [] for x, f in zip(own, found)]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.text.__getitem__, ids)).decode(errors="replace")
        return out[1:] if out[:1] == " " else out

    # -- chunks. A part of a long text is given with ``longest`` characters of what stands before and after.

    def states_at(self, text: str, cut: int, borders: list[int]) -> list[tuple[int, int]]:
        """Pieces that hold the character before the cut, as spans of ``text``. None goes over a border."""
        if cut == 0:
            return [(0, 0)]
        k = bisect_left(borders, cut)
        begin, end = max(borders[k - 1], cut - self.longest), borders[k]
        return [(s, e) for s in range(begin, cut) for e in self.matches(text, s, end) if e >= cut]

    def transfer(self, text: str, begin: int, end: int, borders: list[int] | None = None, entry: list | None = None, leave: list | None = None) -> Chunk:
        """States at begin, states at end, and for each of the latter the former it is reached from; and
        the lattices up to the first border inside and from the last one on."""
        borders = borders or self.segmented(text).borders
        entry, leave = entry or self.states_at(text, begin, borders), leave or self.states_at(text, end, borders)
        i, j, after = bisect_left(borders, begin), bisect_left(borders, end) - 1, borders[bisect_left(borders, end)]
        if i > j:  # no border inside: one lattice from end to end
            head = self.forward(text, entry, begin, end, after)
            return Chunk(entry, leave, [head[0].get(x[1], {}).get(x, 0) for x in leave], head, None)
        first, last, ins = borders[i], borders[j], 0
        head = self.forward(text, entry, begin, first, first)
        for bits in head[0].get(first, {}).values():
            ins |= bits
        tail = self.forward(text, [(last, last)], last, end, after)
        return Chunk(entry, leave, [ins if tail[0].get(x[1], {}).get(x, 0) else 0 for x in leave], head, tail)

    def leaves(self, text: str, begin: int, end: int, borders: list[int]) -> list[Chunk]:
        """The matrices of the chunks of a part, with the states at their ends."""
        cuts = [*range(begin, end, CHUNK), end]
        states = [self.states_at(text, x, borders) for x in cuts]
        return [self.transfer(text, a, b, borders, x, y) for a, b, x, y in zip(cuts, cuts[1:], states, states[1:])]

    def trace(self, text: str, begin: int, end: int, enter: tuple[int, int], leave: tuple[int, int] | None, segments: Segments | None = None) -> list[int]:
        """Ids of the pieces that begin in a part, given its states at both ends (at a text's end None)."""
        segments = segments or self.segmented(text)
        chunks = self.leaves(text, begin, end, segments.borders)
        out: list[int] = []
        for a, chunk, (x, y) in zip(range(begin, end, CHUNK), chunks, states_between(chunks, enter, leave or end)):
            out += self.trace_chunk(text, a, min(a + CHUNK, end), x, y, segments, chunk)
        return out

    def trace_chunk(self, text: str, begin: int, end: int, enter: tuple[int, int], leave: tuple[int, int], segments: Segments | None = None, chunk: Chunk | None = None) -> list[int]:
        """Ids of the pieces that begin in the chunk, given its states at both ends."""
        borders, ids = segments = segments or self.segmented(text)
        chunk = chunk or self.transfer(text, begin, end, borders)
        i, j, bit = bisect_left(borders, begin), bisect_left(borders, end) - 1, 1 << chunk.entry.index(enter)
        if i > j:
            return self.piece_ids(self._between(text, chunk.head, bit, leave))
        out: list[int] = []
        if enter[1] != borders[i]:
            (tail,) = [x for x, bits in chunk.head[0][borders[i]].items() if bits & bit]
            out = self.piece_ids(self._between(text, chunk.head, bit, tail))
        if leave[1] == end == borders[j + 1]:  # the last segment ends with the chunk
            out.extend(chain.from_iterable(ids[i : j + 1]))
            return out
        out.extend(chain.from_iterable(ids[i:j]))
        return out + self.piece_ids(self._between(text, chunk.tail, 1, leave))

    def _between(self, text: str, lattice: tuple[dict, dict], bit: int, leave: tuple[int, int]) -> list[str]:
        """The pieces up to ``leave`` after the state that the bit stands for."""
        reach, came = lattice
        out, at = [], leave
        while at in came:
            out.append(text[at[0] : at[1]])
            at = next(x for x in came[at] if reach[x[1]][x] & bit)
        return out[::-1]


_loaded: dict[bytes, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def id_lists(ids: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a column, by way of one flat list; a null one is empty."""
    flat = ids.values.to_numpy(zero_copy_only=False).tolist()
    at = ids.offsets.to_numpy().tolist()
    return (flat[a:b] for a, b in zip(at, at[1:]))


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def combine(a: list[int], b: list[int]) -> list[int]:
    """The max-plus product of two matrices with weights 0 and minus infinity: a[j] has the rows i,
    as bits, from which column j is reached."""
    out = []
    for bits in b:
        joined = 0
        while bits:
            low = bits & -bits
            joined |= a[low.bit_length() - 1]
            bits ^= low
        out.append(joined)
    return out


def tree_of(leaves: list[list[int]]) -> list[list[list[int]]]:
    """The matrices level by level, each the product of two of the level before, up to that of all."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([combine(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    return levels


def states_between(matrices: list[tuple[list, list, list[int]]], enter: tuple[int, int], leave: tuple[int, int] | int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """For each chunk the states at its begin and end on the feasible path from a state to another, or to
    any that ends there. matrices: (states at begin, states at end, matrix) in order."""
    levels = tree_of([x[2] for x in matrices])
    i = matrices[0][0].index(enter)
    last, root = matrices[-1][1], levels[-1][0]
    (j,) = [j for j, s in enumerate(last) if (s == leave or s[1] == leave) and root[j] >> i & 1]
    ends = [(i, j)]
    for below in levels[-2::-1]:  # what a product's two ends say of its factors
        halves = []
        for k, (i, j) in enumerate(ends):
            if 2 * k + 1 == len(below):
                halves.append((i, j))
                continue
            left, right = below[2 * k], below[2 * k + 1]
            middle = next(m for m, bits in enumerate(left) if bits >> i & 1 and right[j] >> m & 1)
            halves += [(i, middle), (middle, j)]
        ends = halves
    return [(entry[i], leave[j]) for (entry, leave, *_), (i, j) in zip(matrices, ends)]


def states_on_path(matrices: list[tuple[list, list, list[int]]], n_chars: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """``states_between`` over a whole text."""
    return states_between(matrices, (0, 0), n_chars)


def marked(text: str) -> str:
    """As the model reads a text; an empty one stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _long_texts(docs: DataFrame, model, chunk: int) -> DataFrame:
    """id, th, ids of the texts longer than what one task scans; rows (id, th) once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = pieces_of(model.value).longest
        for b in batches:
            for i, th, text in zip(*(c.to_pylist() for c in b.columns)):
                own = marked(text)
                for k, at in enumerate(range(0, len(own), chunk)):
                    low = max(0, at - around)
                    yield pa.RecordBatch.from_pylist([{"id": i, "th": th, "k": k, "low": low, "begin": at, "end": min(len(own), at + chunk), "n": len(own), "part": own[low : at + chunk + around]}])

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.value)
        schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("entry", pa.list_(pa.list_(pa.int64()))), ("leave", pa.list_(pa.list_(pa.int64()))), ("matrix", pa.list_(pa.string()))])
        for b in batches:
            for r in b.to_pylist():
                leaves = pieces.leaves(r["part"], r["begin"] - r["low"], r["end"] - r["low"], pieces.segmented(r["part"]).borders)
                entry, leave, (matrix,) = leaves[0][0], leaves[-1][1], tree_of([x.matrix for x in leaves])[-1]
                spans = [[[s + r["low"], e + r["low"]] for s, e in x] for x in (entry, leave)]
                yield pa.RecordBatch.from_pylist([{"id": r["id"], "th": r["th"], "k": r["k"], "n": r["n"], "entry": spans[0], "leave": spans[1], "matrix": [hex(x) for x in matrix]}], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, th, rows in zip(*(c.to_pylist() for c in b.columns)):
                rows.sort(key=lambda r: r["k"])
                path = states_on_path([([*map(tuple, r["entry"])], [*map(tuple, r["leave"])], [int(x, 16) for x in r["matrix"]]) for r in rows], rows[0]["n"])
                yield pa.RecordBatch.from_pylist([{"id": i, "th": th, "k": r["k"], "enter": list(x), "leave": list(y)} for r, (x, y) in zip(rows, path)])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.value)
        schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("k", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for b in batches:
            for r in b.to_pylist():
                low = r["low"]
                pieces.learn(set(pieces.segment.findall(r["part"])))
                ids = pieces.trace(r["part"], r["begin"] - low, r["end"] - low, tuple(x - low for x in r["enter"]), tuple(x - low for x in r["leave"]))
                yield pa.RecordBatch.from_pylist([{"id": r["id"], "th": r["th"], "k": r["k"], "ids": ids}], schema)

    chunks = materialise(docs.dropDuplicates(["id", "th"]).mapInArrow(trimmed(split), "id long, th long, k long, low long, begin long, end long, n long, part string"), "chunks")
    matrices = chunks.repartition("id", "th", "k").mapInArrow(trimmed(transfer), "id long, th long, k long, n long, entry array<array<long>>, leave array<array<long>>, matrix array<string>")
    path = matrices.groupBy("id", "th").agg(F.collect_list(F.struct("k", "n", "entry", "leave", "matrix")).alias("rows")).mapInArrow(trimmed(scan), "id long, th long, k long, enter array<long>, leave array<long>")
    traced = chunks.join(path, ["id", "th", "k"]).mapInArrow(trimmed(trace), "id long, th long, k long, ids array<int>")
    return traced.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts")).select("id", "th", F.flatten("parts.ids").alias("ids"))


def _long_ids(rows: DataFrame, model, chunk: int) -> DataFrame:
    """doc_id, ids of each row longer than a chunk; th is odd where doc_id is null."""
    none = F.col("doc_id").isNull().cast("long")
    long = rows.where(F.length("text") > chunk).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.shiftleft(F.xxhash64("text"), 1).bitwiseOR(none).alias("th"), "text")
    found = long.select("id", "th").join(_long_texts(long, model, chunk), ["id", "th"])
    return found.select(F.when(F.col("th").bitwiseAND(1) == 0, F.col("id")).alias("doc_id"), "ids")


def encode(docs: DataFrame, model_path: str = MODEL, chunk: int = SPREAD) -> DataFrame:
    """doc_id and ids of each row. The model's file, half a megabyte whatever the input, is read by
    the driver and broadcast."""
    return encode_and_check(docs, model_path, chunk).select("doc_id", "ids")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids decode to the empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(x) for x in id_lists(b.column(1))], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, text string")


def encode_and_check(docs: DataFrame, model_path: str = MODEL, chunk: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_chars, decoded_sha256: the encoding, and a digest of what it
    decodes to. Texts of up to ``chunk`` characters are encoded and decoded in one step."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(read_model(model_path))
    names = ["doc_id", "ids", "decoded_sha256", "decoded_chars"]

    def results(pieces: Pieces, row_ids: pa.Array, ids: pa.Array, lists: Iterator[list[int]]) -> pa.RecordBatch:
        texts = [pieces.decode(x) for x in lists]
        return pa.RecordBatch.from_arrays([row_ids, ids, pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.value)
        for b in batches:
            lists = pieces.encode_texts(b.column(1).to_pylist())
            yield results(pieces, b.column(0), pa.array(lists, pa.list_(pa.int32())), iter(lists))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.value)
        for b in batches:
            yield results(pieces, b.column(0), b.column(1), id_lists(b.column(1)))

    rows, schema = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "doc_id long, ids array<int>, decoded_sha256 string, decoded_chars long"
    short = rows.where(F.length("text") <= chunk).mapInArrow(trimmed(whole), schema)
    both = short.unionByName(_long_ids(rows, model, chunk).mapInArrow(trimmed(scanned), schema))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "decoded_chars", "decoded_sha256", "ids")
