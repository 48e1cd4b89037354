"""Exact dedup by tries of whole texts.

Texts are equal when their UTF-8 bytes are, after lower-casing A-Z only. Each task puts the texts it
reads into a Patricia trie, a radix tree whose edges are byte strings and whose terminal nodes hold
the number of rows and the owner: the largest (or smallest) doc_id. A trie over its budget spills its
largest subtrees as rows, one for each terminal. These go to partitions by length and content hash,
sorted by text; there a trie takes them in order, so that all but the path of the last text is final
and leaves whenever the budget is reached. A task holds the budget, one Arrow batch and one text.

A text that fills a third of all rows costs a row for each task that read it, not one for each copy;
texts that a task saw twice or more are first merged in SALTS parts, so no partition gets more than
SALTS rows of a crowded text and those of the tasks that saw it once. Documents find their
terminal by length and SHA-256; of the terminals at most CROWDED hold one in CROWDED of all rows,
and theirs are dealt by doc_id, each part meeting a copy of the terminal.

Defined cases: a null text is empty, equal to other empty ones; a null doc_id is smaller than any
(with ``keep="smallest"`` larger), so it owns only texts that no other row has; of rows that repeat
doc_id and text one stays, by a hash of their other columns; an empty table gives an empty result;
other columns, whatever their names, are carried along by ``deduplicated`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.llm.common import materialise, small_batches, trimmed

#: Bytes that a trie holds, and what a node counts besides its edge.
BUDGET, NODE = 16 << 20, 200
#: Parts in which texts that a task saw twice are merged first.
SALTS = 64
#: A text with one in so many of all rows is crowded; so at most so many are.
CROWDED = 4096
#: Bytes of texts in a batch that a task gives out.
OUT = 4 << 20
#: A trie's rows: length in bytes, SHA-256, text, number of rows, owner, number of rows with that owner.
ENTRY = "n long, sha binary, text binary, rows long, owner long, ties long"


def normalised(text: str | None) -> bytes:
    """bytes.lower changes A-Z alone."""
    return (text or "").encode().lower()


class Node:
    __slots__ = ("edge", "kids", "rows", "owner", "ties")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.kids, self.rows, self.owner, self.ties = edge, None, 0, None, 0


def _common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of an edge and of what follows in a key."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if edge[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Whole byte strings, edges compressed; ``largest`` tells which doc_id owns a string."""

    def __init__(self, largest: bool) -> None:
        self.largest, self.root, self.size = largest, Node(b""), 0

    def _grown(self, edge: bytes) -> Node:
        self.size += len(edge) + NODE
        return Node(edge)

    def add(self, key: bytes, rows: int, owner: int | None, ties: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            if node.kids is None:
                node.kids = {}
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = self._grown(key[at:])
                at = len(key)
            elif key.startswith(kid.edge, at):
                at += len(kid.edge)
            else:  # the edge is split where the key leaves it
                n = _common(kid.edge, key, at)
                mid = node.kids[key[at]] = Node(kid.edge[:n])
                self.size += NODE
                kid.edge = kid.edge[n:]
                mid.kids = {kid.edge[0]: kid}
                kid, at = mid, at + n
            node = kid
        if not node.rows or self._before(owner, node.owner):
            node.owner, node.ties = owner, ties
        elif owner == node.owner:
            node.ties += ties
        node.rows += rows

    def _before(self, one: int | None, other: int | None) -> bool:
        """Whether ``one`` owns a string rather than ``other``."""
        if one is None or other is None:
            return other is None and one is not None
        return one > other if self.largest else one < other

    @staticmethod
    def terminals(node: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, int, int | None, int]]:
        """Strings of a subtree with their values. No recursion: a string may be a prefix of the next, and so on."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.edge
            if node.rows:
                yield whole, node.rows, node.owner, node.ties
            stack += [(kid, whole) for kid in (node.kids or {}).values()]

    @staticmethod
    def weight(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.edge) + NODE
            stack += (node.kids or {}).values()
        return total

    def spill(self) -> Iterator[tuple[bytes, int, int | None, int]]:
        """The largest subtrees below the root, until half of the budget is left."""
        by_size = sorted(((self.weight(kid), first) for first, kid in (self.root.kids or {}).items()), reverse=True)
        for size, first in by_size:
            if self.size <= BUDGET // 2:
                break
            yield from self.terminals(self.root.kids.pop(first))
            self.size -= size

    def closed(self, last: bytes) -> Iterator[tuple[bytes, int, int | None, int]]:
        """All strings but ``last``, which alone stays: of sorted strings the others won't come again."""
        again = None
        for entry in self.terminals(self.root):
            if entry[0] == last:
                again = entry
            else:
                yield entry
        self.root, self.size = Node(b""), 0
        if again:
            self.add(*again)


def _batches(entries: Iterator[tuple[bytes, int, int | None, int]], with_text: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        text, counts, owner, ties = zip(*rows)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        columns = ([len(t) for t in text], [hashlib.sha256(t).digest() for t in text], text if with_text else [None] * len(rows), counts, owner, ties)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["n", "sha", "text", "rows", "owner", "ties"])

    for entry in entries:
        rows.append(entry)
        size += len(entry[0]) + NODE
        if size > OUT:
            yield out()
            rows, size = [], 0
    if rows:
        yield out()


def _read(docs: DataFrame, largest: bool) -> DataFrame:
    """The entries of each task's trie over what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            trie = Trie(largest)
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    trie.add(normalised(text.as_py()), 1, doc_id, 1)
                    if trie.size > BUDGET:
                        yield from trie.spill()
            yield from trie.terminals(trie.root)

        return _batches(entries(), True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), ENTRY)


def _merged(entries: DataFrame, keys: list, largest: bool, with_text: bool) -> DataFrame:
    """``entries`` dealt by ``keys`` and merged, each partition in the order of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> Iterator[tuple]:
            trie = Trie(largest)
            for b in batches:
                for text, *values in zip(b.column(0), *(c.to_pylist() for c in b.columns[1:])):
                    key = text.as_py()
                    trie.add(key, *values)
                    if trie.size > BUDGET:
                        yield from trie.closed(key)
            yield from trie.terminals(trie.root)

        return _batches(merged(), with_text)

    dealt = entries.repartition(*keys).sortWithinPartitions("text")
    return dealt.select("text", "rows", "owner", "ties").mapInArrow(trimmed(run), ENTRY)


def owners(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """n, sha, rows, owner, ties: a row for each different text, written to the shared folder. ``keep``
    is "largest" or "smallest": which doc_id owns a text."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep!r}")
    small_batches(docs.sparkSession)
    largest = keep == "largest"
    read = materialise(_read(docs, largest), "trie-entries")
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    repeated = _merged(read.where("rows > 1").withColumn("salt", salt), ["n", "sha", "salt"], largest, True)
    whole = read.where("rows = 1").unionByName(repeated)
    return materialise(_merged(whole, ["n", "sha"], largest, False).drop("text"), "owners")


def digests(rows: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, text) with n and sha in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [normalised(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["row", "doc_id", "n", "sha"])

    schema = T.StructType([rows.schema["row"], rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("sha", T.BinaryType())])
    return rows.mapInArrow(trimmed(run), schema)


def _owned(docs: DataFrame, columns: list[str], keep: str) -> DataFrame:
    """row (a struct of ``columns``), doc_id, sha, rows, owner, kept: one row for each of ``docs``."""
    found = owners(docs, keep)
    total = found.agg(F.sum("rows")).first()[0] or 0
    crowded = F.col("rows") * CROWDED >= total
    hot = F.broadcast(found.where(crowded).select("n", "sha", F.lit(True).alias("hot")))  # CROWDED rows at most
    rows = digests(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.join(hot, ["n", "sha"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = found.withColumn("salt", F.explode(F.when(crowded, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    hashed = [F.col("row")[c] for c, kind in docs.dtypes if c in columns and "map<" not in kind and kind != "variant"]
    # rows of one doc_id are in one part, and what the join dealt serves the window too
    first = Window.partitionBy("n", "sha", "salt", "doc_id").orderBy(F.xxhash64(F.lit(0), *hashed))
    owned = rows.join(copies, ["n", "sha", "salt"]).withColumn("place", F.row_number().over(first))
    return owned.select("row", "doc_id", "sha", "rows", "owner", (F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("place") == 1)).alias("kept"))


def mark(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    rows = _owned(docs, ["doc_id"], keep)
    return rows.select("doc_id", F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each different text."""
    return _owned(docs, docs.columns, keep).where("kept").select("row.*")


#: Repeated rows of one doc_id and text: one of them is kept.
MARK_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
