"""Quality rules as a bitmask ledger [native].

Every rule is evaluated once for each document. The ledger keeps the measurements and, in one
integer, a bit for each rule that the document fails. Policies are versioned masks over these bits,
applied without touching a text again; ablations (what each rule alone rejects) come from counts
of the bit patterns, of which there are at most 2 ** number of rules.

All work on a text is done in its own row: there is no shuffle before the ledger.

Defined cases: a null or empty text has no words and fails the rule on their number; a very long
text is measured whole; repeated rows are separate rows; an empty table gives an empty ledger; only
doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import SPACES, WORD

#: Bit by bit: name and condition of failure over the measurements, in integers throughout.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    ("short_or_long_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("capitals", "2 * n_upper > word_chars AND n_words > 0"),
    ("exclamations", "100 * n_exclamations > 40 * n_words"),
    ("repeated_neighbours", "100 * n_same_neighbours > 20 * n_words"),
)
BASE = ("few_words", "repeated_trigrams")


def mask_of(*names: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


#: Policies by version. A policy rejects a document that fails a rule in its mask.
POLICIES: dict[str, int] = {"v1": mask_of(*BASE, "symbols"), "v2": mask_of(*(name for name, _ in RULES))}

#: Word positions covered by a 3-word window that occurs twice or more. The windows' hashes are
#: sorted with their places only in texts where two of them are equal. transform(array(x), x -> ...)
#: binds a value once.
_REPEATS = """
CASE WHEN size(_w) < 4 OR size(array_distinct(_h)) = size(_h) THEN 0 ELSE
  transform(array(sort_array(transform(_h, (h, i) -> struct(h AS h, i AS p)))), s ->
    transform(array(sort_array(transform(
        filter(sequence(0, size(s) - 1), k -> s[k].h <=> get(s, k - 1).h OR s[k].h <=> get(s, k + 1).h),
        k -> s[k].p))), f ->
      aggregate(sequence(0, size(f) - 1), 0, (a, k) -> a + least(3, coalesce(get(f, k + 1) - f[k], 3)))
    )[0]
  )[0] END
"""


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each text."""
    text, symbols = F.col("_t"), F.translate("_t", "#*$%&|<>", "")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    rows = rows.withColumns({"_w": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_l": F.expr(r"filter(split(_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')")})
    rows = rows.withColumn("_h", F.expr("CASE WHEN size(_w) < 3 THEN array() ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"))
    return rows.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(symbols)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATS).cast("long").alias("n_repeat_words"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_exclamations"),
        F.expr("size(filter(_w, (w, i) -> w <=> get(_w, i - 1)))").cast("long").alias("n_same_neighbours"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, whose bit i is set where rule i fails."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs).withColumn("failed", failed.cast("int"))


def judge(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    base, mask = mask_of(*BASE), POLICIES[policy]
    return ledger(docs).withColumns({"base_failed": F.col("failed").bitwiseAND(base) != 0, "policy": F.lit(policy), "kept": F.col("failed").bitwiseAND(mask | base) == 0})


def ablations(ledger_rows: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many only it rejects."""
    mask = POLICIES[policy]
    patterns = ledger_rows.groupBy(F.col("failed").bitwiseAND(mask).alias("pattern")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(name).alias("rule")) for i, (name, _) in enumerate(RULES) if mask >> i & 1]))
    each = patterns.select("pattern", "n", rules.alias("r")).select("pattern", "n", "r.*", F.expr("shiftleft(1, r.bit)").alias("one"))
    return each.groupBy("bit", "rule").agg(F.sum(F.when(F.col("pattern").bitwiseAND(F.col("one")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("pattern") == F.col("one"), F.col("n")).otherwise(0)).alias("n_only_this"))


#: n_repeat_words by counting the windows themselves, and everything else from plain SQL.
JUDGE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')))::BIGINT AS n_upper,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_same_neighbours
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (%s)::INTEGER AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & %d <> 0 AS base_failed, failed & %d = 0 AS kept, failed FROM f
""" % (" + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in enumerate(RULES)), mask_of(*BASE), POLICIES["v2"])
