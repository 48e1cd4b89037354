"""Statements against requirements: scores, best matches, conflicts, validity.

A pair scores above zero only if the two share a keyword, the subject or the level. So pairs come from
equi-joins, never from all statements with all requirements. A keyword counts wherever a requirement's
text contains it, inside words too; for that there is an inverted index: words of the texts with the
requirements that have them, in blocks of BLOCK, and the words' 3-grams. A keyword goes by its rarest
3-gram to the words with that gram, and what contains it brings its requirements.

Statements are matched within their document, or, with ``corpus=True``, with all documents. Keys of many
pairs are split by their measured sizes (``joins.sized_join``).

For the best of each statement subjects and levels are terms as keywords are. All lists of a block of
requirements meet its document's statements in one join, after which hits are summed, and all but the best
left out, where they are. In the whole corpus statements of equal terms are scored once: slices of the
lists meet chunks of these terms, and a cell gives the best of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom import dims
from specloom.functions import text as X
from specloom.operators.joins import HOT, SIDE, sized_join
from specloom.storage import written

#: Requirements in a block of a word's list, and such blocks that meet in one part of a join.
BLOCK, BLOCKS = 1024, 128
GRAM = dims.MIN_KEYWORD  # no keyword is shorter
WORD = f"[a-z0-9]{{{GRAM},}}"
#: Requirements in a slice of the corpus and searches in a chunk: what one task scores at a time.
SLICE, CHUNK = 65_536, 2048
BITS = 62  # keywords that a number tells of


@dataclass(frozen=True)
class Index:
    """``requirements`` with req_subject; ``words``: doc_id, token, block, ords."""

    requirements: DataFrame
    words: DataFrame


def analysed(statements: DataFrame) -> DataFrame:
    """``statements`` (stmt_id, doc_id, statement) with stmt_level, stmt_subject and keywords."""
    if "keywords" in statements.columns:
        return statements
    s = F.col("statement")
    return statements.select("stmt_id", "doc_id", "statement", X.level_of(s).alias("stmt_level"), X.subject_of(s).alias("stmt_subject"), X.keywords(s).alias("keywords"))


def prepared(requirements: DataFrame) -> DataFrame:
    """With req_subject, as a table: several joins read it, and requirements are costly to extract."""
    if "req_subject" in requirements.columns:
        return requirements
    return written(requirements.withColumn("req_subject", F.coalesce(F.lower("subject"), X.subject_of(F.col("text")))), "requirements")


def _searched() -> Column:
    """What a requirement is searched in."""
    return F.lower(F.concat("text", F.lit(" "), F.coalesce("full_context", F.lit(""))))


def index(requirements: DataFrame) -> Index:
    wanted = prepared(requirements)
    tokens = F.explode(F.array_distinct(F.regexp_extract_all(_searched(), F.lit(WORD), F.lit(0)))).alias("token")
    block = F.floor(F.col("req_ord") / BLOCK).cast("int").alias("block")
    words = wanted.select("doc_id", "req_ord", tokens).groupBy("doc_id", "token", block).agg(F.collect_list("req_ord").alias("ords"))
    return Index(wanted, written(words, "words"))


def grams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - (GRAM - 1)), lambda i: F.substring(word, i, F.lit(GRAM))))


def gram_pairs(keywords: DataFrame, words: DataFrame, scope: list[str]) -> DataFrame:
    """``scope``, keyword, token: what is compared, words that have the keyword's rarest gram. There are
    no more grams than 36 ** 3, so their counts are small enough to broadcast."""
    spelt = words.select(*scope, "token").distinct().select(*scope, "token", F.explode(grams(F.col("token"))).alias("gram"))
    rarity = F.broadcast(spelt.groupBy("gram").agg(F.count("*").alias("n")))
    wanted = keywords.select(*scope, "keyword").distinct().select(*scope, "keyword", F.explode(grams(F.col("keyword"))).alias("gram"))
    rarest = wanted.join(rarity, "gram", "left").groupBy(*scope, "keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    return rarest.where("g.n > 0").select(*scope, "keyword", "g.gram").join(spelt, [*scope, "gram"]).drop("gram")


def word_lists(keywords: DataFrame, words: DataFrame, scope: list[str]) -> DataFrame:
    """doc_id, block, keyword, ords: the list of each word that contains a keyword. However many statements
    share a keyword, its lists are made once."""
    found = gram_pairs(keywords, words, scope).where(F.col("token").contains(F.col("keyword")))
    return found.join(words, [*scope, "token"]).select("doc_id", "block", "keyword", "ords")


def keyword_lists(keywords: DataFrame, words: DataFrame, scope: list[str]) -> DataFrame:
    """doc_id, keyword, block, ords: the requirements that contain a keyword, each once, in blocks as those
    of ``words``."""
    lists = word_lists(keywords, words, scope).groupBy("doc_id", "keyword", "block").agg(F.array_distinct(F.flatten(F.collect_list("ords"))).alias("ords"))
    return written(lists, "keyword-lists")


def _keywords(said: DataFrame, scope: list[str]) -> DataFrame:
    return said.select("stmt_id", *scope, F.explode("keywords").alias("k")).select("stmt_id", *scope, "k.keyword", "k.weight")


def keyword_hits(said: DataFrame, words: DataFrame, scope: list[str]) -> DataFrame:
    """stmt_id, doc_id, req_ord, weight: a row for each keyword of a statement that a requirement contains."""
    keywords = _keywords(said, scope)
    return sized_join(keywords, keyword_lists(keywords, words, scope), [*scope, "keyword"], BLOCKS).select("stmt_id", "doc_id", F.explode("ords").alias("req_ord"), "weight")


def _order(scope: list[str]) -> list[Column]:
    return [F.desc("score"), *([] if scope else [F.col("doc_id")]), F.col("req_ord")]


def _ranked(pairs: DataFrame, scope: list[str], top: int) -> DataFrame:
    """With rank, of each statement up to ``top`` rows; before the shuffle each task leaves so many."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("stmt_id", *scope).orderBy(*_order(scope)))).where(F.col("rank") <= top)


def _plain_pairs(said: DataFrame, wanted: DataFrame, scope: list[str]) -> list[DataFrame]:
    """stmt_id, doc_id, req_ord of equal subject or level."""
    out = []
    for key in ("stmt_subject", "stmt_level"):
        own = said.select("stmt_id", *scope, key).dropna(subset=[key])
        others = wanted.select("doc_id", "req_ord", F.col("req_subject").alias("stmt_subject"), F.col("level").alias("stmt_level")).select("doc_id", "req_ord", key)
        out.append(sized_join(own, others, [*scope, key]).select("stmt_id", "doc_id", "req_ord"))
    return out


def _term_lists(said: DataFrame, at: Index, scope: list[str]) -> DataFrame:
    """doc_id, block, term, ords: lists of keywords (``k:``), subjects (``s:``) and levels (``l:``). A keyword may have
    several, of several words, with requirements in common."""
    words = word_lists(_keywords(said, scope), at.words, scope).select("doc_id", "block", F.concat(F.lit("k:"), "keyword").alias("term"), "ords")
    kinds = F.array(F.concat(F.lit("s:"), "req_subject"), F.concat(F.lit("l:"), "level"))
    block = F.floor(F.col("req_ord") / BLOCK).cast("int").alias("block")
    plain = at.requirements.where("doc_id IS NOT NULL AND req_ord IS NOT NULL").select("doc_id", block, F.explode(F.array_compact(kinds)).alias("term"), F.array("req_ord").alias("ords"))
    return words.unionByName(plain)


def _terms() -> Column:
    """term, weight, at: those of a statement; ``at`` counts keywords from 0, a subject has -1 and a level -2."""
    def term(name: Column, weight: Column, at: Column) -> Column:
        return F.struct(name.alias("term"), weight.cast("int").alias("weight"), at.cast("int").alias("at"))

    keywords = F.transform(F.coalesce("keywords", F.array().cast("array<struct<keyword:string,weight:int>>")), lambda k, i: term(F.concat(F.lit("k:"), k["keyword"]), k["weight"], i))
    more = F.array(term(F.concat(F.lit("s:"), "stmt_subject"), F.lit(dims.SUBJECT_BONUS), F.lit(-1)), term(F.concat(F.lit("l:"), "stmt_level"), F.lit(dims.LEVEL_BONUS), F.lit(-2)))
    return F.concat(keywords, F.filter(more, lambda t: t["term"].isNotNull()))


def ranked(said: DataFrame, at: Index, top: int) -> DataFrame:
    """stmt_id, doc_id, req_ord, score, subject_match, level_match, matched_keywords: the ``top`` of each of ``said`` in its
    document. ``said`` is a table. Nothing is shuffled between the join of statements with blocks and the
    best of each block."""
    part = F.pmod(F.xxhash64("stmt_id"), F.coalesce("_parts", F.lit(1))).cast("int").alias("part")
    hot = F.broadcast(said.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > SIDE).orderBy(F.desc("n")).limit(HOT).select("doc_id", F.ceil(F.col("n") / SIDE).cast("int").alias("_parts")))
    lists = _term_lists(said, at, ["doc_id"]).groupBy("doc_id", "block").agg(F.collect_list(F.struct("term", "ords")).alias("lists"))
    lists = lists.join(hot, "doc_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    blocks = at.requirements.groupBy("doc_id").agg(F.collect_set(F.floor(F.col("req_ord") / BLOCK).cast("int")).alias("blocks"))
    own = said.select("stmt_id", "doc_id", _terms().alias("terms")).join(hot, "doc_id", "left").select("stmt_id", "doc_id", "terms", part).join(blocks, "doc_id").withColumn("block", F.explode("blocks")).drop("blocks")
    cell = ["doc_id", "block", "part"]

    def hits(t: Column) -> Column:
        mine = F.transform(F.filter("lists", lambda x: x["term"] == t["term"]), lambda x: x["ords"])
        return F.transform(F.array_distinct(F.flatten(mine)), lambda o: F.struct(o.alias("req_ord"), t["weight"].alias("weight"), t["at"].alias("at")))

    found = own.join(lists, cell).select("stmt_id", *cell, F.explode(F.flatten(F.transform("terms", hits))).alias("h")).select("stmt_id", *cell, "h.*")
    most = said.agg(F.max(F.size("keywords"))).first()[0] or 0
    masks = [F.bit_or(F.when((F.col("at") >= 0) & (F.floor(F.col("at") / BITS) == j), F.expr(f"shiftleft(1L, at % {BITS})"))).alias(f"_m{j}") for j in range(max(1, -(-most // BITS)))]
    sums = found.groupBy("stmt_id", *cell, "req_ord").agg(F.sum("weight").cast("int").alias("score"), F.coalesce(F.bool_or(F.col("at") == -1), F.lit(False)).alias("subject_match"), F.coalesce(F.bool_or(F.col("at") == -2), F.lit(False)).alias("level_match"), *masks)
    first = sums.withColumn("_place", F.row_number().over(Window.partitionBy("stmt_id", *cell).orderBy(F.desc("score"), "req_ord"))).where(F.col("_place") <= top).drop("_place", "block", "part")
    best = _ranked(first, ["doc_id"], top).drop("rank").join(said.select("stmt_id", "doc_id", "keywords"), ["stmt_id", "doc_id"])
    mask = F.array(*[F.coalesce(f"_m{j}", F.lit(0).cast("long")) for j in range(len(masks))])
    told = F.filter("keywords", lambda k, i: F.getbit(F.get(mask, F.floor(i / BITS).cast("int")), i % BITS) == 1)
    names = F.coalesce(F.transform(told, lambda k: k["keyword"]), F.array().cast("array<string>"))
    return written(best.select("stmt_id", "doc_id", "req_ord", "score", "subject_match", "level_match", names.alias("matched_keywords")), "best")


def cell_best(top: int):
    """For cogroups of searches (profile, terms) and lists (term, doc_id, ords): profile, doc_id, req_ord, score, ``top`` of each."""

    def best(searches: pa.Table, lists: pa.Table) -> pa.Table:
        ords = lists["ords"].combine_chunks()
        n_each = np.diff(ords.offsets.to_numpy()) if len(ords) else np.zeros(0, int)
        docs = np.repeat(lists["doc_id"].to_numpy().astype(np.int64), n_each)
        rows, place = np.unique(docs << 32 | ords.flatten().to_numpy().astype(np.int64), return_inverse=True)
        names = lists["term"].combine_chunks().dictionary_encode()
        codes = np.repeat(names.indices.to_numpy(), n_each)
        order = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
        where = {t: np.unique(place[order[a:b]]) for t, a, b in zip(names.dictionary.to_pylist(), cuts, cuts[1:])}
        backwards, score = np.arange(len(rows) - 1, -1, -1), np.zeros(len(rows), np.int64)
        out = []
        for profile, terms in zip(searches["profile"].to_pylist(), searches["terms"].to_pylist()):
            score[:] = 0
            for t in terms:
                if t["term"] in where:
                    score[where[t["term"]]] += t["weight"]
            able = np.flatnonzero(score)
            if len(able) > top:  # equal scores go by document and order
                able = able[np.argpartition(-(score[able] * len(rows) + backwards[able]), top - 1)[:top]]
            out.append((profile, rows[able], score[able]))
        at = np.concatenate([r for _, r, _ in out]) if out else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, _, s in out]) if out else np.zeros(0, np.int64)
        profiles = pa.array([p for p, r, _ in out for _ in range(len(r))], pa.string())
        return pa.table({"profile": profiles, "doc_id": pa.array((at >> 32).astype(np.int32)), "req_ord": pa.array((at & 0xFFFFFFFF).astype(np.int32)), "score": pa.array(scores.astype(np.int32))})

    return best


def searched_corpus(said: DataFrame, at: Index, top: int) -> DataFrame:
    """The ``top`` of all requirements for each of ``said``, which is a table, with its columns and the requirements'."""
    terms = _terms()
    said = said.select("*", F.sha2(F.to_json(F.struct("stmt_level", "stmt_subject", "keywords")), 256).alias("profile"))
    searches = written(said.groupBy("profile").agg(F.first(terms).alias("terms")), "searches")
    slices, chunks = (max(1, -(-df.count() // size)) for df, size in ((at.requirements, SLICE), (searches, CHUNK)))
    cell = ["chunk", "slice"]
    left = searches.select(F.pmod(F.xxhash64("profile"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "profile", "terms")
    right = _term_lists(said, at, []).select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.pmod(F.xxhash64("doc_id", "block"), F.lit(slices)).cast("int").alias("slice"), "term", F.col("doc_id").cast("int").alias("doc_id"), "ords")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(cell_best(top), "profile string, doc_id int, req_ord int, score int")
    best = Window.partitionBy("profile").orderBy(*_order([]))
    found = written(found.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= top).drop("_place"), "corpus-best")
    return found.join(at.requirements, ["doc_id", "req_ord"]).join(said, "profile").drop("profile")


def scored(statements: DataFrame, requirements: DataFrame | Index, top: int | None = None, corpus: bool = False) -> DataFrame:
    """Each pair that scores above zero, with score, matched keywords and what gave a bonus; with ``top`` only the
    best of each statement, of equal ones the first in document order. With ``corpus`` statements
    meet every document's requirements; doc_id is the requirement's."""
    at = requirements if isinstance(requirements, Index) else index(requirements)
    scope = [] if corpus else ["doc_id"]
    said = written(analysed(statements).drop(*(["doc_id"] if corpus else [])), "statements")
    if top and not corpus:
        return written(ranked(said, at, top).join(at.requirements, ["doc_id", "req_ord"]).join(said, ["stmt_id", *scope]), "matches")
    if top:
        rows = searched_corpus(said, at, top)
    else:
        hits = keyword_hits(said, at.words, scope)
        for plain in _plain_pairs(said, at.requirements, scope):
            hits = hits.unionByName(plain.withColumn("weight", F.lit(0)))
        pairs = hits.groupBy("stmt_id", "doc_id", "req_ord").agg(F.sum("weight").alias("_base"))
        rows = pairs.join(at.requirements, ["doc_id", "req_ord"]).join(said, ["stmt_id", *scope])
    rows = rows.withColumns({"subject_match": F.coalesce(F.col("req_subject") == F.col("stmt_subject"), F.lit(False)), "level_match": F.coalesce(F.col("level") == F.col("stmt_level"), F.lit(False))})
    if not top:
        score = F.col("_base").cast("int") + F.col("subject_match").cast("int") * dims.SUBJECT_BONUS + F.col("level_match").cast("int") * dims.LEVEL_BONUS
        rows = rows.withColumn("score", score).drop("_base")
    named = X.let(_searched(), lambda t: F.transform(F.filter("keywords", lambda k: t.contains(k["keyword"])), lambda k: k["keyword"]))
    return rows.withColumn("matched_keywords", named)


def best_matches(pairs: DataFrame, top: int = dims.TOP_MATCHES, corpus: bool = False) -> DataFrame:
    """Up to ``top`` rows of each statement by score; equal scores keep document order."""
    return _ranked(pairs.where("score > 0"), [] if corpus else ["doc_id"], top)


def _reason() -> Column:
    """Why a pair of one subject conflicts, or null."""
    overlap = X.let(F.lower("text"), lambda t: F.size(F.filter("keywords", lambda k: t.contains(k["keyword"]))))
    opposed = F.lit(False)
    for level, others in dims.CONFLICTS.items():
        opposed = opposed | ((F.col("stmt_level") == level) & F.col("level").isin(list(others)))
    by_level = F.coalesce(opposed, F.lit(False)) & ((overlap >= dims.MIN_OVERLAP) | (F.size("keywords") <= dims.SHORT_STATEMENT))
    said, action = F.lower("statement"), F.coalesce("action", "text")
    must, must_not = F.col("level").isin("MUST", "SHALL", "REQUIRED"), F.col("level").isin("MUST NOT", "SHALL NOT")
    forbidden = X.trim(F.regexp_replace(action, "(?i)must not|shall not", ""))
    return (
        F.when(by_level, F.concat(F.lit('Statement uses "'), "stmt_level", F.lit('" but requirement uses "'), "level", F.lit('"')))
        .when(must & X.contradict(said, F.lower(action)), F.concat(F.lit('Statement action contradicts "'), "level", F.lit('" requirement: "'), action, F.lit('"')))
        .when(must_not & X.does_forbidden(said, F.lower(forbidden)), F.concat(F.lit('Statement does what "'), "level", F.lit('" forbids: "'), forbidden, F.lit('"')))
    )


def conflicts(statements: DataFrame, requirements: DataFrame) -> DataFrame:
    """Pairs that conflict, one row each, with reason. Statements without a subject have none. Levels that
    nothing of can conflict aren't joined."""
    able = sorted({x for others in dims.CONFLICTS.values() for x in others} | {"MUST", "SHALL", "REQUIRED", "MUST NOT", "SHALL NOT"})
    wanted = prepared(requirements).where(F.col("level").isin(able)).withColumnRenamed("req_subject", "stmt_subject")
    pairs = sized_join(analysed(statements).where("stmt_subject IS NOT NULL"), wanted, ["doc_id", "stmt_subject"])
    return pairs.withColumn("reason", _reason()).where("reason IS NOT NULL")


def validity(statements: DataFrame, requirements: DataFrame | Index) -> DataFrame:
    """stmt_id, doc_id, n_matches (up to the limit), n_conflicts, is_valid and suggestions."""
    at = requirements if isinstance(requirements, Index) else index(requirements)
    said = written(analysed(statements), "statements")
    return judged(said, ranked(said, at, dims.TOP_MATCHES), conflicts(said, at.requirements))


def judged(statements: DataFrame, matches: DataFrame, against: DataFrame) -> DataFrame:
    """As validity, from what ``scored`` with the limit and ``conflicts`` gave."""
    matches = matches.groupBy("stmt_id", "doc_id").agg(F.count("*").alias("n_matches"))
    against = against.groupBy("stmt_id", "doc_id").agg(F.count("*").alias("n_conflicts"))
    rows = analysed(statements).join(matches.hint("merge"), ["stmt_id", "doc_id"], "left").join(against.hint("merge"), ["stmt_id", "doc_id"], "left").fillna(0, ["n_matches", "n_conflicts"])
    hints = F.array_compact(
        F.array(
            F.when(F.col("n_matches") == 0, "No matching requirements found. Try different keywords."),
            F.when(F.col("n_conflicts") > 0, "Potential conflicts detected. Review the requirement levels (MUST/SHOULD/MAY) carefully."),
            F.when(F.col("stmt_level").isNotNull() & F.col("stmt_subject").isNull(), 'Consider specifying the subject (e.g., "client", "server") for better matching.'),
        )
    )
    return rows.select("stmt_id", "doc_id", "statement", "stmt_level", "stmt_subject", "n_matches", "n_conflicts", (F.col("n_conflicts") == 0).alias("is_valid"), F.when(F.size(hints) > 0, hints).alias("suggestions"))
