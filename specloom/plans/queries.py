"""The registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom import dims, storage
from specloom.functions import text as X
from specloom.operators import calls, checklist, markup_parse, matching, relations, requirements, structure, text_parse
from specloom.operators.parsed import Parsed
from specloom.plans import corpus as C
from specloom.sources import scan

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
STAMP = "2024-01-01T00:00:00.000Z"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _parsed(spark: SparkSession, sf_dir: str) -> Parsed:
    return text_parse.parse_text(C.text_documents(spark, sf_dir))


def _requirements(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return requirements.extract_requirements(_parsed(spark, sf_dir), **options)


def _text(select: str) -> str:
    return f"WITH {C.TEXT_SQL} {select}"


def _matched(select: str, conflicts: bool = False) -> str:
    return f"WITH {C.TEXT_SQL}, {C.STATEMENTS_SQL}{', ' + C.CONFLICTS_SQL if conflicts else ''} {select}"


# -- requirements


@query(_text("SELECT doc_id, req_ord, 'R-' || section || '-' || req_ord AS id, level, text, section, section_title, full_context FROM req"))
def req_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requirements(spark, sf_dir, with_components=False).select("doc_id", "req_ord", "id", "level", "text", "section", "section_title", "full_context")


@query(_text("SELECT doc_id, req_ord, level, subject, action, condition, exception FROM req"))
def req_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requirements(spark, sf_dir).select("doc_id", "req_ord", "level", "subject", "action", "condition", "exception")


@query(_text("SELECT doc_id, level, count(*) AS n FROM req GROUP BY doc_id, level"))
def req_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements.count_by_level(_requirements(spark, sf_dir, with_components=False))


@query(_text("SELECT level, count(*) AS n FROM req GROUP BY ROLLUP (level)"))
def req_by_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements.level_rollup(_requirements(spark, sf_dir, with_components=False))


_FILTERED = "SELECT doc_id, 'R-' || section || '-' || row_number() OVER (PARTITION BY doc_id ORDER BY req_ord) AS id, level, text FROM req WHERE "


@query(_text(_FILTERED + "section = '4' OR starts_with(section, '4.') OR section = '7.3' OR starts_with(section, '7.3.')"))
def req_section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requirements(spark, sf_dir, sections=["4", "section-7.3"], with_components=False).select("doc_id", "id", "level", "text")


@query(_text(_FILTERED + "section IN ('4', '7.3')"))
def req_section_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requirements(spark, sf_dir, sections=["4", "7.3"], with_subsections=False, with_components=False).select("doc_id", "id", "level", "text")


@query(_text(_FILTERED + "level = 'MUST NOT'"))
def req_level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requirements(spark, sf_dir, level="MUST NOT", with_components=False).select("doc_id", "id", "level", "text")


@query(_text("SELECT m2.doc_id, m2.seq AS sec_seq, block_ord::INTEGER AS block_ord, (i - 1)::INTEGER AS marker_ord, level, pos FROM m2"))
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements.marked_units(_parsed(spark, sf_dir).units()).select("doc_id", "sec_seq", "block_ord", "marker_ord", "level", "pos")


# -- checklists

_CLASSED = f"cl AS (SELECT *, CASE {' '.join(f'WHEN level IN ({repr(tuple(v))[1:-1]}) THEN {k!r}' for k, v in dims.CLASSES.items())} END AS class FROM req)"
_STATS = "SELECT doc_id, count(*) FILTER (class = 'must') AS must, count(*) FILTER (class = 'should') AS should, count(*) FILTER (class = 'may') AS may, count(class) AS total FROM cl {where} GROUP BY doc_id"


@query(f"WITH {C.TEXT_SQL}, {_CLASSED} " + _STATS.format(where=""))
def checklist_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.stats(checklist.items(_requirements(spark, sf_dir)))


@query(f"WITH {C.TEXT_SQL}, {_CLASSED} " + _STATS.format(where="WHERE contains(coalesce(subject, ''), 'client') OR NOT contains(coalesce(subject, ''), 'server')"))
def checklist_role_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.stats(checklist.items(_requirements(spark, sf_dir), "client"))


@query(f"WITH {C.TEXT_SQL}, {_CLASSED} " + _STATS.format(where="WHERE contains(coalesce(subject, ''), 'server') OR NOT contains(coalesce(subject, ''), 'client')"))
def checklist_role_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.stats(checklist.items(_requirements(spark, sf_dir), "server"))


_TITLE = rf"ti AS (SELECT r.doc_id, coalesce(min_by(t, line_no) FILTER (line_no < {dims.TITLE_LINES} AND length(t) > {dims.TITLE_LONGER_THAN} AND length(t) < {dims.TITLE_SHORTER_THAN} AND NOT contains(t, ':') AND NOT regexp_matches(t, '^\d') AND NOT contains(lower(t), 'request for comments')), 'RFC ' || r.doc_id) AS title FROM raw r JOIN l2 ON r.doc_id = l2.doc_id GROUP BY r.doc_id)"
_PARTS = " || ".join(f"coalesce('{h}' || chr(10) || chr(10) || (SELECT string_agg('- [ ] ' || text || ' (' || section || ')', chr(10) ORDER BY req_ord) FROM cl WHERE cl.doc_id = ti.doc_id AND class = '{c}' AND {{role}}) || chr(10) || chr(10), '')" for c, h in checklist.HEADINGS.items())


def _markdown_cte(role: str | None) -> str:
    only = "true" if not role else "(contains(coalesce(subject, ''), 'client') OR NOT contains(coalesce(subject, ''), 'server'))"
    said = f"'Role: {role}' || chr(10) || chr(10) || " if role else ""
    whole = f"'# RFC ' || doc_id || ' Implementation Checklist' || chr(10) || chr(10) || '**' || title || '**' || chr(10) || chr(10) || {said}'Generated: {STAMP}' || chr(10) || chr(10) || {_PARTS.format(role=only)}"
    # the last line is empty, and no newline follows it
    return f"{_CLASSED}, {_TITLE}, md AS (SELECT doc_id, {whole} AS x FROM ti), mk AS (SELECT doc_id, x[1:length(x) - 1] AS markdown FROM md)"


def _markdown(role: str | None) -> str:
    return f"WITH {C.TEXT_SQL}, {_markdown_cte(role)} SELECT doc_id, markdown FROM mk"


@query(_markdown(None))
def checklist_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    return checklist.markdown(parsed.docs, checklist.items(requirements.extract_requirements(parsed)), None, STAMP)


@query(_markdown("client"))
def checklist_markdown_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    return checklist.markdown(parsed.docs, checklist.items(requirements.extract_requirements(parsed), "client"), "client", STAMP)


# -- statements

#: What scores, and what conflicts, are made of: nothing else is extracted.
_SCORED, _OPPOSED = ("doc_id", "req_ord", "level", "text", "subject", "full_context"), ("doc_id", "req_ord", "level", "text", "subject", "action")


@query(rf"""WITH b AS (SELECT item_id, {C.keyword_list_sql("text")} AS kl FROM benchmark), k AS (SELECT item_id, unnest(kl) AS keyword, unnest(range(0, len(kl))) AS i FROM b),
g AS (SELECT item_id, keyword, min(i) AS i, count(*) * {C.weight_sql("keyword")} AS weight FROM k GROUP BY item_id, keyword)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY i) - 1)::INTEGER AS ord, keyword, weight::INTEGER AS weight FROM g""")
def stmt_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.keywords(F.col("text"))).alias("ord", "k"))
    return rows.select("item_id", "ord", "k.keyword", F.col("k.weight").cast("int").alias("weight"))


@query(rf"""WITH d AS (SELECT unnest({C.keyword_list_sql("text")}) AS keyword FROM documents) SELECT keyword, (count(*) * {C.weight_sql("keyword")})::BIGINT AS weight FROM d GROUP BY keyword""")
def corpus_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "documents").select(F.explode(X.keyword_words(F.col("text"))).alias("keyword"))
    return rows.groupBy("keyword").agg((F.count("*") * F.first(X.keyword_weight(F.col("keyword")))).alias("weight"))


@query(_matched("SELECT stmt_id, doc_id, stmt_level, stmt_subject FROM sa"))
def stmt_level_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.analysed(C.statements(spark, sf_dir)).select("stmt_id", "doc_id", "stmt_level", "stmt_subject")


@query(_matched(f"SELECT * FROM (SELECT stmt_id, doc_id, (row_number() OVER (PARTITION BY stmt_id, doc_id ORDER BY score DESC, req_ord))::INTEGER AS rank, req_ord, score, matched FROM sc WHERE score > 0) WHERE rank <= {dims.TOP_MATCHES}"))
def stmt_match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = storage.written(matching.analysed(C.statements(spark, sf_dir)), "statements")
    pairs = matching.ranked(said, matching.index(_requirements(spark, sf_dir).select(*_SCORED)), dims.TOP_MATCHES)
    return matching.best_matches(pairs).select("stmt_id", "doc_id", "rank", "req_ord", F.col("score").cast("long").alias("score"), F.array_join("matched_keywords", " ").alias("matched"))


_CORPUS = f"""qs AS (SELECT stmt_id, stmt_level, stmt_subject FROM sa WHERE stmt_id % 50 = 0), qk AS (SELECT kw.* FROM kw JOIN qs ON kw.stmt_id = qs.stmt_id),
dt AS (SELECT doc_id, req_ord, level, req_subject, lower(text || ' ' || full_context) AS x FROM rq),
qh AS (SELECT stmt_id, doc_id, req_ord, sum(weight) AS base, string_agg(keyword, ' ' ORDER BY i) AS matched FROM qk, dt WHERE contains(x, keyword) GROUP BY stmt_id, doc_id, req_ord),
qp AS (SELECT qs.stmt_id, dt.doc_id, dt.req_ord, (coalesce(req_subject = stmt_subject, false)::INTEGER * {dims.SUBJECT_BONUS} + coalesce(level = stmt_level, false)::INTEGER * {dims.LEVEL_BONUS}) AS bonus FROM qs, dt),
qc AS (SELECT qp.stmt_id, qp.doc_id, qp.req_ord, (bonus + coalesce(base, 0))::BIGINT AS score, coalesce(matched, '') AS matched FROM qp LEFT JOIN qh ON qp.stmt_id = qh.stmt_id AND qp.doc_id = qh.doc_id AND qp.req_ord = qh.req_ord)"""


@query(f"WITH {C.TEXT_SQL}, {C.STATEMENTS_SQL}, {_CORPUS} SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY stmt_id ORDER BY score DESC, doc_id, req_ord))::INTEGER AS rank FROM qc WHERE score > 0) WHERE rank <= {dims.TOP_MATCHES}")
def stmt_match_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th statement is searched for in the requirements of all documents."""
    searched = C.statements(spark, sf_dir).where("stmt_id % 50 = 0")
    pairs = matching.scored(searched, _requirements(spark, sf_dir).select(*_SCORED), dims.TOP_MATCHES, corpus=True)
    return matching.best_matches(pairs, corpus=True).select("stmt_id", "doc_id", "rank", "req_ord", F.col("score").cast("long").alias("score"), F.array_join("matched_keywords", " ").alias("matched"))


@query(_matched("SELECT stmt_id, doc_id, req_ord, level, reason FROM cf WHERE starts_with(reason, 'Statement uses')", True))
def stmt_conflicts_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.conflicts(C.statements(spark, sf_dir), _requirements(spark, sf_dir).select(*_OPPOSED))
    return found.where("startswith(reason, 'Statement uses')").select("stmt_id", "doc_id", "req_ord", "level", "reason")


@query(_matched("SELECT stmt_id, doc_id, req_ord, level, reason FROM cf WHERE NOT starts_with(reason, 'Statement uses')", True))
def stmt_conflicts_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.conflicts(C.statements(spark, sf_dir), _requirements(spark, sf_dir).select(*_OPPOSED))
    return found.where("NOT startswith(reason, 'Statement uses')").select("stmt_id", "doc_id", "req_ord", "level", "reason")


@query(_matched(f"""SELECT sa.stmt_id, sa.doc_id, coalesce(m.n, 0)::BIGINT AS n_matches, coalesce(c.n, 0)::BIGINT AS n_conflicts, coalesce(c.n, 0) = 0 AS is_valid,
array_to_string(list_filter([CASE WHEN coalesce(m.n, 0) = 0 THEN 'No matching requirements found. Try different keywords.' END, CASE WHEN coalesce(c.n, 0) > 0 THEN 'Potential conflicts detected. Review the requirement levels (MUST/SHOULD/MAY) carefully.' END, CASE WHEN stmt_level IS NOT NULL AND stmt_subject IS NULL THEN 'Consider specifying the subject (e.g., "client", "server") for better matching.' END], lambda x: x IS NOT NULL), ' ') AS suggestions
FROM sa LEFT JOIN (SELECT stmt_id, least(count(*), {dims.TOP_MATCHES}) AS n FROM sc WHERE score > 0 GROUP BY stmt_id) m ON sa.stmt_id = m.stmt_id LEFT JOIN (SELECT stmt_id, count(*) AS n FROM cf GROUP BY stmt_id) c ON sa.stmt_id = c.stmt_id""", True))
def stmt_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.validity(C.statements(spark, sf_dir), _requirements(spark, sf_dir).select(*_SCORED, "action"))
    return rows.select("stmt_id", "doc_id", F.col("n_matches").cast("long").alias("n_matches"), F.col("n_conflicts").cast("long").alias("n_conflicts"), "is_valid", F.coalesce(F.array_join("suggestions", " "), F.lit("")).alias("suggestions"))


# -- sections, definitions, references of text documents


@query(_text("""SELECT s.doc_id, s.seq, s.number, s.title, s.depth, (SELECT max(p.seq) FROM sec p WHERE p.doc_id = s.doc_id AND p.seq < s.seq AND p.depth < s.depth)::INTEGER AS parent_seq FROM sec s"""))
def section_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).sections.select("doc_id", "seq", "number", "title", "depth", "parent_seq")


@query(_text("SELECT doc_id, seq AS sec_seq, block_ord::INTEGER AS block_ord, content FROM par"))
def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).blocks.select("doc_id", "sec_seq", "block_ord", "content")


@query(_text("SELECT depth, count(*) AS n_sections, count(DISTINCT doc_id) AS n_docs FROM sec GROUP BY depth"))
def section_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).sections.groupBy("depth").agg(F.count("*").alias("n_sections"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"WITH {C.TEXT_SQL}, {_TITLE} SELECT doc_id, title FROM ti")
def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).docs.select("doc_id", "title")


_DEF = rf"""d0 AS (SELECT *, regexp_extract(t, '^\s*([A-Za-z][A-Za-z0-9\s-]*[A-Za-z0-9])\s*[-:]\s+(.+)$', 1) AS term, regexp_extract(t, '^\s*([A-Za-z][A-Za-z0-9\s-]*[A-Za-z0-9])\s*[-:]\s+(.+)$', 2) AS definition,
last_value(CASE WHEN hd THEN number END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS sect FROM l3),
df AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no))::INTEGER AS def_ord, trim(term) AS term, trim(definition) AS definition, coalesce(sect, '') AS section FROM d0 WHERE NOT hd AND length(trim(term)) >= {dims.MIN_TERM} AND length(trim(definition)) >= {dims.MIN_DEFINITION})"""


@query(f"WITH {C.TEXT_SQL}, {_DEF} SELECT * FROM df")
def definitions_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).definitions


@query(f"WITH {C.TEXT_SQL}, {_DEF} SELECT doc_id, count(*) AS n_definitions FROM df GROUP BY doc_id")
def definition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).definitions.groupBy("doc_id").agg(F.count("*").alias("n_definitions"))


@query(f"WITH {C.TEXT_SQL}, {_DEF} SELECT * FROM df WHERE contains(lower(term), 'host') OR contains(lower(definition), 'host')")
def definitions_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.search_definitions(_parsed(spark, sf_dir).definitions, "HOST")


_REFS = r"f0 AS (SELECT doc_id, regexp_extract_all(body, '(?i)RFC\s*(\d+)', 1) AS ns FROM raw), f1 AS (SELECT doc_id, unnest(ns)::INTEGER AS n, unnest(range(0, len(ns))) AS i FROM f0), f2 AS (SELECT doc_id, n, min(i) AS i FROM f1 WHERE n <> doc_id GROUP BY doc_id, n), rf AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS ref_ord, n AS rfc_number FROM f2)"


@query(f"WITH {C.TEXT_SQL}, {_REFS} SELECT doc_id, ref_ord, rfc_number, 'RFC ' || rfc_number AS title FROM rf")
def refs_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).refs.select("doc_id", "ref_ord", "rfc_number", "title")


@query(f"WITH {C.TEXT_SQL}, {_REFS} SELECT rfc_number AS doc_id, count(DISTINCT doc_id) AS n_citing, string_agg(DISTINCT lpad(doc_id::VARCHAR, 8, '0'), ',' ORDER BY lpad(doc_id::VARCHAR, 8, '0')) AS citing FROM rf GROUP BY rfc_number")
def refs_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.referenced_by(_parsed(spark, sf_dir).refs)
    return rows.select("doc_id", "n_citing", F.array_join(F.transform("citing", lambda x: F.lpad(x.cast("string"), 8, "0")), ",").alias("citing"))


_XREFS = r"""x0 AS (SELECT doc_id, seq, block_ord, regexp_extract_all(content, '[Ss]ection\s+([\d.]+)', 1) AS ts FROM par), x1 AS (SELECT doc_id, seq, block_ord, unnest(ts) AS target, unnest(range(0, len(ts))) AS i FROM x0),
x2 AS (SELECT doc_id, seq, target, min([block_ord, i]) AS o FROM x1 GROUP BY doc_id, seq, target), ix AS (SELECT doc_id, number AS key, min(seq) AS s FROM sec GROUP BY doc_id, number)"""


@query(_text(f", {_XREFS} SELECT x2.doc_id, x2.seq AS sec_seq, own.title, target AS related_number, coalesce(other.title, 'Unknown') AS related_title FROM x2 JOIN sec own ON x2.doc_id = own.doc_id AND x2.seq = own.seq LEFT JOIN ix ON x2.doc_id = ix.doc_id AND x2.target = ix.key LEFT JOIN sec other ON ix.doc_id = other.doc_id AND ix.s = other.seq"))
def related_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.related_sections(_parsed(spark, sf_dir)).select("doc_id", "sec_seq", "title", "related_number", "related_title")


@query(_text(r"""SELECT doc_id, seq AS sec_seq, block_ord::INTEGER AS block_ord, u.kind AS type, u.target FROM (SELECT doc_id, seq, block_ord, unnest(list_concat(list_transform(regexp_extract_all(content, '(?i)RFC\s*(\d+)', 1), lambda n: {'kind': 'rfc', 'target': 'RFC' || n}), list_transform(regexp_extract_all(content, '[Ss]ection\s+([\d.]+)', 1), lambda s: {'kind': 'section', 'target': s}))) AS u FROM par)"""))
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).xrefs().select("doc_id", "sec_seq", "block_ord", "type", "target")


def _tree_sql() -> str:
    """tr: the sections of a document as JSON. Level by level, the deepest first: a section's text holds its children's."""
    parts = [
        "sp AS (SELECT s.*, (SELECT max(p.seq) FROM sec p WHERE p.doc_id = s.doc_id AND p.seq < s.seq AND p.depth < s.depth) AS parent_seq FROM sec s)",
        """ct AS (SELECT doc_id, seq, string_agg('{"type":"text","content":' || to_json(content) || '}', ',' ORDER BY block_ord) AS c FROM par GROUP BY doc_id, seq)""",
        """w0 AS (SELECT sp.doc_id, sp.seq, parent_seq, depth, '{"number":' || to_json(number) || ',"title":' || to_json(title) || ',"content":[' || coalesce(c, '') || ']' AS j FROM sp LEFT JOIN ct ON sp.doc_id = ct.doc_id AND sp.seq = ct.seq)""",
        f"d{dims.MAX_DEPTH + 1} AS (SELECT doc_id, seq, parent_seq, j FROM w0 WHERE false)",
    ]

    def union(least: int) -> str:
        return " UNION ALL ".join(f"SELECT * FROM d{d}" for d in range(least, dims.MAX_DEPTH + 2))

    for d in range(dims.MAX_DEPTH, 0, -1):
        below = f"SELECT doc_id, parent_seq, string_agg(j, ',' ORDER BY seq) AS s FROM ({union(d + 1)}) GROUP BY doc_id, parent_seq"
        parts.append(f"""d{d} AS (SELECT w0.doc_id, w0.seq, w0.parent_seq, w0.j || coalesce(',"subsections":[' || k.s || ']', '') || '}}' AS j FROM w0 LEFT JOIN ({below}) k ON k.doc_id = w0.doc_id AND k.parent_seq = w0.seq WHERE w0.depth = {d})""")
    return ", ".join([*parts, f"tr AS (SELECT doc_id, string_agg(j, ',' ORDER BY seq) AS s FROM ({union(1)}) WHERE parent_seq IS NULL GROUP BY doc_id)"])


_STRUCTURE = """'{"metadata":{"title":' || to_json(title) || ',"number":' || ti.doc_id || '},"sections":[' || coalesce(s, '') || '],"referenceCount":{"normative":0,"informative":' || coalesce(n, 0) || '},"_source":"text","_sourceNote":"%s"}'""" % dims.TEXT_NOTES["structure"]


@query(f"WITH {C.TEXT_SQL}, {_TITLE}, {_REFS}, {_tree_sql()} SELECT ti.doc_id, {_STRUCTURE} AS structure FROM ti LEFT JOIN tr ON ti.doc_id = tr.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM rf GROUP BY doc_id) r ON ti.doc_id = r.doc_id")
def structure_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.structure_json(_parsed(spark, sf_dir), with_content=True)


# -- tables of calls


def _note_sql(context: str) -> str:
    return f""","_source":"text","_sourceNote":"{dims.TEXT_NOTES[context]}\"}}"""


def _requirement_sql(of: str, more: str = "''") -> str:
    named = {"subject": "subject", "action": "action", "condition": "condition", "exception": "exception"}
    parts = " || ".join(f"""coalesce(',"{n}":' || to_json({of}.{c}), '')""" for c, n in named.items())
    return f"""'{{"id":' || to_json('R-' || {of}.section || '-' || {of}.n) || ',"level":' || to_json({of}.level) || ',"text":' || to_json({of}.text) || {parts} || ',"section":' || to_json({of}.section) || ',"sectionTitle":' || to_json({of}.section_title) || ',"fullContext":' || to_json({of}.full_context) || {more} || '}}'"""


_HINTS = """list_filter([CASE WHEN m.j IS NULL THEN 'No matching requirements found. Try different keywords.' END, CASE WHEN c.j IS NOT NULL THEN 'Potential conflicts detected. Review the requirement levels (MUST/SHOULD/MAY) carefully.' END, CASE WHEN stmt_level IS NOT NULL AND stmt_subject IS NULL THEN 'Consider specifying the subject (e.g., "client", "server") for better matching.' END], lambda x: x IS NOT NULL)"""
_CALLS = f"""ca AS (SELECT stmt_id AS call_id, doc_id, stmt_id % 9 AS tool, (1 + stmt_id % 7)::VARCHAR AS s, CASE WHEN stmt_id % 2 = 0 THEN 'MUST' END AS lv FROM st),
q0 AS (SELECT call_id, structure AS text FROM ca JOIN (SELECT ti.doc_id, {_STRUCTURE} AS structure FROM ti LEFT JOIN tr ON ti.doc_id = tr.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM rf GROUP BY doc_id) r ON ti.doc_id = r.doc_id) x ON ca.doc_id = x.doc_id WHERE tool = 0),
f1r AS (SELECT call_id, req.*, row_number() OVER (PARTITION BY call_id ORDER BY req_ord) AS n FROM ca JOIN req ON ca.doc_id = req.doc_id WHERE tool = 1 AND (section = s OR starts_with(section, s || '.')) AND (lv IS NULL OR level = lv)),
f1l AS (SELECT call_id, string_agg('"' || level || '":' || k, ',' ORDER BY level) AS l FROM (SELECT call_id, level, count(*) AS k FROM f1r GROUP BY call_id, level) GROUP BY call_id),
f1j AS (SELECT call_id, count(*) AS k, string_agg({_requirement_sql("f1r")}, ',' ORDER BY n) AS j FROM f1r GROUP BY call_id),
q1 AS (SELECT ca.call_id, '{{"rfc":' || doc_id || ',"filter":{{"section":"' || s || '","level":"' || coalesce(lv, 'all') || '"}},"stats":{{"total":' || coalesce(k, 0) || ',"byLevel":{{' || coalesce(l, '') || '}}}},"requirements":[' || coalesce(j, '') || ']{_note_sql("requirements")}' AS text FROM ca LEFT JOIN f1l ON ca.call_id = f1l.call_id LEFT JOIN f1j ON ca.call_id = f1j.call_id WHERE tool = 1),
f2j AS (SELECT doc_id, count(*) AS k, string_agg('{{"term":' || to_json(term) || ',"definition":' || to_json(definition) || ',"section":' || to_json(section) || '}}', ',' ORDER BY def_ord) AS j FROM df WHERE contains(lower(term), 'host') OR contains(lower(definition), 'host') GROUP BY doc_id),
q2 AS (SELECT call_id, '{{"rfc":' || ca.doc_id || ',"searchTerm":"HOST","count":' || coalesce(k, 0) || ',"definitions":[' || coalesce(j, '') || ']{_note_sql("definitions")}' AS text FROM ca LEFT JOIN f2j ON ca.doc_id = f2j.doc_id WHERE tool = 2),
f3j AS (SELECT doc_id, string_agg('{{"rfcNumber":' || rfc_number || ',"title":"RFC ' || rfc_number || '","anchor":"RFC' || rfc_number || '"}}', ',' ORDER BY ref_ord) AS j FROM rf GROUP BY doc_id),
q3 AS (SELECT call_id, '{{"rfc":' || ca.doc_id || ',"normative":[],"informative":[' || coalesce(j, '') || ']{_note_sql("dependencies")}' AS text FROM ca LEFT JOIN f3j ON ca.doc_id = f3j.doc_id WHERE tool = 3),
f4j AS (SELECT x2.doc_id, x2.seq, string_agg('{{"number":' || to_json(target) || ',"title":' || to_json(coalesce(o2.title, 'Unknown')) || '}}', ',' ORDER BY o) AS j FROM x2 LEFT JOIN ix ON x2.doc_id = ix.doc_id AND x2.target = ix.key LEFT JOIN sec o2 ON ix.doc_id = o2.doc_id AND ix.s = o2.seq GROUP BY x2.doc_id, x2.seq),
q4 AS (SELECT call_id, CASE WHEN sec.seq IS NULL THEN '{{"error":"Section ' || ca.s || ' not found"}}' ELSE '{{"rfc":' || ca.doc_id || ',"section":"' || ca.s || '","title":' || to_json(sec.title) || ',"relatedSections":[' || coalesce(j, '') || ']{_note_sql("sections")}' END AS text FROM ca LEFT JOIN ix ON ca.doc_id = ix.doc_id AND ca.s = ix.key LEFT JOIN sec ON ix.doc_id = sec.doc_id AND ix.s = sec.seq LEFT JOIN f4j ON sec.doc_id = f4j.doc_id AND sec.seq = f4j.seq WHERE tool = 4),
f5s AS ({_STATS.format(where="WHERE contains(coalesce(subject, ''), 'client') OR NOT contains(coalesce(subject, ''), 'server')")}),
q5 AS (SELECT call_id, '{{"rfc":' || ca.doc_id || ',"role":"client","stats":{{"must":' || coalesce(must, 0) || ',"should":' || coalesce(should, 0) || ',"may":' || coalesce(may, 0) || ',"total":' || coalesce(total, 0) || '}},"markdown":' || to_json(markdown) || '{_note_sql("checklist")}' AS text FROM ca JOIN mk ON ca.doc_id = mk.doc_id LEFT JOIN f5s ON ca.doc_id = f5s.doc_id WHERE tool = 5),
rn AS (SELECT *, req_ord AS n FROM req),
f6s AS (SELECT stmt_id, doc_id, req_ord, score, matched, coalesce(req_subject = stmt_subject, false) AS sm, coalesce(level = stmt_level, false) AS lm, row_number() OVER (PARTITION BY stmt_id ORDER BY score DESC, req_ord) AS rank FROM sc WHERE score > 0),
f6m AS (SELECT stmt_id, string_agg({_requirement_sql("rn", """',"_matchScore":' || score || ',"_matchedKeywords":' || CASE matched WHEN '' THEN '[]' ELSE to_json(string_split(matched, ' ')) END || ',"_subjectMatch":' || sm || ',"_levelMatch":' || lm""")}, ',' ORDER BY rank) AS j FROM f6s JOIN rn ON f6s.doc_id = rn.doc_id AND f6s.req_ord = rn.req_ord WHERE rank <= {dims.TOP_MATCHES} GROUP BY stmt_id),
f6c AS (SELECT stmt_id, string_agg('{{"requirement":' || {_requirement_sql("rn")} || ',"reason":' || to_json(reason) || '}}', ',' ORDER BY rn.req_ord) AS j FROM cf JOIN rn ON cf.doc_id = rn.doc_id AND cf.req_ord = rn.req_ord GROUP BY stmt_id),
q6 AS (SELECT call_id, '{{"rfc":' || sa.doc_id || ',"statement":' || to_json(statement) || ',"analysis":{{"detectedLevel":' || coalesce(to_json(stmt_level)::VARCHAR, 'null') || ',"detectedSubject":' || coalesce(to_json(stmt_subject)::VARCHAR, 'null') || '}},"isValid":' || (c.j IS NULL) || ',"matchingRequirements":[' || coalesce(m.j, '') || '],"conflicts":[' || coalesce(c.j, '') || ']' || CASE WHEN len({_HINTS}) > 0 THEN ',"suggestions":' || to_json({_HINTS}) ELSE '' END || '{_note_sql("validation")}' AS text
  FROM ca JOIN sa ON ca.call_id = sa.stmt_id LEFT JOIN f6m m ON sa.stmt_id = m.stmt_id LEFT JOIN f6c c ON sa.stmt_id = c.stmt_id WHERE tool = 6),
q7 AS (SELECT call_id, CASE tool WHEN 7 THEN '{{"error":"Unknown tool: summarise"}}' ELSE '{{"error":"RFC number must be positive, got ' || -doc_id || '"}}' END AS text FROM ca WHERE tool > 6)"""
_TOOLS = ("get_rfc_structure", "get_requirements", "get_definitions", "get_rfc_dependencies", "get_related_sections", "generate_checklist", "validate_statement", "summarise", "get_definitions")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each statement, by its number one of seven tools, a tool that doesn't exist or a wrong number."""
    at = F.expr("cast(stmt_id % 9 as int)")

    def only(tool: int, value: str):
        return F.when(at == tool, F.expr(value))

    section = F.when(at.isin(1, 4), F.expr("cast(1 + stmt_id % 7 as string)"))
    arguments = F.struct(
        F.when(at == 8, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("rfc"), only(0, "true").alias("includeContent"), section.alias("section"), only(1, "CASE WHEN stmt_id % 2 = 0 THEN 'MUST' END").alias("level"),
        only(2, "'HOST'").alias("term"), only(5, "'client'").alias("role"), only(6, "statement").alias("statement"),
    )
    return C.statements(spark, sf_dir).select(F.col("stmt_id").alias("call_id"), F.get(F.array(*map(F.lit, _TOOLS)), at).alias("tool"), F.parse_json(F.to_json(arguments)).alias("arguments"))


@query(f"WITH {C.TEXT_SQL}, {C.STATEMENTS_SQL}, {C.CONFLICTS_SQL}, {_markdown_cte('client')}, {_DEF}, {_REFS}, {_XREFS}, {_tree_sql()}, {_CALLS} SELECT ca.call_id, {list(_TOOLS)}[ca.tool + 1] AS tool, q.text, ca.tool > 6 AS is_error FROM ca JOIN ({' UNION ALL '.join(f'SELECT * FROM q{i}' for i in range(8))}) q ON ca.call_id = q.call_id")
def call_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = C.text_documents(spark, sf_dir).withColumn("source", F.lit("text"))
    return calls.call_batch(_asked(spark, sf_dir), raw, text_parse.parse_text, STAMP)


# -- sources


def _candidates(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Answers of three sources, some of them invalid, by event type."""
    user = F.col("user_id")  # one document a user; even ones from XML_FROM on, odd ones before
    number = dims.XML_FROM + F.when(user % 2 == 0, user).otherwise(-user)
    rows = C.table(spark, sf_dir, "events").groupBy(number.cast("int").alias("doc_id"), "event_type").agg(F.min("event_id").alias("e"))
    good = "concat('<rfc number=', e, '>')" if kind == "xml" else "concat('RFC ', e)"
    bad = "e % 3 = 0" if kind == "xml" else "e % 5 = 0"
    return rows.select("doc_id", F.col("event_type").alias("source_name"), F.dense_rank().over(_by_type()).alias("priority"), F.expr(f"CASE WHEN NOT ({bad}) THEN 'not found' ELSE {good} END").alias("body"), F.lit(None).cast("string").alias("error"))


def _by_type():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("event_type")


_CANDIDATES = f"""k0 AS (SELECT ({dims.XML_FROM} + CASE WHEN user_id % 2 = 0 THEN user_id ELSE -user_id END)::INTEGER AS doc_id, event_type, min(event_id) AS e FROM events GROUP BY 1, 2),
kx AS (SELECT doc_id, min_by(event_type, event_type) FILTER (e % 3 = 0) AS source_name, min_by('<rfc number=' || e || '>', event_type) FILTER (e % 3 = 0) AS body FROM k0 GROUP BY doc_id),
kt AS (SELECT doc_id, min_by(event_type, event_type) FILTER (e % 5 = 0) AS source_name, min_by('RFC ' || e, event_type) FILTER (e % 5 = 0) AS body FROM k0 GROUP BY doc_id)"""


@query(f"WITH {_CANDIDATES} SELECT doc_id, source_name, body, body IS NULL AS failed FROM kx")
def source_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.first_valid(_candidates(spark, sf_dir, "xml"), "xml").select("doc_id", "source_name", "body", F.col("error").isNotNull().alias("failed"))


@query(f"WITH {_CANDIDATES} SELECT kx.doc_id, CASE WHEN kx.body IS NOT NULL THEN 'xml' WHEN kx.doc_id < {dims.XML_FROM} AND kt.body IS NOT NULL THEN 'text' END AS source, CASE WHEN kx.body IS NOT NULL THEN kx.body WHEN kx.doc_id < {dims.XML_FROM} THEN kt.body END AS body FROM kx JOIN kt ON kx.doc_id = kt.doc_id")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml, text = (scan.first_valid(_candidates(spark, sf_dir, k), k) for k in ("xml", "text"))
    return scan.with_fallback(xml, text).select("doc_id", "source", "body")


_ANSWERS = f"""j0 AS (SELECT event_id AS e, json_extract_string(props, '$.k')::INTEGER AS k FROM events), j1 AS (SELECT *, e % 8 IN (0, 4) AS broken, ['Proposed Standard', 'Best Current Practice', 'Experimental', 'Historic', 'Internet Standard', 'other'][(e % 6 + 1)::INTEGER] AS level FROM j0)"""


@query(f"""WITH {_ANSWERS} SELECT e AS number, CASE WHEN broken OR e % 8 = 1 THEN 'RFC ' || e ELSE 'T' || e END AS title, CASE WHEN broken THEN '' ELSE '2024-01-' || k END AS date, CASE WHEN broken THEN 'info' WHEN e % 6 IN (0, 4) THEN 'std' WHEN e % 6 = 1 THEN 'bcp' WHEN e % 6 = 2 THEN 'exp' WHEN e % 6 = 3 THEN 'historic' ELSE 'info' END AS category,
CASE WHEN broken OR k % 4 = 0 THEN 'IETF' WHEN k % 4 = 1 THEN 'IAB' WHEN k % 4 = 2 THEN 'IRTF' ELSE 'independent' END AS stream, CASE WHEN e % 8 > 5 THEN 'about ' || k END AS abstract, CASE e % 8 WHEN 0 THEN '{{"title": "T' || e WHEN 4 THEN '["' || e || '"]' END AS rescued FROM j1""")
def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.metadata(C.metadata_answers(spark, sf_dir)).drop("authors")


# -- marked-up documents


def _markup(spark: SparkSession, sf_dir: str, once: bool = False) -> Parsed:
    return markup_parse.parse_markup(C.markup_documents(spark, sf_dir), once)


@query(f"WITH {C.EVENTS_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a))::INTEGER AS seq, 'section-' || a AS number, 'part' || a AS anchor, 'Part ' || a AS title FROM (SELECT DISTINCT doc_id, 1 + e % 9 AS a FROM ev)")
def xml_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markup(spark, sf_dir).sections.select("doc_id", "seq", "number", "anchor", "title")


_XML_REQ = f"WITH {C.EVENTS_SQL}, o AS (SELECT doc_id, 'section-' || (1 + e % 9) AS section, level, sentence, (row_number() OVER (PARTITION BY doc_id ORDER BY 1 + e % 9, e % 5 = 0, e))::INTEGER AS req_ord FROM ev)"


@query(_XML_REQ + " SELECT doc_id, req_ord, 'R-' || section || '-' || req_ord AS id, level, sentence AS full_context FROM o")
def xml_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements.extract_requirements(_markup(spark, sf_dir)).select("doc_id", "req_ord", "id", "level", "full_context")


@query(f"WITH {C.EVENTS_SQL}, c AS (SELECT DISTINCT doc_id, 2000 + k AS n FROM ev WHERE e % 8 = 3) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n % 2, n) - 1)::INTEGER AS ref_ord, CASE n % 2 WHEN 0 THEN 'normative' ELSE 'informative' END AS kind, 'RFC' || n AS anchor, n::INTEGER AS rfc_number, 'Document ' || n AS title FROM c")
def xml_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markup(spark, sf_dir).refs.drop("target")


@query(f"WITH {C.EVENTS_SQL}, c AS (SELECT DISTINCT doc_id, 2000 + k AS n FROM ev WHERE e % 8 = 3) SELECT doc_id, count(*) FILTER (n % 2 = 0) AS normative, count(*) FILTER (n % 2 = 1) AS informative FROM c GROUP BY doc_id")
def xml_ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.reference_counts(_markup(spark, sf_dir).refs)


@query(f"WITH {C.EVENTS_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY 1 + e % 9, e))::INTEGER AS def_ord, subject || ' ' || e AS term, 'what may ' || verb AS definition, 'section-' || (1 + e % 9) AS section FROM ev WHERE e % 10 = 3")
def xml_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markup(spark, sf_dir).definitions


@query(f"WITH {C.EVENTS_SQL}, t AS (SELECT DISTINCT doc_id, 1 + e % 9 AS a, 'section-' || (1 + e % 9) AS own, u FROM (SELECT *, unnest([(1 + e % 9) || '.' || (1 + e % 4) || '.', (1 + e % 7)::VARCHAR]) AS u FROM ev WHERE e % 8 = 2 AND e % 5 <> 0)), s AS (SELECT DISTINCT doc_id, (1 + e % 9)::VARCHAR AS n FROM ev) SELECT t.doc_id, own AS section_id, u AS related_number, CASE WHEN s.n IS NULL THEN 'Unknown' ELSE 'Part ' || s.n END AS related_title FROM t LEFT JOIN s ON t.doc_id = s.doc_id AND t.u = s.n")
def xml_related_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.related_sections(_markup(spark, sf_dir, once=True)).select("doc_id", "section_id", "related_number", "related_title")


def _mixed(spark: SparkSession, sf_dir: str) -> Parsed:
    return markup_parse.parse_markup(C.mixed_documents(spark, sf_dir))


#: A paragraph's own text, without what is inside its elements; only without any the elements', tag by tag.
@query(f"WITH {C.EVENTS_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1)::INTEGER AS block_ord, CASE e % 4 WHEN 0 THEN 'pre' || e || 'post' || k WHEN 1 THEN 'a' || k || ' c' || k || ' b' || e WHEN 2 THEN 'x' || e || ' z' || e || ' y' || k || ' w' ELSE 'tail' || e END AS content FROM ev")
def xml_mixed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).blocks.where("type = 'text'").select("doc_id", "block_ord", "content")


#: After all paragraphs, first code, then drawings; those without content or attributes are left out.
@query(f"WITH {C.EVENTS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM ev GROUP BY doc_id), b AS (SELECT doc_id, e, k, CASE WHEN e % 5 = 1 THEN 'artwork' ELSE 'sourcecode' END AS type FROM ev WHERE e % 5 IN (0, 1, 3)) SELECT b.doc_id, (n + row_number() OVER (PARTITION BY b.doc_id ORDER BY type DESC, e) - 1)::INTEGER AS block_ord, type, CASE WHEN e % 5 = 0 THEN 't' || e % 3 END AS language, CASE e % 5 WHEN 0 THEN 'r' || e || ' = ' || k WHEN 1 THEN '+-' || k || '-+' ELSE k::VARCHAR END AS content FROM b JOIN n ON b.doc_id = n.doc_id")
def xml_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).blocks.where("type IN ('sourcecode', 'artwork')").select("doc_id", "block_ord", "type", "language", "content")


#: Normative ones first, though their list comes second; of a list those in groups after the others.
@query(f"WITH {C.EVENTS_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY e % 3 = 2, e % 3 = 1, e) - 1)::INTEGER AS ref_ord, CASE WHEN e % 3 = 2 THEN 'informative' ELSE 'normative' END AS kind, 'R' || e AS anchor, k AS rfc_number, 'T' || k AS title FROM ev")
def xml_reference_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).refs.select("doc_id", "ref_ord", "kind", "anchor", "rfc_number", "title")


_TAGS = " UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, unnest(range(0, len(x))) AS ord, unnest(x) AS y FROM (SELECT page_id, regexp_extract_all(html, '(?s)<{t}>(.*?)</{t}>', 1) AS x FROM pages)" for t in ("h1", "p", "li"))


@query(f"WITH b AS ({_TAGS}), c AS (SELECT page_id, tag, ord::INTEGER AS ord, trim(regexp_replace(y, '<[^>]*>', '', 'g'), {C._W}) AS text FROM b) SELECT * FROM c WHERE text <> ''")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_parse.html_blocks(C.table(spark, sf_dir, "pages"))


@query("""SELECT page_id, unnest(range(0, len(x)))::INTEGER AS ord, unnest(x) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM pages)""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_parse.html_links(C.table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
