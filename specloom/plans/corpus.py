"""Specification documents derived from the events table, in Spark and, the same, in SQL.

The synthetic tables hold no requirement keywords, so documents are written from events: a sentence,
and at times a header or a definition, for each event; a document for each user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom import dims

NOUNS = ("message", "frame", "connection", "request", "data")
TITLES = ("Introduction", "Security Considerations", "Frame Layout", "closing", "Error Codes", "Terminology", "Connection Management")
VERBS = {"click": "send", "view": "receive", "purchase": "accept", "signup": "authenticate", "error": "close"}
PREFIXES = ("The ", "A ", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, at: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({at} % {len(values)} + 1 as int)"))


def sentences(events: DataFrame) -> DataFrame:
    """e, doc_id, k, level, subject, verb, noun, sentence, chunk: one row an event."""
    rows = events.select(F.col("event_id").alias("e"), (F.col("user_id") + 1).cast("int").alias("doc_id"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")
    verb = F.lit(None).cast("string")
    for kind, v in VERBS.items():
        verb = F.when(F.col("event_type") == kind, v).otherwise(verb)
    rows = rows.withColumns({"level": _pick(dims.LEVELS, "e"), "subject": _pick(dims.SUBJECT_TERMS, "e"), "verb": verb, "noun": _pick(NOUNS, "e")})
    suffix = F.expr("""CASE e % 8 WHEN 0 THEN concat(' if the value is ', k) WHEN 1 THEN ' unless disabled' WHEN 2 THEN concat(', see Section ', 1 + e % 9, '.', 1 + e % 4)
        WHEN 3 THEN concat(' as in RFC ', 2000 + k) WHEN 4 THEN ' without masking' WHEN 6 THEN ' when idle, except errors' ELSE '' END""")
    rows = rows.withColumn("sentence", F.concat(_pick(PREFIXES, "e"), "subject", F.lit(" "), "level", F.lit(" "), "verb", F.lit(" the "), "noun", suffix, F.lit(".")))
    header = F.expr("""CASE WHEN e % 12 = 0 THEN concat(1 + e % 9, '.  ') WHEN e % 18 = 6 THEN concat(1 + e % 9, '.', 1 + e % 4, '.', 1 + k % 5, '  ')
        WHEN e % 6 = 0 THEN concat(1 + e % 9, '.', 1 + e % 4, '  ') END""")
    titled = F.coalesce(F.concat(header, _pick(TITLES, "e"), F.lit("\n\n")), F.lit(""))
    odd = F.expr("CASE WHEN e % 13 = 0 THEN concat(100 + e % 50, ' Items\n') WHEN e % 17 = 0 THEN '3 abc\n' ELSE '' END")
    definition = F.when(F.expr("e % 10 = 3"), F.concat(F.initcap("subject"), F.lit(": what may "), "verb", F.lit(" number "), F.col("k").cast("string"), F.lit("\n"))).otherwise("")
    return rows.withColumn("chunk", F.concat(titled, odd, definition, "sentence", F.expr("CASE WHEN e % 4 = 1 THEN '\n\n' ELSE '\n' END")))


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, body."""
    rows = sentences(table(spark, sf_dir, "events")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("e", "chunk"))), lambda x: x["chunk"]), "").alias("_b"))
    head = F.concat(F.lit("Network Working Group: notes\nRequest for Comments number "), F.col("doc_id").cast("string"), F.lit("\n\nThe Exchange of Unit "), F.col("doc_id").cast("string"), F.lit("\n\n"))
    return rows.select("doc_id", F.lit("text").alias("source"), F.concat(head, "_b").alias("body"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stmt_id, doc_id, statement: one for each document and kind of event."""
    rows = sentences(table(spark, sf_dir, "events")).groupBy("doc_id", "event_type").agg(F.min("e").alias("e"))
    rows = rows.withColumns({"subject": _pick(dims.SUBJECT_TERMS, "e"), "noun": _pick(NOUNS, "(e div 2)"), "verb": _pick(list(VERBS.values()), "e")})
    said = F.expr("""CASE e % 4 WHEN 0 THEN concat('The ', subject, ' MAY ', verb, ' the ', noun) WHEN 1 THEN concat('The ', subject, ' does not ', verb, ' the ', noun)
        WHEN 2 THEN concat('Its ', subject, ' should send unmasked ', noun, ', and ', subject) ELSE concat('Any ', verb, ' of a ', noun, ' is never sent') END""")
    return rows.select(F.col("e").alias("stmt_id"), "doc_id", said.alias("statement"))


def markup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, body: the same events as marked-up documents, a section for each of nine numbers."""
    rows = sentences(table(spark, sf_dir, "events")).withColumn("a", F.expr("1 + e % 9"))
    paragraph = F.concat(F.lit("<t>"), F.regexp_replace("sentence", "(MUST|SHOULD)", "<bcp14>$1</bcp14>"), F.expr("CASE WHEN e % 8 = 2 THEN concat(' <xref target=\"section-', 1 + e % 7, '\"/>') ELSE '' END"), F.lit("</t>"))
    item = F.concat(F.lit("<li>"), "sentence", F.lit("</li>"))
    term = F.concat(F.lit("<dt>"), "subject", F.lit(" "), F.col("e").cast("string"), F.lit("</dt><dd>what may "), "verb", F.lit("</dd>"))

    def gathered(value: Column, only: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.expr(only), F.struct("e", value.alias("v"))))), lambda x: x["v"]), "")

    parts = rows.groupBy("doc_id", "a").agg(gathered(paragraph, "e % 5 <> 0").alias("t"), gathered(item, "e % 5 = 0").alias("li"), gathered(term, "e % 10 = 3").alias("dl"))
    wrapped = F.concat(F.lit('<section pn="section-'), F.col("a").cast("string"), F.lit('" anchor="part'), F.col("a").cast("string"), F.lit('"><name>Part '), F.col("a").cast("string"), F.lit("</name>"), "t", F.when(F.col("li") != "", F.concat(F.lit("<ul>"), "li", F.lit("</ul>"))).otherwise(""), F.when(F.col("dl") != "", F.concat(F.lit("<dl>"), "dl", F.lit("</dl>"))).otherwise(""), F.lit("</section>"))
    middle = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", wrapped.alias("s")))), lambda x: x["s"]), "").alias("middle"))
    cited = rows.where("e % 8 = 3").select("doc_id", F.expr("2000 + k").alias("n")).distinct()

    def reference(n: Column) -> Column:
        s = n.cast("string")
        return F.concat(F.lit('<reference anchor="RFC'), s, F.lit('"><front><title>Document '), s, F.lit('</title></front><seriesInfo name="RFC" value="'), s, F.lit('"/></reference>'))

    def listed(only: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.expr(only), F.col("n")))), reference), "")

    refs = cited.groupBy("doc_id").agg(listed("n % 2 = 0").alias("even"), listed("n % 2 = 1").alias("odd"))
    both = middle.join(refs, "doc_id", "left").fillna("", ["even", "odd"])
    s = F.col("doc_id").cast("string")
    body = F.concat(F.lit('<?xml version="1.0"?><rfc number="'), s, F.lit('" docName="draft-'), s, F.lit('"><front><title>Unit '), s, F.lit("</title></front><middle>"), "middle", F.lit('</middle><back><references><name>References</name><references anchor="normative-refs"><name>N</name>'), "even", F.lit('</references><references anchor="other-refs"><name>O</name>'), "odd", F.lit("</references></references></back></rfc>"))
    return both.select("doc_id", F.lit("xml").alias("source"), body.alias("body"))


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, body: a section a user whose paragraphs mix text and elements, with code, drawings and reference
    groups; a paragraph and a reference for each event."""
    rows = sentences(table(spark, sf_dir, "events"))
    said = F.expr("""CASE e % 4 WHEN 0 THEN concat(' pre', e, ' <em>in', k, '</em> post', k) WHEN 1 THEN concat('<em>a', k, '</em> <strong>b', e, '</strong><em>c', k, '</em>')
        WHEN 2 THEN concat('<span><em>x', e, '</em> <strong>y', k, '</strong><em>z', e, '</em></span>\n<em>w</em>') ELSE concat('<em>q', k, '</em> tail', e) END""")
    code = F.expr("CASE e % 5 WHEN 0 THEN concat('<sourcecode type=\"t', e % 3, '\">r', e, ' = ', k, '</sourcecode>') WHEN 1 THEN concat('<artwork>+-', k, '-+</artwork>') WHEN 2 THEN '<artwork/>' WHEN 3 THEN concat('<sourcecode>', k, '</sourcecode>') ELSE '' END")
    cited = F.expr("concat('<reference anchor=\"R', e, '\"><front><title>T', k, '</title></front><seriesInfo name=\"BCP\" value=\"1\"/><seriesInfo name=\"RFC\" value=\"', k, '\"/></reference>')")
    grouped = F.when(F.expr("e % 3 = 1"), F.concat(F.lit('<referencegroup anchor="g">'), cited, F.lit("</referencegroup>"))).otherwise(cited)

    def gathered(value: Column, only: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.expr(only), F.struct("e", value.alias("v"))))), lambda x: x["v"]), "")

    parts = rows.groupBy("doc_id").agg(gathered(F.concat(F.lit("<t>"), said, F.lit("</t>"), code), "true").alias("t"), gathered(grouped, "e % 3 <> 2").alias("n"), gathered(grouped, "e % 3 = 2").alias("i"))
    body = F.concat(F.lit('<rfc><front><title>M</title></front><middle><section pn="section-1"><name>One</name>'), "t", F.lit('</section></middle><back><references><references anchor="i"><name>Other</name>'), "i", F.lit('</references><references anchor="n"><name>Normative References</name>'), "n", F.lit("</references></references></back></rfc>"))
    return parts.select("doc_id", body.alias("body"))


def metadata_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, json: an answer for each event, every fourth one broken or of another shape."""
    answer = F.expr("""CASE e % 8 WHEN 0 THEN concat('{"title": "T', e) WHEN 4 THEN concat('["', e, '"]')
        ELSE concat('{"title": ', CASE WHEN e % 8 = 1 THEN 'null' ELSE concat('"T', e, '"') END, ', "time": "2024-01-', k, '", "std_level": "', element_at(array('Proposed Standard', 'Best Current Practice', 'Experimental', 'Historic', 'Internet Standard', 'other'), cast(e % 6 + 1 AS int)), '", "stream": "', element_at(array('ietf', 'IAB', 'irtf', 'ISE'), cast(k % 4 + 1 AS int)), '"', CASE WHEN e % 8 = 5 THEN ', "abstract": ""' WHEN e % 8 > 5 THEN concat(', "abstract": "about ', k, '"') ELSE '' END, '}') END""")
    return sentences(table(spark, sf_dir, "events")).select(F.col("e").alias("doc_id"), answer.alias("json"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_W = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: e and its words, as in sentences().
EVENTS_SQL = f"""
e0 AS (SELECT event_id AS e, (user_id + 1)::INTEGER AS doc_id, json_extract_string(props, '$.k')::INTEGER AS k, event_type FROM events),
e1 AS (SELECT *, {_list(dims.LEVELS)}[(e % {len(dims.LEVELS)} + 1)::INTEGER] AS level, {_list(dims.SUBJECT_TERMS)}[(e % {len(dims.SUBJECT_TERMS)} + 1)::INTEGER] AS subject,
  CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERBS.items())} END AS verb, {_list(NOUNS)}[(e % {len(NOUNS)} + 1)::INTEGER] AS noun FROM e0),
ev AS (SELECT *, {_list(PREFIXES)}[(e % 3 + 1)::INTEGER] || subject || ' ' || level || ' ' || verb || ' the ' || noun ||
  CASE e % 8 WHEN 0 THEN ' if the value is ' || k WHEN 1 THEN ' unless disabled' WHEN 2 THEN ', see Section ' || (1 + e % 9) || '.' || (1 + e % 4) WHEN 3 THEN ' as in RFC ' || (2000 + k) WHEN 4 THEN ' without masking' WHEN 6 THEN ' when idle, except errors' ELSE '' END || '.' AS sentence FROM e1)"""

#: The text documents, parsed: bodies, lines, sections, paragraphs, keywords, requirements.
TEXT_SQL = rf"""{EVENTS_SQL},
ch AS (SELECT *, coalesce(CASE WHEN e % 12 = 0 THEN (1 + e % 9) || '.  ' WHEN e % 18 = 6 THEN (1 + e % 9) || '.' || (1 + e % 4) || '.' || (1 + k % 5) || '  ' WHEN e % 6 = 0 THEN (1 + e % 9) || '.' || (1 + e % 4) || '  ' END || {_list(TITLES)}[(e % {len(TITLES)} + 1)::INTEGER] || chr(10) || chr(10), '')
  || CASE WHEN e % 13 = 0 THEN (100 + e % 50) || ' Items' || chr(10) WHEN e % 17 = 0 THEN '3 abc' || chr(10) ELSE '' END
  || CASE WHEN e % 10 = 3 THEN upper(subject[1]) || subject[2:] || ': what may ' || verb || ' number ' || k || chr(10) ELSE '' END
  || sentence || CASE WHEN e % 4 = 1 THEN chr(10) || chr(10) ELSE chr(10) END AS chunk FROM ev),
raw AS (SELECT doc_id, 'Network Working Group: notes' || chr(10) || 'Request for Comments number ' || doc_id || chr(10) || chr(10) || 'The Exchange of Unit ' || doc_id || chr(10) || chr(10) || string_agg(chunk, '' ORDER BY e) AS body FROM ch GROUP BY doc_id),
l0 AS (SELECT doc_id, string_split(body, chr(10)) AS ls FROM raw),
l1 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM l0),
l2 AS (SELECT *, trim(line, {_W}) AS t FROM l1),
l3 AS (SELECT *, regexp_matches(t, '^(\d+(?:\.\d+)*\.?)\s+(.+)$') AS hd, regexp_replace(regexp_extract(t, '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 1), '\.$', '') AS number, regexp_extract(t, '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 2) AS title FROM l2),
l4 AS (SELECT *, hd AND CASE WHEN len(string_split(number, '.')) > {dims.MAX_DEPTH} THEN false WHEN try_cast(string_split(number, '.')[1] AS BIGINT) > {dims.MAX_FIRST_NUMBER} THEN false WHEN length(trim(title)) < 3 THEN false
  WHEN regexp_matches(trim(title), '^[a-z]') AND length(trim(title)) < 20 THEN false WHEN {" OR ".join(f"contains(lower(title), '{w}')" for w in dims.HEADER_WORDS)} THEN true
  WHEN regexp_matches(trim(title), '^[A-Z]') AND length(trim(title)) >= 5 THEN true ELSE len(string_split(number, '.')) >= 2 END AS valid FROM l3),
l5 AS (SELECT *, sum(valid::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no)::INTEGER AS seq FROM l4),
sec AS (SELECT doc_id, seq, number, title, len(string_split(number, '.'))::INTEGER AS depth FROM l5 WHERE valid),
cont AS (SELECT doc_id, seq, string_agg(line, chr(10) ORDER BY line_no) AS content FROM l5 WHERE seq > 0 AND NOT valid GROUP BY doc_id, seq),
p0 AS (SELECT doc_id, seq, list_filter(list_transform(string_split_regex(content, '\n\s*\n'), lambda x: trim(x, {_W})), lambda x: x <> '') AS ps FROM cont),
par AS (SELECT doc_id, seq, unnest(ps) AS content, unnest(range(0, len(ps))) AS block_ord FROM p0),
m0 AS (SELECT *, regexp_extract_all(content, '\b(MUST NOT|MUST|REQUIRED|SHALL NOT|SHALL|SHOULD NOT|SHOULD|RECOMMENDED|NOT RECOMMENDED|MAY|OPTIONAL)\b') AS ks, string_split_regex(content, '\b(?:MUST NOT|MUST|REQUIRED|SHALL NOT|SHALL|SHOULD NOT|SHOULD|RECOMMENDED|NOT RECOMMENDED|MAY|OPTIONAL)\b') AS ss FROM par),
m1 AS (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM m0),
m2 AS (SELECT *, ks[i] AS level, (length(array_to_string(ss[1:i], '')) + length(array_to_string(ks[1:i - 1], '')))::INTEGER AS pos FROM m1),
m3 AS (SELECT *, CASE WHEN regexp_matches(content[1:pos], '[.!?]\s') THEN regexp_extract(content[1:pos], '(?s)^.*[.!?](\s.*)$', 1) ELSE content[1:pos] END || regexp_extract(content[pos + 1:], '(?s)^[^.!?]*[.!?]?') AS s FROM m2),
r0 AS (SELECT m3.doc_id, m3.seq, block_ord, i, level, trim(s, {_W}) AS text, content AS full_context, number AS section, title AS section_title FROM m3 JOIN sec ON m3.doc_id = sec.doc_id AND m3.seq = sec.seq),
req AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, block_ord, i)::INTEGER AS req_ord,
  lower(nullif(regexp_extract(text, '(?i)^(?:The\s+)?(\w+(?:\s+\w+)?)\s+(?:MUST|SHALL|SHOULD|MAY)', 1), '')) AS subject,
  nullif(trim(regexp_extract(text, '(?i)\b(if|when|unless|where|in case)\s+([^,.]+)', 2), {_W}), '') AS condition,
  nullif(trim(regexp_extract(text, '(?i)\b(unless|except|excluding)\s+([^,.]+)', 2), {_W}), '') AS exception,
  nullif(trim(CASE level {" ".join(f"WHEN '{x}' THEN regexp_extract(text, '(?i){x}" + r"\s+(.+?)(?:\.|,|\z)', 1)" for x in dims.LEVELS)} END, {_W}), '') AS action FROM r0)"""

_SUBJECTS = "(" + ", ".join(f"'{x}'" for x in dims.SUBJECT_TERMS) + ")"


def subject_sql(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(lower({x}), '\s+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: w IN {_SUBJECTS})[1]"


def level_sql(x: str) -> str:
    return rf"nullif(regexp_extract(upper({x}), '\b(MUST NOT|MUST|REQUIRED|SHALL NOT|SHALL|SHOULD NOT|SHOULD|RECOMMENDED|NOT RECOMMENDED|MAY|OPTIONAL)\b', 1), '')"


def keyword_list_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in dims.STOP_WORDS)
    return rf"list_filter(list_transform(string_split_regex(lower({x}), '\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) >= {dims.MIN_KEYWORD} AND w NOT IN ({stop}))"


def weight_sql(x: str) -> str:
    technical = ", ".join(f"'{w}'" for w in dims.TECHNICAL_TERMS)
    return f"(CASE WHEN {x} IN {_SUBJECTS} THEN {dims.SUBJECT_WEIGHT} WHEN {x} IN ({technical}) THEN {dims.TECHNICAL_WEIGHT} ELSE {dims.REGULAR_WEIGHT} END)"


#: Statements and their analysis; kws: rows of keywords.
STATEMENTS_SQL = rf"""
st0 AS (SELECT doc_id, event_type, min(e) AS e FROM ev GROUP BY doc_id, event_type),
st1 AS (SELECT e, doc_id, {_list(dims.SUBJECT_TERMS)}[(e % 12 + 1)::INTEGER] AS subject, {_list(NOUNS)}[((e // 2) % {len(NOUNS)} + 1)::INTEGER] AS noun, {_list(VERBS.values())}[(e % {len(VERBS)} + 1)::INTEGER] AS verb FROM st0),
st AS (SELECT e AS stmt_id, doc_id, CASE e % 4 WHEN 0 THEN 'The ' || subject || ' MAY ' || verb || ' the ' || noun WHEN 1 THEN 'The ' || subject || ' does not ' || verb || ' the ' || noun WHEN 2 THEN 'Its ' || subject || ' should send unmasked ' || noun || ', and ' || subject ELSE 'Any ' || verb || ' of a ' || noun || ' is never sent' END AS statement FROM st1),
sa AS (SELECT *, {level_sql("statement")} AS stmt_level, {subject_sql("statement")} AS stmt_subject, {keyword_list_sql("statement")} AS kl FROM st),
sk AS (SELECT stmt_id, unnest(kl) AS keyword, unnest(range(0, len(kl))) AS i FROM sa),
kw AS (SELECT stmt_id, keyword, min(i) AS i, (count(*) * {weight_sql("keyword")})::BIGINT AS weight FROM sk GROUP BY stmt_id, keyword),
rq AS (SELECT *, coalesce(subject, {subject_sql("text")}) AS req_subject FROM req),
pr AS (SELECT sa.stmt_id, sa.doc_id, sa.statement, stmt_level, stmt_subject, req_ord, level, text, full_context, action, req_subject FROM sa JOIN rq ON sa.doc_id = rq.doc_id),
hit AS (SELECT pr.stmt_id, pr.req_ord, sum(weight) FILTER (contains(lower(text || ' ' || full_context), keyword)) AS base, string_agg(keyword, ' ' ORDER BY i) FILTER (contains(lower(text || ' ' || full_context), keyword)) AS matched, count(*) FILTER (contains(lower(text), keyword)) AS overlap, count(*) AS n_kw FROM pr JOIN kw ON pr.stmt_id = kw.stmt_id GROUP BY pr.stmt_id, pr.req_ord),
sc AS (SELECT pr.*, coalesce(matched, '') AS matched, overlap, n_kw, (coalesce(base, 0) + coalesce((req_subject = stmt_subject)::INTEGER, 0) * {dims.SUBJECT_BONUS} + coalesce((level = stmt_level)::INTEGER, 0) * {dims.LEVEL_BONUS})::BIGINT AS score FROM pr LEFT JOIN hit ON pr.stmt_id = hit.stmt_id AND pr.req_ord = hit.req_ord)"""


def _any_sql(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def does_sql(x: str, positive: str, negatives) -> str:
    return f"(NOT {_any_sql(x, negatives)} AND contains({x}, '{positive}'))"


CONTRADICT_SQL = " OR ".join(f"({does_sql('said', p, n)} AND {_any_sql('act', n)}) OR ({_any_sql('said', n)} AND {does_sql('act', p, n)})" for p, n in dims.NEGATIONS)
FORBIDDEN_SQL = " OR ".join(f"(strpos(lower(forb), '{p}') BETWEEN 1 AND {dims.PRIMARY_WITHIN + 1} AND {does_sql('said', p, n)})" for p, n in dims.NEGATIONS)
OPPOSED_SQL = " OR ".join(f"(stmt_level = '{k}' AND level IN ({', '.join(repr(x) for x in v)}))" for k, v in dims.CONFLICTS.items())

#: Pairs that conflict, with reason.
CONFLICTS_SQL = rf"""
c0 AS (SELECT *, lower(statement) AS said, coalesce(action, text) AS a0 FROM sc WHERE req_subject = stmt_subject),
c1 AS (SELECT *, lower(a0) AS act, trim(regexp_replace(a0, 'must not|shall not', '', 'gi'), {_W}) AS forb FROM c0),
c2 AS (SELECT *, CASE WHEN coalesce({OPPOSED_SQL}, false) AND (overlap >= {dims.MIN_OVERLAP} OR coalesce(n_kw, 0) <= {dims.SHORT_STATEMENT}) THEN 'Statement uses "' || stmt_level || '" but requirement uses "' || level || '"'
  WHEN level IN ('MUST', 'SHALL', 'REQUIRED') AND ({CONTRADICT_SQL}) THEN 'Statement action contradicts "' || level || '" requirement: "' || a0 || '"'
  WHEN level IN ('MUST NOT', 'SHALL NOT') AND ({FORBIDDEN_SQL}) THEN 'Statement does what "' || level || '" forbids: "' || forb || '"' END AS reason FROM c1),
cf AS (SELECT * FROM c2 WHERE reason IS NOT NULL)"""
