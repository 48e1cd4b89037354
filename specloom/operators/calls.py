"""A table of calls: each row names a tool and has its arguments as a VARIANT; a failure is a value in the row.

Calls of one tool with the same document and arguments are answered once. Only documents that somebody
asks for are parsed, and each tool parses those of its own calls. A call's filters come from columns, so a
tool's calls go through one plan, however many there are, whose answers are written before the next tool's: the driver
never holds what several tools broadcast. A call of ``get_requirements`` or
``generate_checklist`` is handled as a document of its own, made of the units its filters leave.

Defined cases: an unknown tool, a number that isn't one, isn't whole or is out of range, a missing argument and
a document without a source give an error row; so do null arguments. Arguments of a wrong type that can't be
cast count as absent, unknown ones are ignored. Repeated calls are answered alike. No calls: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom import dims
from specloom.functions import text as X
from specloom.operators import checklist, matching, relations, requirements, structure
from specloom.operators.joins import sized_join
from specloom.operators.parsed import Parsed
from specloom.storage import written

#: Arguments of each tool besides the document's number: name -> (column, type).
ARGUMENTS: dict[str, dict[str, tuple[str, str]]] = {
    "get_rfc_structure": {"includeContent": ("include_content", "boolean")},
    "get_requirements": {"section": ("section", "string"), "level": ("level", "string")},
    "get_definitions": {"term": ("term", "string")},
    "get_rfc_dependencies": {"includeReferencedBy": ("include_referenced_by", "boolean")},
    "get_related_sections": {"section": ("section", "string")},
    "generate_checklist": {"role": ("role", "string"), "sections": ("sections", "array<string>"), "includeSubsections": ("include_subsections", "boolean")},
    "validate_statement": {"statement": ("statement", "string")},
}
REQUIRED = {"get_related_sections": "section", "validate_statement": "statement"}
_COLUMNS = {column: (name, kind) for own in ARGUMENTS.values() for name, (column, kind) in own.items()}


def _argument(name: str, kind: str) -> Column:
    return F.try_variant_get("arguments", f"$.{name}", kind)


def _number_error() -> Column:
    given = F.try_variant_get("arguments", "$.rfc", "variant")
    n = F.try_variant_get("arguments", "$.rfc", "double")
    kind = F.lower(F.coalesce(F.schema_of_variant(given), F.lit("undefined")))
    shown = _argument("rfc", "string")
    return (
        F.when(~kind.rlike(r"^(bigint|double|float|decimal)") | n.isNull(), F.concat(F.lit("RFC number must be a number, got "), F.when(kind == "void", "null").otherwise(kind)))
        .when(n != F.floor(n), F.concat(F.lit("RFC number must be an integer, got "), shown))
        .when(n < dims.MIN_NUMBER, F.concat(F.lit("RFC number must be positive, got "), shown))
        .when(n > dims.MAX_NUMBER, F.concat(F.lit("RFC number "), shown, F.lit(" seems invalid (too large)")))
    )


def checked(calls: DataFrame) -> DataFrame:
    """call_id, tool, doc_id, a column for each argument (null where it isn't one of the tool), error."""
    error = F.when(~F.coalesce(F.col("tool").isin(list(ARGUMENTS)), F.lit(False)), F.concat(F.lit("Unknown tool: "), F.coalesce("tool", F.lit("null")))).otherwise(_number_error())
    values = {c: F.when(F.col("tool").isin([t for t, own in ARGUMENTS.items() if c in {x for x, _ in own.values()}]), _argument(name, kind)) for c, (name, kind) in _COLUMNS.items()}
    rows = calls.select("call_id", "tool", _argument("rfc", "double").alias("_n"), error.alias("error"), *[v.alias(c) for c, v in values.items()])
    missing = F.lit(None).cast("string")
    for tool, name in REQUIRED.items():
        missing = F.when((F.col("tool") == tool) & F.col(name).isNull(), f"Missing argument: {name}").otherwise(missing)
    error = F.coalesce("error", missing)
    return rows.select("call_id", "tool", F.when(error.isNull(), F.col("_n").cast("int")).alias("doc_id"), error.alias("error"), *values)


def _object(*fields: Column, nulls: bool = False) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": str(not nulls).lower()})


def _with_source(rows: DataFrame, docs: DataFrame, context: str, body: Column, extra: Column | None = None) -> DataFrame:
    """call_id, text: ``body``, an object, with where the document came from."""
    note = _object(F.col("_source"), X.source_note(F.col("_source"), context).alias("_sourceNote"))
    text = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(","), F.substring(note, F.lit(2), F.length(note) - 2), F.coalesce(extra, F.lit("")) if extra is not None else F.lit(""), F.lit("}"))
    return rows.join(docs.select("doc_id", F.col("source").alias("_source")), "doc_id").select("call_id", text.alias("text"))


def _listed(order: list[str], item: Column) -> Column:
    """An aggregate: JSON of a list, in order."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, item.alias("_j")))), lambda x: x["_j"]), ","), F.lit("]"))


def _requirement(*more: Column) -> Column:
    names = [F.col(c).alias(n) for c, n in {"id": "id", "level": "level", "text": "text", "subject": "subject", "action": "action", "condition": "condition", "exception": "exception", "section": "section", "section_title": "sectionTitle", "full_context": "fullContext"}.items()]
    return _object(*names, *more)


def _empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("[]"))


def _structures(mine: DataFrame, parsed: Parsed) -> DataFrame:
    long = F.coalesce("include_content", F.lit(False))
    out = []
    for with_content in (False, True):
        asked = mine.where(long == with_content).select("call_id", "doc_id")
        out.append(asked.join(structure.structure_json(parsed, with_content), "doc_id").select("call_id", F.col("structure").alias("text")))
    return out[0].unionByName(out[1])


def _own_units(mine: DataFrame, parsed: Parsed, *columns: str) -> DataFrame:
    """Units for each call, doc_id being the call's."""
    units = sized_join(mine.select("call_id", "doc_id", *columns), parsed.units(), ["doc_id"])
    return units.withColumn("doc_id", F.col("call_id")).drop("call_id")


def _requirements(mine: DataFrame, parsed: Parsed) -> DataFrame:
    wanted = mine.select("*", F.when(F.col("section") != "", F.array("section")).alias("_sections"), F.when(F.col("level") != "", F.col("level")).alias("_level"))
    units = _own_units(wanted, parsed, "_sections", "_level").where(requirements.in_named_sections(F.col("section_id"), F.col("_sections"), F.lit(True)))
    found = requirements.extract_from(units, F.col("_level"))
    lists = found.groupBy(F.col("doc_id").alias("call_id")).agg(F.count("*").alias("total"), _listed(["req_ord"], _requirement()).alias("j"))
    levels = requirements.level_stats(found).select(F.col("doc_id").alias("call_id"), F.to_json("by_level").alias("by_level"))
    rows = mine.join(lists, "call_id", "left").join(levels, "call_id", "left")
    filters = _object(*[F.coalesce(X.nonempty(F.col(c)), F.lit("all")).alias(c) for c in ("section", "level")])
    body = F.concat(F.lit('{"rfc":'), F.col("doc_id").cast("string"), F.lit(',"filter":'), filters, F.lit(',"stats":{"total":'), F.coalesce("total", F.lit(0)).cast("string"), F.lit(',"byLevel":'), F.coalesce("by_level", F.lit("{}")), F.lit('},"requirements":'), _empty("j"), F.lit("}"))
    return _with_source(rows, parsed.docs, "requirements", body)


def _definitions(mine: DataFrame, parsed: Parsed) -> DataFrame:
    t = F.lower(F.coalesce("_term", F.lit("")))
    found = sized_join(mine.select("call_id", "doc_id", F.col("term").alias("_term")), parsed.definitions, ["doc_id"])
    found = found.where(F.lower("term").contains(t) | F.lower("definition").contains(t))
    lists = found.groupBy("call_id").agg(F.count("*").alias("n"), _listed(["def_ord"], _object(F.col("term"), F.col("definition"), F.col("section"), nulls=True)).alias("j"))
    head = _object(F.col("doc_id").alias("rfc"), F.col("term").alias("searchTerm"), F.coalesce("n", F.lit(0)).alias("count"))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"definitions":'), _empty("j"), F.lit("}"))
    return _with_source(mine.join(lists, "call_id", "left"), parsed.docs, "definitions", body)


def _dependencies(mine: DataFrame, parsed: Parsed) -> DataFrame:
    item = _object(F.col("rfc_number").alias("rfcNumber"), F.col("title"), F.col("anchor"))
    sides = [_listed(["ref_ord"], F.when(F.col("kind") == k, item)).alias(k) for k in ("normative", "informative")]
    lists = parsed.refs.groupBy("doc_id").agg(*sides)  # array_join leaves out the nulls of the other side
    body = F.concat(F.lit('{"rfc":'), F.col("doc_id").cast("string"), F.lit(',"normative":'), _empty("normative"), F.lit(',"informative":'), _empty("informative"), F.lit("}"))
    extra = F.when(F.col("include_referenced_by"), ',"referencedBy":[],"_note":"referencedBy is not implemented (requires IETF Datatracker API integration)"')
    return _with_source(mine.join(lists, "doc_id", "left"), parsed.docs, "dependencies", body, extra)


def _related(mine: DataFrame, parsed: Parsed) -> DataFrame:
    asked = mine.select("call_id", "doc_id", F.explode(F.array_distinct(F.array(F.col("section"), X.section_id(F.col("section"))))).alias("key"))
    found = asked.join(relations.section_index(parsed.sections), ["doc_id", "key"]).groupBy("call_id").agg(F.min(F.struct("seq", "title")).alias("s"))
    rows = mine.select("call_id", "doc_id", "section").join(found, "call_id", "left").withColumn("sec_seq", F.col("s.seq"))
    lists = relations.related_sections(parsed).groupBy("doc_id", "sec_seq").agg(_listed(["related_ord"], _object(F.col("related_number").alias("number"), F.col("related_title").alias("title"))).alias("j"))
    head = _object(F.col("doc_id").alias("rfc"), F.col("section"), F.col("s.title").alias("title"), nulls=True)
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"relatedSections":'), _empty("j"), F.lit("}"))
    answered = _with_source(rows.where("s IS NOT NULL").join(lists, ["doc_id", "sec_seq"], "left"), parsed.docs, "sections", body)
    unknown = rows.where("s IS NULL").select("call_id", _object(F.concat(F.lit("Section "), "section", F.lit(" not found")).alias("error")).alias("text"))
    return answered.unionByName(unknown)


def _checklists(mine: DataFrame, parsed: Parsed, stamp: str) -> DataFrame:
    units = _own_units(mine.withColumn("_below", F.coalesce("include_subsections", F.lit(True))), parsed, "sections", "_below")
    found = requirements.extract_from(units.where(requirements.in_named_sections(F.col("section_id"), F.col("sections"), F.col("_below"))))
    roles = mine.select(F.col("call_id").alias("doc_id"), "role")
    items = checklist.items(found.join(roles, "doc_id"), F.col("role")).drop("role")
    docs = mine.select("call_id", "doc_id", "role").join(parsed.docs.select("doc_id", "number", "title"), "doc_id").drop("doc_id").withColumnRenamed("call_id", "doc_id")
    texts = checklist.markdown(docs, items, F.col("role"), stamp).withColumnRenamed("doc_id", "call_id")
    rows = mine.select("call_id", "doc_id", "role").join(texts, "call_id").join(checklist.stats(items).withColumnRenamed("doc_id", "call_id"), "call_id", "left").fillna(0, ["must", "should", "may", "total"])
    body = _object(F.col("doc_id").alias("rfc"), F.coalesce(X.nonempty(F.col("role")), F.lit("both")).alias("role"), F.struct("must", "should", "may", "total").alias("stats"), F.col("markdown"))
    return _with_source(rows, parsed.docs, "checklist", body)


def _validations(mine: DataFrame, parsed: Parsed) -> DataFrame:
    said = mine.select(F.col("call_id").alias("stmt_id"), "doc_id", "statement")
    at = matching.index(requirements.extract_requirements(parsed))
    best = written(matching.best_matches(matching.scored(said, at, dims.TOP_MATCHES)), "best")
    against = written(matching.conflicts(said, at.requirements), "conflicts")
    extra = [F.col(c).alias(n) for c, n in {"score": "_matchScore", "matched_keywords": "_matchedKeywords", "subject_match": "_subjectMatch", "level_match": "_levelMatch"}.items()]
    matches = best.groupBy("stmt_id").agg(_listed(["rank"], _requirement(*extra)).alias("matches"))
    one = F.concat(F.lit('{"requirement":'), _requirement(), F.lit(","), F.expr("substring(to_json(struct(reason)), 2)"))
    conflicts = against.groupBy("stmt_id").agg(_listed(["req_ord"], one).alias("conflicts"))
    rows = matching.judged(said, best, against).join(matches, "stmt_id", "left").join(conflicts, "stmt_id", "left").withColumnRenamed("stmt_id", "call_id")
    head = _object(F.col("doc_id").alias("rfc"), F.col("statement"), F.struct(F.col("stmt_level").alias("detectedLevel"), F.col("stmt_subject").alias("detectedSubject")).alias("analysis"), F.col("is_valid").alias("isValid"), nulls=True)
    hints = F.when(F.col("suggestions").isNotNull(), F.concat(F.lit(',"suggestions":'), F.to_json("suggestions"))).otherwise("")
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"matchingRequirements":'), _empty("matches"), F.lit(',"conflicts":'), _empty("conflicts"), hints, F.lit("}"))
    return _with_source(rows, parsed.docs, "validation", body)


def call_batch(calls: DataFrame, raw: DataFrame, parse: Callable[[DataFrame], Parsed], generated_at: str) -> DataFrame:
    """``calls`` (call_id, tool, arguments VARIANT) over ``raw`` (doc_id, source, body, and optionally error) ->
    call_id, tool, text, is_error. ``text`` is the answer or ``{"error": message}`` as JSON."""
    said = written(checked(calls), "calls")
    wanted = said.where("error IS NULL").select("doc_id").distinct()
    own = raw.select(F.col("doc_id").cast("int").alias("doc_id"), "source", "body", *(["error"] if "error" in raw.columns else []))
    if "error" not in raw.columns:
        own = own.withColumn("error", F.lit(None).cast("string"))
    docs = written(own.join(wanted, "doc_id", "left_semi"), "asked")
    status = docs.select("doc_id", F.col("source").isNotNull().alias("_there"), F.col("error").alias("_why"))
    failure = F.coalesce("error", F.when(~F.coalesce("_there", F.lit(False)), F.coalesce("_why", F.concat(F.lit("Could not fetch RFC "), F.col("doc_id").cast("string"), F.lit(".")))))
    said = written(said.join(status, "doc_id", "left").withColumn("error", failure).drop("_there", "_why"), "known")
    # calls that ask the same are answered once, under the least call_id
    asked = ["tool", "doc_id", *_COLUMNS]
    good = written(said.where("error IS NULL").groupBy(*asked).agg(F.min("call_id").alias("request")), "requests")
    answers: dict[str, Callable[[DataFrame, Parsed], DataFrame]] = {
        "get_rfc_structure": _structures, "get_requirements": _requirements, "get_definitions": _definitions, "get_rfc_dependencies": _dependencies,
        "get_related_sections": _related, "generate_checklist": lambda m, p: _checklists(m, p, generated_at), "validate_statement": _validations,
    }
    found = None
    for tool, answer in answers.items():
        mine = good.where(F.col("tool") == tool).withColumnRenamed("request", "call_id")
        texts = answer(mine, parse(docs.drop("error").join(mine.select("doc_id").distinct(), "doc_id", "left_semi"))).select(F.col("call_id").alias("request"), "text")
        texts = written(texts, f"answers-{tool}")
        found = texts if found is None else found.unionByName(texts)
    named = good.select("request", *[F.col(c).alias(f"_{c}") for c in asked])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asked]
    rest = written(said.where("error IS NULL").join(named, same).select("call_id", "tool", "request"), "answered").join(found.hint("merge"), "request").select("call_id", "tool", "text", F.lit(False).alias("is_error"))
    failed = said.where("error IS NOT NULL").select("call_id", "tool", _object("error").alias("text"), F.lit(True).alias("is_error"))
    return rest.unionByName(failed)
