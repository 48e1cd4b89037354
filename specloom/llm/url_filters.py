"""URL filters with path-template trees [native].

URLs are counted into templates: variable parts of a path segment (numbers, long hexadecimal
strings) become wildcards at once. Labelled are the URLs that a rule judges, and as bad those of a
host with a seed term among its name's parts; so labels differ inside a host. Level by level below
each host, sibling branches that are statistically similar - the same range of next segments, and
smoothed labelled rates that differ by no more than chance in a test of two rates - merge into one
wildcard branch (branches without labels keep their names, by which other hosts speak for them). A template's purity is the labelled rate of its URLs, smoothed toward the geometric
mean of its host's and of the same template's on all hosts, both smoothed toward that of all URLs;
unlabelled URLs count as weak evidence against. Templates whose purity reaches a threshold are
rejected. Lists of rules come before: the longest rule that fits decides.

All statistics are of all URLs, aggregated before any join; no step sees a host's rows together.

Defined cases: a null URL, or one without ``://``, has an empty host and path and belongs to the
templates of the empty host; repeated rows are judged alike; an empty table gives an empty result;
only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import materialise

#: The production rules: verdict, and host/path; longest wins.
RULES: tuple[tuple[str, str], ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Parts of host names, between dots and hyphens, that label a URL as bad, as a list of seeds would.
SEED_TERMS: tuple[str, ...] = ("casino", "pills", "bets", "spam", "ads")
LEVELS = 4
SMOOTHING = 5.0
WEAK = 0.05
Z = 2.0
REJECT = 0.5


def split_url(url: Column) -> dict[str, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def rule_for(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The rule that decides, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda x: len(x[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> list[Column]:
    """The first LEVELS segments with their variable parts as wildcards; null beyond the path's end.
    The last one stands for all that follows too."""
    general = F.regexp_replace(F.regexp_replace(path, r"[0-9a-f]{8,}", "<h>"), r"[0-9]+", "<n>")
    parts = F.filter(F.split(general, "/", -1), lambda s: s != "")
    return [F.get(parts, F.lit(i)) for i in range(LEVELS - 1)] + [F.when(F.size(parts) >= LEVELS, F.array_join(F.slice(parts, LEVELS, 1 << 30), "/"))]


def template_tree(counts: DataFrame) -> DataFrame:
    """``counts`` (host, s1.., n, lab, bad) with ``template``: the branch that each path belongs to."""
    tree = counts.withColumn("template", F.lit(""))
    for level in range(1, LEVELS + 1):
        own, after = f"s{level}", f"s{level + 1}" if level < LEVELS else None
        low, high = (F.coalesce(f(after), F.lit("")) if after else F.lit("") for f in (F.min, F.max))
        child = tree.where(F.col(own).isNotNull()).groupBy("host", "template", own).agg(F.sum("lab").alias("_lab"), F.sum("bad").alias("_bad"), low.alias("_low"), high.alias("_high"))
        pooled = child.groupBy("host", "template", "_low", "_high").agg(F.sum("_lab").alias("_all"), F.sum("_bad").alias("_all_bad"), F.count("*").alias("_branches"))
        rate, own_rate = (F.col("_all_bad") + 1) / (F.col("_all") + 2), (F.col("_bad") + 1) / (F.col("_lab") + 2)
        chance = F.lit(Z) * F.sqrt(rate * (1 - rate) * (1 / (F.col("_lab") + 2) + 1 / (F.col("_all") + 2)))
        similar = (F.col("_branches") > 1) & (F.col("_lab") > 0) & (F.abs(own_rate - rate) <= chance)
        named = child.join(pooled, ["host", "template", "_low", "_high"]).select("host", "template", own, F.when(similar, F.lit("*")).otherwise(F.col(own)).alias("_name"))
        tree = tree.join(named, ["host", "template", own], "left").withColumn("template", F.when(F.col("_name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "_name"))).drop("_name")
        tree = materialise(tree, "url-tree")  # each level reads the one before several times
    return tree


def purities(tree: DataFrame) -> DataFrame:
    """(host, template) -> purity."""
    sums = [F.sum(x).alias(x) for x in ("n", "lab", "bad")]
    by_template = tree.groupBy("host", "template").agg(*sums)
    overall = by_template.agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0)).alias("_prior"))

    def smoothed(toward: str) -> Column:
        return (F.col("bad") + F.lit(SMOOTHING) * F.col(toward)) / (F.col("lab") + F.lit(WEAK) * (F.col("n") - F.col("lab")) + F.lit(SMOOTHING))

    hosts, paths = (by_template.groupBy(key).agg(*sums).join(F.broadcast(overall)).select(key, smoothed("_prior").alias(rate)) for key, rate in (("host", "_host"), ("template", "_path")))
    prior = F.sqrt(F.col("_host") * F.col("_path"))
    return by_template.join(hosts, "host").join(paths, "template").withColumn("_both", prior).select("host", "template", smoothed("_both").alias("purity"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEED_TERMS, reject: float = REJECT) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, template, purity."""
    urls = pages.select("page_id", F.col("url")).withColumns(split_url(F.col("url"))).drop("url")
    urls = urls.withColumns({f"s{i}": s for i, s in enumerate(segments(F.col("path")), 1)})
    name, verdict = rule_for(rules)
    seeded = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    bad = F.coalesce(verdict == "block", seeded)
    keys = ["host", *(f"s{i}" for i in range(1, LEVELS + 1))]
    counts = urls.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(verdict.isNotNull() | seeded).alias("lab"), F.count_if(bad).alias("bad"))
    tree = template_tree(materialise(counts, "url-counts"))
    judged = tree.join(purities(tree), ["host", "template"]).select(*keys, "template", "purity")
    # missing segments are null: a key that equals only itself stands for them in the join
    key = F.concat_ws("/", *[F.coalesce(F.concat(F.lit("="), k), F.lit("-")) for k in keys[1:]])
    out = urls.withColumn("_key", key).join(judged.select("host", key.alias("_key"), "template", "purity"), ["host", "_key"])
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template")


def _level_sql(i: int) -> str:
    low, high = (f"coalesce({f}(s{i + 1}), '')" if i < LEVELS else "''" for f in ("min", "max"))
    similar = f"k > 1 AND lab > 0 AND abs((bad + 1) / (lab + 2) - (ab + 1) / (al + 2)) <= {Z} * sqrt((ab + 1) / (al + 2) * (1 - (ab + 1) / (al + 2)) * (1 / (lab + 2) + 1 / (al + 2)))"
    return f"""
c{i} AS (SELECT host, template, s{i} AS own, sum(lab) AS lab, sum(bad) AS bad, {low} AS low, {high} AS high FROM t{i - 1} WHERE s{i} IS NOT NULL GROUP BY 1, 2, 3),
g{i} AS (SELECT host, template, low, high, sum(lab) AS al, sum(bad) AS ab, count(*) AS k FROM c{i} GROUP BY 1, 2, 3, 4),
m{i} AS (SELECT c.host, c.template, own, CASE WHEN {similar} THEN '*' ELSE own END AS name FROM c{i} c JOIN g{i} g ON c.host = g.host AND c.template = g.template AND c.low = g.low AND c.high = g.high),
t{i} AS (SELECT t.host, s1, s2, s3, s4, n, t.lab, t.bad, CASE WHEN name IS NULL THEN t.template ELSE t.template || '/' || name END AS template FROM t{i - 1} t LEFT JOIN m{i} m ON t.host = m.host AND t.template = m.template AND t.s{i} = m.own),"""


def _rule_sql(i: int) -> str:
    cases = "".join(f" WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{(w, r)[i]}'" for w, r in sorted(RULES, key=lambda x: -len(x[1])) for h, _, p in [r.partition("/")])
    return f"CASE{cases} ELSE NULL END"


def _smoothed_sql(toward: str, n: str = "n", lab: str = "lab", bad: str = "bad") -> str:
    return f"({bad} + {SMOOTHING} * {toward}) / ({lab} + {WEAK} * ({n} - {lab}) + {SMOOTHING})"


JUDGE_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(path, '[0-9a-f]{{8,}}', '<h>', 'g'), '[0-9]+', '<n>', 'g'), '/'), lambda s: s <> '') AS x FROM u),
s AS (SELECT page_id, host, path, {_rule_sql(0)} AS ruled, {" OR ".join(f"list_contains(string_split(replace(host, '-', '.'), '.'), '{x}')" for x in SEED_TERMS)} AS seeded, x[1] AS s1, x[2] AS s2, x[3] AS s3, CASE WHEN len(x) >= 4 THEN array_to_string(x[4:], '/') END AS s4 FROM p),
t0 AS (SELECT host, s1, s2, s3, s4, count(*) AS n, count(*) FILTER (ruled IS NOT NULL OR seeded) AS lab, count(*) FILTER (coalesce(ruled = 'block', seeded)) AS bad, '' AS template FROM s GROUP BY 1, 2, 3, 4, 5),
{"".join(_level_sql(i) for i in range(1, LEVELS + 1))}
bt AS (SELECT host, template, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM t{LEVELS} GROUP BY 1, 2),
o AS (SELECT coalesce(sum(bad) / sum(n), 0) AS prior FROM bt),
hp AS (SELECT host, {_smoothed_sql("max(prior)", "sum(n)", "sum(lab)", "sum(bad)")} AS hp FROM bt, o GROUP BY 1),
pp AS (SELECT template, {_smoothed_sql("max(prior)", "sum(n)", "sum(lab)", "sum(bad)")} AS pp FROM bt, o GROUP BY 1),
tp AS (SELECT bt.host, bt.template, {_smoothed_sql("sqrt(hp * pp)")} AS purity FROM bt JOIN hp ON bt.host = hp.host JOIN pp ON bt.template = pp.template),
j AS (SELECT s.page_id, s.host, s.path, t.template, tp.purity FROM s JOIN t{LEVELS} t ON s.host = t.host AND s.s1 IS NOT DISTINCT FROM t.s1 AND s.s2 IS NOT DISTINCT FROM t.s2 AND s.s3 IS NOT DISTINCT FROM t.s3 AND s.s4 IS NOT DISTINCT FROM t.s4 JOIN tp ON t.host = tp.host AND t.template = tp.template)
SELECT page_id, host, path, {_rule_sql(1)} AS rule, coalesce({_rule_sql(0)}, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template FROM j
"""
