"""URL filter: listed rules first, then a tree of path templates for each host, rejected by their smoothed purity under the rules.

URLs that a rule decides are the labels. Paths are cut into segments, and digits become a wildcard at once. Then, from the top down, the branches below a
node are pooled by what mostly lies below them, and those that don't differ from their pool, neither in what lies below them by a chi-square test nor in
their share of blocked labels, merge into one wildcard; branches without labels merge as others do, so the labels of their kind speak for them. A template
is rejected when its share of blocked labels, smoothed by the share over all labels, is high enough. The tree is grown over the distinct shapes of
paths, level by level until no two shapes share a node any more, however deep; all of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import broadcast_if_small, materialise

#: Rules as (host, path, verdict); a rule's string is its host and path.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The standard score up to which a branch counts as similar to its pool in what lies below, and the square of that for its labels (1.96 * 1.96).
LIKE, SIMILAR = 3.0, 3.8416

#: Labels that the smoothing is worth, and the smoothed share of blocked labels at which a template is rejected.
SMOOTHING, REJECT_AT = 5.0, 0.8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path of a URL; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The string and the verdict of the longest rule that fits; null for none. Rules are a short list that becomes one expression."""
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grow(shapes: DataFrame, level: int) -> DataFrame:
    """Adds the branch of one level (from 0) to the template of each shape; each has a segment there."""
    node, below = ["host", "template"], F.get("segments", F.lit(level + 1))
    kind = F.when(below.isNull(), "end").when(below == "{n}", "number").when(F.contains(below, F.lit(".")), "file").otherwise("word")
    shapes = shapes.withColumn("child", F.get("segments", F.lit(level))).withColumn("kind", F.concat(kind, F.lit(","), F.size("segments") - level - 1))
    sums = [F.sum(c).alias(c) for c in ("blocked", "allowed", "urls")]
    kinds = shapes.groupBy(*node, "child", "kind").agg(*sums)
    children = kinds.groupBy(*node, "child").agg(*sums, F.max_by("kind", F.struct("urls", "kind")).alias("pool"))
    pools = children.groupBy(*node, "pool").agg(F.count("*").alias("members"), *(F.sum(c).alias(f"all_{c}") for c in ("blocked", "allowed", "urls")))
    pooled = kinds.join(children.select(*node, "child", "pool"), [*node, "child"])
    shares = pooled.groupBy(*node, "pool", "kind").agg(F.sum("urls").alias("of_kind"))
    degrees = shares.groupBy(*node, "pool").agg((F.count("*") - 1).alias("degrees"))
    # the sum of (seen - expected) ** 2 / expected is that of seen ** 2 / expected, less all that is seen
    squares = pooled.join(shares, [*node, "pool", "kind"]).groupBy(*node, "child").agg(F.sum(F.col("urls").cast("double") * F.col("urls") / F.col("of_kind")).alias("squares"))
    known = children.join(pools, [*node, "pool"]).join(degrees, [*node, "pool"]).join(squares, [*node, "child"])
    df = F.greatest("degrees", F.lit(1)).cast("double")
    critical = F.when(F.col("degrees") == 0, 0.0).otherwise(df * F.pow(1 - 2 / (9 * df) + LIKE * F.sqrt(2 / (9 * df)), F.lit(3.0)))
    alike = F.col("squares") * F.col("all_urls") / F.col("urls") - F.col("urls") <= critical + 1e-9
    labels, all_labels = F.col("blocked") + F.col("allowed"), F.col("all_blocked") + F.col("all_allowed")
    share = F.col("blocked").cast("double") / F.greatest(labels, F.lit(1))
    whole = F.col("all_blocked").cast("double") / F.greatest(all_labels, F.lit(1))
    similar = (labels == 0) | ((share - whole) * (share - whole) * labels <= SIMILAR * whole * (1 - whole) + 1e-9)
    branch = F.when((F.col("members") > 1) & alike & similar, F.concat(F.lit("*:"), F.col("pool"))).otherwise(F.col("child")).alias("branch")
    grown = shapes.join(known.select(*node, "child", branch), [*node, "child"])
    return grown.withColumn("template", F.concat("template", F.lit("/"), F.col("branch"))).drop("child", "kind", "branch")


def templates(shapes: DataFrame) -> DataFrame:
    """From shapes (host, segments, blocked, allowed, urls): each shape's template with its purity and verdict."""
    columns, grown, level = ["host", "segments", "blocked", "allowed", "urls", "template"], [], 0
    left = shapes.withColumn("template", F.lit("")).select(columns)
    while True:
        # a shape that is alone below its node, or ends there, branches no more
        shared = left.where(F.size("segments") > level).groupBy("host", "template").count().where("count > 1").select("host", "template", F.lit(True).alias("shared"))
        told = materialise(left.join(shared, ["host", "template"], "left").withColumn("open", F.col("shared").isNotNull() & (F.size("segments") > level)).drop("shared"))
        rest = F.array_join(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), "/")
        grown.append(told.where("not open").withColumn("template", F.concat("template", F.when(F.size("segments") > level, F.concat(F.lit("/"), rest)).otherwise(""))).select(columns))
        left = told.where("open").select(columns)
        if left.isEmpty():
            break
        left = _grow(left, level).select(columns)
        level += 1
    whole = grown[0]
    for part in grown[1:]:
        whole = whole.union(part)
    whole = materialise(whole.withColumn("template", F.when(F.col("template") == "", "/").otherwise(F.col("template"))))
    counted = whole.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    prior = whole.agg(F.sum("blocked").alias("_b"), F.sum("allowed").alias("_a")).select((F.col("_b").cast("double") / F.greatest("_b", F.col("_b") + F.col("_a"), F.lit(1))).alias("prior"))
    purity = (F.col("b") + SMOOTHING * F.col("prior")) / (F.col("b") + F.col("a") + SMOOTHING)
    scored = counted.join(F.broadcast(prior), F.lit(True), "left").withColumn("purity", purity)  # prior is one row
    verdict = F.when((F.col("b") > 0) & (F.col("purity") >= REJECT_AT), "block").otherwise("allow").alias("template_verdict")
    return whole.join(scored, ["host", "template"]).select("host", "segments", "template", "purity", verdict)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for each row of pages.

    verdict is the rule's, else that of the URL's template; a template without labels has the purity of all labels together and is allowed, as is any
    where no rule gives a label. Of rules that fit, the longest decides. Of kinds that lie below a branch equally often, the last by name pools it. Null
    URLs and those without "://" have an empty host and path, a template of their own, and no rule. Repeated rows are judged alike, very long URLs in
    full; other columns are not looked at. An empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), RULES if rules is None else rules)
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))
    judged = judged.withColumns({"rule": rule, "rule_verdict": verdict, "segments": segments})
    blocked, allowed = (F.count_if(F.col("rule_verdict") == v).alias(c) for v, c in (("block", "blocked"), ("allow", "allowed")))
    shapes = materialise(judged.groupBy("host", "segments").agg(blocked, allowed, F.count("*").alias("urls")))
    known = broadcast_if_small(materialise(templates(shapes)))
    return judged.join(known, ["host", "segments"], "left").select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("rule_verdict", "template_verdict").alias("verdict"), "template", "purity")


def _oracle(levels: int) -> str:
    """The same as DuckDB SQL, for paths whose branches lie within so many levels; SQL has no loop that groups."""
    fits = [(h, p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(h, p, v)}'" for h, p, v in fits) + " END"
    steps = []
    for i in range(levels):
        critical = f"CASE WHEN degrees = 0 THEN 0 ELSE degrees * pow(1 - 2.0::DOUBLE / (9 * degrees) + {LIKE}::DOUBLE * sqrt(2.0::DOUBLE / (9 * degrees)), 3.0) END"
        steps.append(f"""
open{i} AS (SELECT *, seg[{i + 1}] AS child, CASE WHEN seg[{i + 2}] IS NULL THEN 'end' WHEN seg[{i + 2}] = '{{n}}' THEN 'number' WHEN contains(seg[{i + 2}], '.') THEN 'file' ELSE 'word' END
    || ',' || (len(seg) - {i + 1}) AS kind FROM t{i} WHERE len(seg) > {i}),
kinds{i} AS (SELECT host, template, child, kind, sum(blocked) AS blocked, sum(allowed) AS allowed, sum(urls)::DOUBLE AS urls FROM open{i} GROUP BY ALL),
children{i} AS (SELECT host, template, child, sum(blocked) AS blocked, sum(allowed) AS allowed, sum(urls) AS urls, arg_max(kind, (urls, kind)) AS pool FROM kinds{i} GROUP BY ALL),
pools{i} AS (SELECT host, template, pool, count(*) AS members, sum(blocked) AS ab, sum(allowed) AS aa, sum(urls) AS au FROM children{i} GROUP BY ALL),
shares{i} AS (SELECT host, template, pool, kind, sum(k.urls) AS of_kind FROM kinds{i} k JOIN children{i} c USING (host, template, child) GROUP BY ALL),
degrees{i} AS (SELECT host, template, pool, count(*) - 1 AS degrees FROM shares{i} GROUP BY ALL),
squares{i} AS (SELECT host, template, child, sum(k.urls * k.urls / s.of_kind) AS squares FROM kinds{i} k JOIN children{i} c USING (host, template, child)
    JOIN shares{i} s USING (host, template, pool, kind) GROUP BY ALL),
tested{i} AS (SELECT *, blocked::DOUBLE / greatest(blocked + allowed, 1) AS p, ab::DOUBLE / greatest(ab + aa, 1) AS q
    FROM children{i} JOIN pools{i} USING (host, template, pool) JOIN degrees{i} USING (host, template, pool) JOIN squares{i} USING (host, template, child)),
branches{i} AS (SELECT host, template, child, CASE WHEN members > 1 AND squares * au / urls - urls <= {critical} + 1e-9
    AND (blocked + allowed = 0 OR (p - q) * (p - q) * (blocked + allowed) <= {SIMILAR}::DOUBLE * q * (1 - q) + 1e-9) THEN '*:' || pool ELSE child END AS branch FROM tested{i}),
t{i + 1} AS (SELECT host, seg, template || '/' || branch AS template, blocked, allowed, urls FROM open{i} JOIN branches{i} USING (host, template, child)
    UNION ALL SELECT host, seg, template, blocked, allowed, urls FROM t{i} WHERE len(seg) <= {i}),""")
    return f"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
ruled AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS rule_verdict,
    [regexp_replace(s, '[0-9]+', '{{n}}', 'g') for s in string_split(path, '/') if s <> ''] AS seg FROM parsed),
t0 AS (SELECT host, seg, '' AS template, count(*) FILTER (rule_verdict = 'block') AS blocked, count(*) FILTER (rule_verdict = 'allow') AS allowed, count(*) AS urls FROM ruled GROUP BY ALL),{"".join(steps)}
named AS (SELECT host, seg, blocked, allowed, CASE WHEN len(seg) > {levels} THEN template || '/' || array_to_string(seg[{levels + 1}:], '/') WHEN template = '' THEN '/' ELSE template END AS template FROM t{levels}),
prior AS (SELECT sum(blocked)::DOUBLE / greatest(sum(blocked + allowed), 1) AS r FROM t0),
scored AS (SELECT host, template, (sum(blocked) + {SMOOTHING}::DOUBLE * any_value(r)) / (sum(blocked) + sum(allowed) + {SMOOTHING}::DOUBLE) AS purity, sum(blocked) AS b FROM named, prior GROUP BY ALL),
known AS (SELECT host, seg, template, purity, b FROM named JOIN scored USING (host, template))
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN b > 0 AND purity >= {REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM ruled LEFT JOIN known USING (host, seg)
"""


#: What judge() returns under RULES, as DuckDB SQL; paths of the table branch within four levels.
ORACLE = _oracle(4)
