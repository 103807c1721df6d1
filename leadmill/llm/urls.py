"""URL filters: pattern rules are indexed by their rarest literal token; a URL's tokens fetch candidate rules, and only
those run their regular expressions. DataFrame functions only.

A rule is (action, pattern); a pattern is `host/path-prefix` with `*` for any characters in the path. It fits that host
and all its subdomains, one without a host all hosts. Of the rules that fit, the longest pattern wins, then the pattern
that sorts first, then the action. A rule without a literal token is a candidate of every URL.
A URL without `://`, or null, has an empty host and path; no rule fits it. Repeated rows are each judged.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from leadmill.llm.common import rows_of, table

#: The index of so many rules goes along with the plan; of more it is joined: broadcast up to BROADCAST_RULES, beyond by
#: Spark's own choice, which may shuffle.
IN_ROW_RULES = 500
BROADCAST_RULES = 100_000


#: The token of rules without one; every URL has it.
ALWAYS = ""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_parts(action: str, pattern: str) -> tuple[str, str, str, list[str]]:
    """(action, pattern, regular expression over host + path, literal tokens that every fitting URL has)."""
    host, slash, path = pattern.partition("/")
    path = slash + path
    anywhere = r"(?:[^/]*\.)?" + re.escape(host) if host else "[^/]*"
    expression = r"(?s)\A" + anywhere + ("" if slash else r"(?:/|\z)") + "".join(".*" if c == "*" else re.escape(c) for c in path)
    whole = [p for p in path.split("/")[1:-1] if p and "*" not in p]
    return action, pattern, expression, [*(f".{x}" for x in host.split(".") if x), *(f"/{x}" for x in whole)] or [ALWAYS]


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host with a dot before them, segments of the path with a slash."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("."), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("/"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(ALWAYS))))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each row; rule is null and verdict is `otherwise` where no rule fits."""
    spark = pages.sparkSession
    parts = [rule_parts(*r) for r in rules]
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    tokens = [(token, pattern, action, expression) for action, pattern, expression, own in parts for token in own]
    index = _by_rarest(spark, rows, tokens)
    better = lambda pattern, action: F.struct((-F.length(pattern)).alias("n"), pattern.alias("rule"), action.alias("action"))
    out = [*keep, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(otherwise)).alias("verdict")]
    if len(rules) <= IN_ROW_RULES:  # the index goes along as a constant, rows stay where they are
        kind = "map<string, array<struct<pattern: string, action: string, expression: string>>>"
        under: dict[str, list] = {}
        for r in index.select("_token", "_pattern", "_action", "_expression").collect():  # a row a rule
            under.setdefault(r._token, []).append({"pattern": r._pattern, "action": r._action, "expression": r._expression})
        known = F.from_json(F.lit(json.dumps(under)), kind)
        fetched = F.flatten(F.filter(F.transform(url_tokens(F.col("host"), F.col("path")), lambda t: F.try_element_at(known, t)), lambda x: x.isNotNull()))
        fits = F.filter(fetched, lambda r: F.rlike(F.concat("host", "path"), r["expression"]))
        return rows.withColumn("_best", F.array_min(F.transform(fits, lambda r: better(r["pattern"], r["action"])))).select(*out)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    seen = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_token", F.explode(url_tokens(F.col("host"), F.col("path"))))
    best = F.min(F.when(F.rlike(F.concat("host", "path"), F.col("_expression")), better(F.col("_pattern"), F.col("_action"))))
    return seen.join(index, "_token", "left").groupBy("_row", *keep, "host", "path").agg(best.alias("_best")).select(*out)


def _by_rarest(spark: SparkSession, rows: DataFrame, tokens: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row a rule, under its token that the fewest URLs have."""
    own = rows_of(spark, tokens, "_token string, _pattern string, _action string, _expression string")
    counts = rows.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("_token")).join(F.broadcast(own.select("_token").distinct()) if len(tokens) <= BROADCAST_RULES else own.select("_token").distinct(), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_n"))
    order = W.partitionBy("_pattern", "_action").orderBy(F.coalesce("_n", F.lit(0)), "_token")
    return own.join(counts, "_token", "left").withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "_n")


#: The rules of the registered query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


_FITS = " UNION ALL ".join(f"SELECT '{a}' AS action, '{p}' AS rule, '{p.partition('/')[0]}' AS rule_host, '/{p.partition('/')[2]}' AS rule_path" for a, p in RULES)
OP2_SQL = f"""WITH u AS (SELECT page_id, row_number() OVER () AS k, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
rules AS ({_FITS}),
best AS (SELECT k, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN best USING (k)"""
