"""Quality rules: text statistics and a learned decision list over them. DataFrame functions only.

The statistics of a bounded sample of labelled rows (TRAIN_ROWS, those of least hash, a documented parameter) are
gathered; sequential covering then grows threshold conjunctions that describe bad texts by information gain on two
thirds of them, prunes each on the other third, and stops when a rule no longer holds there. The ordered rules become
one conditional expression of Spark; a row gets the first rule that fits, and is kept where none does.

Words are runs without white space. A null or empty text has no words, all statistics are 0, and it fails the base.
Repeated rows are each judged; texts are measured whole. Without labelled rows of both kinds the list is empty.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.llm.common import indices, let, table

#: At most so many labelled rows are used to learn the rules.
TRAIN_ROWS = 20_000
#: A rule must be right on so many of the rows held back that it fits, or it isn't used.
PRECISION = 0.97
MAX_RULES = 12
MAX_CONDITIONS = 4
#: Thresholds tried for each statistic: its quantiles.
CUTS = 40
_SPACE = r"[\x20\x09-\x0D]+"
STATISTICS = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "shout_rate"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | F.coalesce(x.h == F.get(s, k + 1).h, F.lit(False)))
        starts = let(pairs, lambda s: F.sort_array(F.transform(same(s), lambda x: x.i)))
        # each start covers three words, or as many as lie before the next start
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    hashes = F.transform(indices(F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def statistics(text: Column) -> Column:
    """Struct of the base counts and the rates that rules use, each worked out once a row."""
    t = F.coalesce(text, F.lit(""))
    count = lambda c: c.cast("long")
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(
            count(F.size(words)).alias("n_words"),
            count(F.length(F.regexp_replace(t, _SPACE, ""))).alias("word_chars"),
            count(without("#*$%&|<>")).alias("n_symbols"),
            count(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            count(repeated_words(words)).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).alias("n_distinct"),
            F.size(lines).alias("n_lines"),
        )

    def rates(c: Column) -> Column:
        base = [c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(
            *base,
            rate(c.word_chars, c.n_words).alias("mean_word"),
            rate(c.n_symbols, c.n_words).alias("symbol_rate"),
            rate(c.n_dup_lines, c.n_lines).alias("dup_line_rate"),
            rate(c.n_repeat_words, c.n_words).alias("repeat_rate"),
            rate(c.n_distinct, c.n_words).alias("distinct_rate"),
            rate(F.regexp_count(t, F.lit(r"\p{Lu}")), c.word_chars).alias("upper_rate"),
            rate(without("!"), c.n_words).alias("shout_rate"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(let(words_of(text), lambda w: let(lines, lambda l: counts(w, l))), rates)


def base_failed(s: Column) -> Column:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


class Condition(NamedTuple):
    statistic: str
    above: bool
    threshold: float

    def column(self, s: Column) -> Column:
        return s[self.statistic] > self.threshold if self.above else s[self.statistic] <= self.threshold

    def fits(self, row: dict) -> bool:
        return (row[self.statistic] > self.threshold) == self.above

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = list[Condition]


def _fits(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.fits(r) for c in rule)]


def _grow(rows: list[dict]) -> Rule:
    """Adds the condition of most gain until only bad rows are left or none helps."""
    rule: Rule = []
    bad = sum(r["bad"] for r in rows)
    while bad < len(rows) and len(rule) < MAX_CONDITIONS:
        now, best = math.log2(bad / len(rows)), (0.0, None)
        for name in STATISTICS:
            ordered = sorted(rows, key=lambda r: r[name])
            sums = [0]
            for r in ordered:
                sums.append(sums[-1] + r["bad"])
            # the ends of each quantile's value: statistics that many rows share have few places to cut at
            values = [r[name] for r in ordered]
            quantiles = {values[len(values) * k // CUTS] for k in range(CUTS)}
            tried = sorted({at(values, v) for v in quantiles for at in (bisect_left, bisect_right)})
            for j in tried:
                if not 0 < j < len(ordered) or ordered[j - 1][name] == ordered[j][name]:
                    continue
                middle = (ordered[j - 1][name] + ordered[j][name]) / 2
                for above, p, n in ((False, sums[j], j), (True, bad - sums[j], len(ordered) - j)):
                    if p and (gain := p * (math.log2(p / n) - now)) > best[0]:
                        best = (gain, Condition(name, above, middle))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = _fits([best[1]], rows)
        bad = sum(r["bad"] for r in rows)
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """Drops last conditions as long as the rule's worth on the rows held back doesn't fall."""

    def worth(r: Rule) -> float:
        got = _fits(r, rows)
        bad = sum(x["bad"] for x in got)
        return (2 * bad - len(got)) / (len(got) + 1)

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_list(rows: list[dict]) -> list[Rule]:
    """Ordered rules that describe bad rows. rows: the statistics, `bad` 0 or 1 and `fold` 0, 1 or 2 (2: held back)."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(r["bad"] for r in rows):
        grow, held = [r for r in rows if r["fold"] < 2], [r for r in rows if r["fold"] == 2]
        if not any(r["bad"] for r in grow) or not (rule := _prune(_grow(grow), held)):
            break
        got = _fits(rule, held)
        if not got or sum(r["bad"] for r in got) < PRECISION * len(got):
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.fits(r) for c in rule)]
    return rules


def rule_column(rules: list[Rule], s: Column) -> Column:
    """The first rule that fits the statistics, as text; null if none."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        both = rule[0].column(s)
        for c in rule[1:]:
            both = both & c.column(s)
        out = out.when(both, F.lit(" and ".join(map(str, rule))))
    return out


def learned_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, text: str = "text") -> list[Rule]:
    """Rules from the labelled rows of docs(doc_id, text) and labels(doc_id, quality)."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows rows of two numbers
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    # of rows that repeat an id the one of least statistics: one row a sampled id
    rows = rows.select("doc_id", "quality", statistics(F.col("text")).alias("s")).groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("s").alias("s")).orderBy("doc_id")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)))
    got = [r.s.asDict() | {"bad": int(r.quality == 0), "fold": r.fold} for r in rows.collect()]
    got = [r for r in got if r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]]
    return learn_list([{k: float(r[k]) for k in STATISTICS} | {"bad": r["bad"], "fold": r["fold"]} for r in got])


def judgement(text: Column, rules: list[Rule]) -> Column:
    """Struct of the statistics, base_failed, rule (null if none) and kept."""

    def judge(s: Column) -> Column:
        rule = F.when(~base_failed(s), rule_column(rules, s))
        base = [s[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(*base, *[s[x].alias(x) for x in STATISTICS[1:]], base_failed(s).alias("base_failed"), rule.alias("rule"), (~base_failed(s) & rule.isNull()).alias("kept"))

    return let(statistics(text), judge)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learned_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    judged = docs.select("doc_id", judgement(F.col("text"), rules).alias("j"))
    return judged.select("doc_id", *[f"j.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")])
