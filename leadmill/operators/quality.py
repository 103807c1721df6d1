"""Data quality: coverage, counts, accuracy, trends and diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmill.operators.windows import last_n_per_group

# Failure rates that call for action, and their problems.
THRESHOLDS = {"not_found": 0.20, "lp_dead": 0.20, "nta_only": 0.35, "phone_mismatch": 0.20}


def _share(test, of=None):
    return F.coalesce(F.try_divide(F.count_if(test).cast("double"), F.count(F.lit(1)) if of is None else F.count_if(of)), F.lit(0.0))


def coverage(df: DataFrame, cols: list[str], prefix: str | None = None, prefix_col: str = "phone_source") -> DataFrame:
    """(metric, value): share of rows with a value in each column, and of rows whose source begins with the prefix."""
    own = [_share(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in cols]
    if prefix:
        own.append(_share(F.lower(F.coalesce(prefix_col, F.lit(""))).startswith(prefix.lower())).alias(f"{prefix_col}:{prefix}"))
    one = df.agg(*own)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in one.columns])).alias("m")).select("m.*")


def profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls)."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n").alias("rows"), F.col(f"c{i}").alias("nulls")) for i, (c, t) in enumerate(df.dtypes)])).alias("m")).select("m.*")


def count_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def count_by_medium(df: DataFrame, col: str = "ad_sources") -> DataFrame:
    """Rows of each single medium; lists may be arrays, or joined by + or commas."""
    media = F.col(col) if dict(df.dtypes)[col].startswith("array") else F.split(col, "[+,]")
    each = df.select(F.explode(F.array_distinct(F.transform(media, lambda x: F.trim(x)))).alias("medium")).filter("medium <> ''")
    return each.groupBy("medium").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "medium")


def name_length_hist(df: DataFrame, col: str = "company_name") -> DataFrame:
    n = F.length(F.coalesce(col, F.lit("")))
    bucket = F.when(n < 5, "0-4").when(n < 10, "5-9").when(n < 20, "10-19").when(n < 30, "20-29").when(n < 50, "30-49").otherwise("50+")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rank_distribution(df: DataFrame, col: str = "rank") -> DataFrame:
    """(rank, n) for S, A, B and C, zeros included."""
    one = df.agg(*[F.count_if(F.col(col) == r).alias(r) for r in "SABC"])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).alias("n")) for r in "SABC"])).alias("m")).select("m.*")


def companies_per_keyword(df: DataFrame, exclude: list[str]) -> DataFrame:
    from leadmill.functions.text import matches_any

    return df.filter(~matches_any(F.col("keyword"), exclude)).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


def daily_counts(df: DataFrame, as_of, days: int = 7, col: str = "found_date") -> DataFrame:
    """(date, n, baseline): today and the last days with rows, newest first; the baseline is the mean from the third of
    these values on, or today's count below four values."""
    day = F.to_date(F.lit(as_of))
    each = df.filter(F.to_date(col) <= day).groupBy(F.to_date(col).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    top = each.orderBy(F.desc("date")).limit(days)
    rows = top.agg(F.sort_array(F.collect_list(F.struct("date", "n")), False).alias("d"))  # a row a day
    today = F.coalesce(F.get(F.filter("d", lambda x: x.date == day), F.lit(0)).n, F.lit(0).cast("long"))
    past = F.slice(F.filter("d", lambda x: x.date < day), 1, days - 1)
    values = F.concat(F.array(F.struct(day.alias("date"), today.alias("n"))), past)
    tail = F.slice(values, 3, days)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x.n) / F.size(tail)
    base = F.when(F.size(values) >= 4, mean).otherwise(F.greatest(today, F.lit(1)).cast("double"))
    return rows.select(F.explode(values).alias("v"), base.alias("baseline")).select("v.date", "v.n", "baseline")


def speed(df: DataFrame, as_of, hours: int, col: str = "found_at") -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    recent = F.col(col) >= now - F.expr(f"INTERVAL {hours} HOURS")
    return df.filter(F.col(col) <= now).agg((F.count_if(recent) / hours).alias("per_hour"), F.count_if(F.to_date(col) == F.to_date(now)).alias("today"), F.count_if(F.to_date(col) == F.date_sub(F.to_date(now), 1)).alias("yesterday"), F.count(F.lit(1)).alias("total"))


def recent(df: DataFrame, date_col: str, as_of, days: int) -> DataFrame:
    return df.filter(F.to_date(date_col) >= F.date_sub(F.to_date(F.lit(as_of)), days))


def total_and_latest(df: DataFrame, col: str = "found_date") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.max(col).alias("latest"))


def verdicts(evidence: DataFrame, registry_known: DataFrame | None = None) -> DataFrame:
    """(id, result): the first that holds of legal page with name and phone, legal page with the name alone, main page with
    the phone, name in the registry, none; lp_dead where no page was read. evidence(id, page_kind, has_name, has_phone,
    order), pages of kind tokutei, base or dead."""
    e = evidence.withColumn("_v", F.when((F.col("page_kind") == "tokutei") & F.col("has_name"), F.when(F.col("has_phone"), 1).otherwise(2)).when((F.col("page_kind") == "base") & F.col("has_phone"), 3).when(F.col("page_kind") == "dead", 6).otherwise(5))
    # of legal pages with the name the first decides, phone or not
    legal = e.filter("_v <= 2").groupBy("id").agg(F.min_by("_v", "order").alias("_legal"))
    rest = e.groupBy("id").agg(F.min(F.when(F.col("_v") > 2, F.col("_v"))).alias("_rest"), F.min("_v").alias("_any"))
    out = rest.join(legal, "id", "left")
    known = registry_known.select("id").distinct().withColumn("_known", F.lit(True)) if registry_known is not None else None
    out = out.join(known, "id", "left") if known is not None else out.withColumn("_known", F.lit(None).cast("boolean"))
    result = F.when(F.col("_legal") == 1, "tokutei_ok").when(F.col("_legal") == 2, "phone_mismatch").when(F.col("_any") == 6, "lp_dead").when(F.col("_rest") == 3, "base_ok").when(F.col("_known"), "nta_only").otherwise("not_found")
    return out.select("id", result.alias("result"))


def accuracy(verdicts: DataFrame) -> DataFrame:
    """One row: number checked, of each result, and the share that is right."""
    kinds = ["tokutei_ok", "phone_mismatch", "base_ok", "nta_only", "not_found", "lp_dead"]
    one = verdicts.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(F.col("result") == k).alias(k) for k in kinds])
    return one.withColumn("accuracy", F.round(F.coalesce(F.try_divide((F.col("tokutei_ok") + F.col("base_ok")).cast("double"), F.col("checked")), F.lit(0.0)), 4))


def diagnose_rates(accuracy: DataFrame, failures: DataFrame, thresholds: dict[str, float] = THRESHOLDS, key_map: dict[str, str] | None = None) -> DataFrame:
    """(problem, severity, rate, top_source, samples): failure rates at or over their threshold, of at least five checks.
    failures(result, source, company_name); key_map names the accuracy column of a problem where it differs."""
    column = lambda p: (key_map or {}).get(p, p)
    rates = accuracy.filter("checked >= 5").select(F.explode(F.array(*[F.struct(F.lit(p).alias("problem"), (F.col(column(p)) / F.col("checked")).alias("rate"), F.lit(t).alias("threshold")) for p, t in thresholds.items()])).alias("r")).select("r.*").filter("rate >= threshold")
    by = failures.groupBy(F.col("result").alias("problem"), "source").agg(F.count(F.lit(1)).alias("n")).groupBy("problem").agg(F.max_by("source", F.struct("n", "source")).alias("top_source"))
    few = last_n_per_group(failures.withColumn("problem", F.col("result")), "problem", [F.col("company_name")], 3).groupBy("problem").agg(F.array_sort(F.collect_list("company_name")).alias("samples"))
    return rates.join(by, "problem", "left").join(few, "problem", "left").select("problem", F.when(F.col("rate") >= 2 * F.col("threshold"), "high").otherwise("medium").alias("severity"), "rate", "top_source", "samples")


def geo_consistency(df: DataFrame, col: str = "pref_match") -> DataFrame:
    """One row: rows of each level and the share of match and near."""
    levels = ["match", "near", "mismatch", "unknown"]
    one = df.agg(*[F.count_if(F.coalesce(col, F.lit("unknown")) == k).alias(k) for k in levels])
    return one.withColumn("consistency", F.coalesce(F.try_divide((F.col("match") + F.col("near")).cast("double"), sum((F.col(k) for k in levels[1:]), F.col("match"))), F.lit(0.0)))


def compare_runs(old: DataFrame, new: DataFrame, id_: str = "id", fields: tuple[str, ...] = ("company_name", "phone")) -> DataFrame:
    """(status, n): rows of both runs with more, as many or fewer filled fields than before."""
    filled = lambda: sum((F.when(F.coalesce(F.col(f), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    both = old.select(id_, filled().alias("_a")).join(new.select(id_, filled().alias("_b")), id_)
    return both.groupBy(F.when(F.col("_b") > F.col("_a"), "IMPROVED").when(F.col("_b") == F.col("_a"), "SAME").otherwise("WORSE").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def log_rollup(parsed: DataFrame, as_of, hours: int) -> DataFrame:
    """(source, n, captcha, browser_fail, errors) of log lines of the last hours."""
    own = parsed.filter((F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= F.lit(as_of).cast("timestamp")))
    return own.groupBy("source").agg(F.sum("n").alias("n"), F.count_if("captcha").alias("captcha"), F.count_if("browser_fail").alias("browser_fail"), F.count_if("is_error").alias("errors"))
