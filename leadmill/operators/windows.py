"""First, last and best rows of groups, streaks and nearest pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from leadmill.functions.text import digits, name_core, text
from leadmill.operators.scratch import written


def _cols(names) -> list:
    return [names] if isinstance(names, (str, Column)) else list(names)


#: Rows of a share at most, on average, where tasks sort or keep their rows.
SHARE_ROWS = 250_000


def shares(df: DataFrame, rows: int = 0) -> int:
    """A number of shares: enough for all cores, and for at most SHARE_ROWS of so many rows in each."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 4 * spark.sparkContext.defaultParallelism, -(-rows // SHARE_ROWS))


def spread(df: DataFrame, keys, rows: int = 0) -> DataFrame:
    """The rows dealt by their keys, before steps that cost much a row: a file is read by at most as many tasks as it has row
    groups, often one. What is dealt by columns alone is put together again by its bytes, and rows that cost much may have
    few of them; so it is dealt anew, into a fixed number of shares. (The filter, which all rows pass, and the hash keep
    Spark from taking both steps for one.) A filter on a column moves in front of this; what is exploded or mapped after it
    doesn't. rows: how many there may be, where tasks keep them."""
    return dealt(df.repartition(F.xxhash64(*_cols(keys))).filter(F.spark_partition_id() >= 0), keys, rows)


def dealt(df: DataFrame, keys, rows: int = 0) -> DataFrame:
    """The rows in a fixed number of shares by their keys, which windows over these and further keys keep."""
    return df.repartition(shares(df, rows), *_cols(keys))


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*_cols(keys)).orderBy(*_cols(order)))).filter("_k = 1").drop("_k")


def last_n_per_group(df: DataFrame, keys, order, n: int = 5) -> DataFrame:
    """The last n rows of each group; order sorts ascending."""
    back = [F.col(o).desc() if isinstance(o, str) else o.desc() for o in _cols(order)]
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*_cols(keys)).orderBy(*back))).filter(F.col("_k") <= n).drop("_k")


def best_match(candidates: DataFrame, id_: str, query: str = "query", name: str = "name", order: str = "pos") -> DataFrame:
    """Of each query's candidates the one that equals it, equals it loosely, has its legal form, shares most characters
    and differs least in length; ties go to the first."""
    from leadmill.functions.text import legal_form, match_key

    q, n = match_key(F.col(query)), match_key(F.col(name))
    shared = F.size(F.filter(F.split(n, ""), lambda ch: (ch != "") & F.contains(q, ch)))
    score = F.struct((F.col(query) == F.col(name)).alias("exact"), (q == n).alias("loose"), (legal_form(F.col(query)) == legal_form(F.col(name))).alias("form"), shared.alias("shared"), (-F.abs(F.length(q) - F.length(n))).alias("length"))
    scored = spread(candidates, id_).withColumn("_score", score)
    return first_per_key(scored, id_, [F.desc("_score"), F.col(order)]).drop("_score")


#: Rows of a stretch at most, on average.
STRETCH = 2_000_000


def in_stretches(df: DataFrame, order, rows: int = STRETCH) -> tuple[DataFrame, bool]:
    """The frame with `_stretch`, the number of its stretch of the order, and whether there are several: of a key that holds
    a large part of all rows, each stretch is sorted by itself. Stretches are ranges between quantiles of the order, so
    bursts don't make larger ones; rows equal in all of the order share one. Several stretches are written once, as
    quantiles are sampled."""
    n = df.count()
    stretches = -(-n // rows)
    if stretches < 2:
        return df.withColumn("_stretch", F.lit(0)), False
    return written(df.repartitionByRange(stretches, *_cols(order)).withColumn("_stretch", F.spark_partition_id()), "stretches"), True


def _sizes(df: DataFrame, key: str) -> DataFrame:
    """(_key, _at, _n, _begin): of each key and stretch the rows, and how many of the key come before."""
    size = df.groupBy(F.col(key).alias("_key"), F.col("_stretch").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    return size.withColumn("_begin", F.sum("_n").over(W.partitionBy("_key").orderBy("_at")) - F.col("_n"))


def numbered(df: DataFrame, key: str, order, out: str = "number", rows: int = STRETCH) -> DataFrame:
    """Adds the row's number within its key, from 1 on."""
    df, several = in_stretches(df, order, rows)
    df = df.withColumn(out, F.row_number().over(W.partitionBy(key, "_stretch").orderBy(*_cols(order))).cast("long"))
    if several:
        size = _sizes(df, key).drop("_n")
        df = df.join(size, df[key].eqNullSafe(size["_key"]) & (df["_stretch"] == size["_at"])).withColumn(out, F.col(out) + F.col("_begin")).drop("_key", "_at", "_begin")
    return df.drop("_stretch")


def with_rows_before(df: DataFrame, key: str, order, n: int, rows: int = STRETCH) -> DataFrame:
    """The frame with `_stretch` and `_carried`: each stretch of a key also has the key's last n rows before it, marked as
    carried, so that a window over (key, stretch) sees all that one over the key would.

    A row is carried to the stretches that begin less than n rows of the key after it. Numbers within a key are cut into
    bins of n: a row meets the beginnings in its own bin and the next, so the join is on equal bins."""
    df, several = in_stretches(df, order, rows)
    own = df.withColumn("_carried", F.lit(False))
    if not several:
        return own
    back = [F.col(o).desc() for o in _cols(order)]
    last = df.withColumn("_r", F.row_number().over(W.partitionBy(key, "_stretch").orderBy(*back))).filter(F.col("_r") <= n)
    size = _sizes(df, key)
    ends = size.select("_key", "_at", (F.col("_begin") + F.col("_n")).alias("_end"))
    last = last.join(ends, last[key].eqNullSafe(ends["_key"]) & (last["_stretch"] == ends["_at"])).withColumn("_no", F.col("_end") - F.col("_r") + 1).drop("_key", "_at", "_end", "_r")
    first = F.floor(F.col("_no") / n)
    last = last.withColumn("_bin", F.explode(F.array(first, first + 1)))
    begins = size.filter("_begin > 0").select(F.col("_key").alias("_to_key"), F.col("_at").alias("_to"), "_begin", F.floor(F.col("_begin") / n).alias("_to_bin"))
    near = (F.col("_begin") >= F.col("_no")) & (F.col("_begin") < F.col("_no") + n)
    carried = last.join(begins, last[key].eqNullSafe(begins["_to_key"]) & (last["_bin"] == begins["_to_bin"])).filter(near & (F.col("_to") > F.col("_stretch")))
    return own.unionByName(carried.select(*[c for c in df.columns if c != "_stretch"], F.col("_to").alias("_stretch"), F.lit(True).alias("_carried")))


def rolling_success(df: DataFrame, n: int = 100, min_n: int = 50, key: str = "source", order=("ts", "id"), ok: str = "ok", rows: int = STRETCH) -> DataFrame:
    """Adds the share of successes among the last n events of the key; null below min_n events."""
    w = W.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(-(n - 1), 0)
    out = with_rows_before(df, key, order, n - 1, rows).withColumn("seen", F.count(F.lit(1)).over(w))
    return out.withColumn("rate", F.when(F.col("seen") >= min_n, F.avg(F.col(ok).cast("double")).over(w))).filter("not _carried").drop("_carried", "_stretch")


def runs(df: DataFrame, hit: Column, key: str, order, out: str = "run", rows: int = STRETCH) -> DataFrame:
    """Adds how many rows with a hit follow one another up to each row, 0 without one."""
    df, several = in_stretches(df.withColumn("_hit", hit), order, rows)
    w = W.partitionBy(key, "_stretch").orderBy(*_cols(order))
    df = df.withColumn("_island", F.sum((~F.col("_hit")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = F.sum(F.col("_hit").cast("long")).over(W.partitionBy(key, "_stretch", "_island").orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_run", run)
    if several:
        # a row a key and stretch: the run at its end, and whether it lies wholly in the stretch
        ends = df.groupBy(key, "_stretch").agg(F.max("_island").alias("_breaks"), F.max_by(F.when(F.col("_hit"), F.col("_run")).otherwise(0), F.struct(*_cols(order))).alias("_tail"))
        along = W.partitionBy(key).orderBy("_stretch")
        ends = ends.withColumn("_group", F.sum((F.col("_breaks") > 0).cast("int")).over(along))
        ends = ends.withColumn("_sum", F.sum("_tail").over(W.partitionBy(key, "_group").orderBy("_stretch").rowsBetween(W.unboundedPreceding, 0)))
        ends = ends.select(F.col(key).alias("_key"), F.col("_stretch").alias("_to"), F.coalesce(F.lag("_sum").over(along), F.lit(0)).alias("_before"))
        df = df.join(ends, df[key].eqNullSafe(ends["_key"]) & (df["_stretch"] == ends["_to"])).withColumn("_run", F.col("_run") + F.when(F.col("_island") == 0, F.col("_before")).otherwise(0)).drop("_key", "_to", "_before")
    return df.withColumn(out, F.when(F.col("_hit"), F.col("_run")).otherwise(0)).drop("_hit", "_island", "_run", "_stretch")


def nearest_pair(lines: DataFrame, max_dist: int = 8, id_: str = "doc_id") -> DataFrame:
    """lines(id, line, company, phone): the company and phone lines of a document that lie nearest, at most max_dist
    apart; the first of equals."""
    c = lines.filter("company is not null").select(id_, F.col("line").alias("company_line"), "company")
    p = lines.filter("phone is not null").select(id_, F.col("line").alias("phone_line"), "phone")
    # bins of max_dist lines: a pair lies in the same bin or in one beside it, so no document's lines are all paired
    c = c.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("company_line") / (max_dist + 1)) - 1, F.floor(F.col("company_line") / (max_dist + 1)) + 1)))
    pairs = c.join(p.withColumn("_bin", F.floor(F.col("phone_line") / (max_dist + 1))), [id_, "_bin"]).withColumn("distance", F.abs(F.col("company_line") - F.col("phone_line"))).filter(F.col("distance") <= max_dist)
    best = F.min_by(F.struct("company", "phone", "distance"), F.struct("distance", "company_line", "phone_line"))
    return pairs.groupBy(id_).agg(best.alias("b")).select(id_, "b.company", "b.phone", "b.distance")


def trend(history: DataFrame, value: str = "seigoritsu", order: str = "timestamp", flat: float = 0.01) -> DataFrame:
    """One row: newest value against the oldest (up, down or flat) and against the one before."""
    h = history.filter(F.col(value).isNotNull())
    top = h.orderBy(F.desc(order)).limit(2).agg(F.sort_array(F.collect_list(F.struct(order, value)), False).alias("top"))
    old = h.agg(F.min_by(value, order).alias("oldest"))
    both = top.join(old, how="cross")  # one row each
    newest, before = F.col("top")[0][value], F.get("top", F.lit(1))[value]
    d = newest - F.col("oldest")
    return both.select(newest.alias("newest"), "oldest", before.alias("previous"), F.when(d > flat, "up").when(d < -flat, "down").otherwise("flat").alias("trend"), (newest - before).alias("change"))


def streaks(df: DataFrame, ok: str, reset_at: int = 3, key: str = "source", order: str = "ts", rows: int = STRETCH) -> DataFrame:
    """Adds the length of the current run of ok rows, starting anew after each reset_at-th, and whether it acts there."""
    out = runs(df, F.col(ok), key, order, "_streak", rows)
    streak = F.when(F.col("_streak") > 0, F.pmod(F.col("_streak") - 1, F.lit(reset_at)) + 1).otherwise(0)
    return out.withColumn("streak", streak.cast("int")).withColumn("act", F.col("streak") == reset_at).drop("_streak")


def latest_pending(history: DataFrame, problem: str = "problem", order: str = "ts", status: str = "status") -> DataFrame:
    return first_per_key(history.filter(F.col(status) == "pending"), problem, F.desc(order))


def mark_done(history: DataFrame, problem: str, as_of, name: str = "problem", status: str = "status") -> DataFrame:
    """Pending entries of the problem up to as_of become done."""
    done = (F.col(name) == problem) & (F.col(status) == "pending") & (F.col("ts") <= F.lit(as_of))
    return history.withColumn(status, F.when(done, "done").otherwise(F.col(status)))


def resolve_fields(candidates: DataFrame, id_: str, field: str = "field", value: str = "value", priority: str = "priority") -> DataFrame:
    """candidates(id, field, value, priority, ok): per field the acceptable value of least priority, a name in the local
    script before others."""
    local = F.rlike(F.col(value), F.lit("[ぁ-んァ-ン一-鿿]"))
    order = F.struct(F.when((F.col(field) == "name") & ~local, 1).otherwise(0).alias("script"), F.col(priority), F.col(value))
    return candidates.filter(F.col("ok") & F.col(value).isNotNull()).groupBy(id_, field).agg(F.min_by(value, order).alias(value), F.min_by(priority, order).alias(priority))


def nearest_phone(df: DataFrame, body: str, company: str, phones: str, out: str = "phone") -> DataFrame:
    """Adds of several phones the one nearest the company's name in the text, other lines before free ones; the first
    where the name doesn't occur."""
    t = F.regexp_replace(text(F.col(body)), r"[-‐－ー()（） ]", "")
    at = F.position(F.regexp_replace(name_core(F.col(company), 10), r"[-‐－ー()（） ]", ""), t)
    ranked = F.transform(F.col(phones), lambda p, i: F.struct(F.left(digits(p), F.lit(4)).isin("0120", "0800", "0570", "0990").alias("free"), F.when((at > 0) & F.contains(t, digits(p)), F.abs(F.position(digits(p), t) - at)).otherwise(F.lit(1 << 30)).alias("distance"), i.alias("i"), p.alias("phone")))
    return df.withColumn(out, F.array_min(ranked).phone)


def latest(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(*[F.desc(o) for o in _cols(order)]).limit(n)


def retain_latest(df: DataFrame, order, n: int = 500) -> DataFrame:
    return latest(df, order, n)


def top_keywords(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("total_found"), "keyword").limit(n)


#: So many rows at most come from one top-k, which gathers as many from each task.
TOP = 100_000
#: Ranges that values are counted in at once.
BINS = 4096


def least_rows(df: DataFrame, order, n: int, top: int | None = None) -> DataFrame:
    """The n least rows in order, in no order themselves if n is beyond TOP.

    Few are a top-k. Many are a cut: rows are counted in BINS ranges of the order's first number, the range that holds the
    n-th is counted anew in finer ones until it has few rows, then all rows below it and the least of it are taken. Where
    the first column is no number, or very many rows share a value of it, the cut is by sorted stretches of them.
    """
    cols, top = _cols(order), top or TOP
    if n <= top:
        return df.orderBy(*cols).limit(n)
    one = df.select(F.col(cols[0]) if isinstance(cols[0], str) else cols[0]).schema[0].dataType
    if not isinstance(one, T.NumericType):
        return _least_by_stretches(df, cols, n, top)
    at = F.coalesce((F.col(cols[0]) if isinstance(cols[0], str) else cols[0]).cast("double"), F.lit(float("-inf")))
    finite = df.filter(at > float("-inf")).agg(F.min(at), F.max(at)).first()
    low, high, inside, below = finite[0], finite[1], at > float("-inf"), at == float("-inf")
    left = n - df.filter(below).count()
    if low is None or left <= 0:
        return _least_by_stretches(df, cols, n, top)
    while True:
        width = (high - low) / BINS
        place = F.least(F.greatest(F.floor((at - low) / width), F.lit(0)), F.lit(BINS - 1)) if width > 0 else F.lit(0).cast("long")
        counts = dict(df.filter(inside).groupBy(place.alias("bin")).count().collect())  # a row a range
        cut = None
        for b in sorted(counts):
            if left <= counts[b]:
                cut = b
                break
            left -= counts[b]
        if cut is None:
            return df  # there are no more than n
        below = below | (inside & (place < cut))
        inside = inside & (place == cut)
        if counts[cut] <= top or width <= 0 or low + width * (cut + 1) <= low + width * cut:
            break
        low, high = low + width * cut, low + width * (cut + 1)
    few = df.filter(inside)
    last = few.orderBy(*cols).limit(left) if left <= top or counts[cut] <= top else _least_by_stretches(few, cols, left, top)
    return df.filter(below).unionByName(last)


def _least_by_stretches(df: DataFrame, cols: list, n: int, top: int) -> DataFrame:
    named = df
    for i, c in enumerate(cols):
        named = named.withColumn(f"_o{i}", F.col(c) if isinstance(c, str) else c)
    order = [f"_o{i}" for i in range(len(cols))]
    cut, several = in_stretches(named, order, max(top, 1))
    if not several:
        return df.orderBy(*cols).limit(n)
    left, last = n, None
    for stretch, count in sorted(map(tuple, cut.groupBy("_stretch").count().collect())):  # a row a stretch
        if left <= count:
            last = stretch
            break
        left -= count
    if last is None:
        return df
    part = cut.filter(F.col("_stretch") == last).orderBy(*order).limit(left)
    return cut.filter(F.col("_stretch") < last).unionByName(part).select(df.columns)


def sample_n(df: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """n rows by a seeded hash: the same rows for the same seed."""
    return least_rows(df, [F.xxhash64(F.col(id_), F.lit(seed)), id_], n)


def weighted_pick(df: DataFrame, weight: Column, k: int, seed: int, boost: Column | None = None, factor: float = 10.0, key: str = "keyword") -> DataFrame:
    """k rows drawn without replacement, likelier by weight: the least of -ln(u) / weight, u from a seeded hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    w = weight * (F.when(boost, factor).otherwise(1.0) if boost is not None else F.lit(1.0))
    return least_rows(df, [-F.log(u) / w, key], k)


def least_recent(df: DataFrame, ts: str) -> DataFrame:
    return df.orderBy(F.col(ts).asc_nulls_first())


def retry_batch(df: DataFrame, max_retry: int = 5, n: int = 100) -> DataFrame:
    """Newest rows with a name, no registry number and tries left."""
    open_ = (F.coalesce("corporate_number", F.lit("")) == "") & (F.coalesce("company_name", F.lit("")) != "") & (F.coalesce("nta_retry_count", F.lit(0)) < max_retry)
    return df.filter(open_).orderBy(F.desc("id")).limit(n)


def merge_sources(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_union(a, b)))


def ordered_union(dfs: list[DataFrame], key: str, order: str = "pos") -> DataFrame:
    """Rows of all frames, the first of each key: earlier frames first, then their own order."""
    parts = [d.withColumn("_from", F.lit(i)) for i, d in enumerate(dfs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return first_per_key(out, key, ["_from", order]).drop("_from")


def candidate_urls(links: DataFrame, sites: DataFrame, paths: list[str]) -> DataFrame:
    """(site, url, priority): links found on a site, then fixed paths under it that weren't found."""
    fixed = sites.select("site", F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("i", "p")).select("site", F.concat("site", "p").alias("url"), (F.lit(1000) + F.col("i")).alias("priority"))
    return first_per_key(links.select("site", "url", F.col("pos").alias("priority")).unionByName(fixed), ["site", "url"], "priority")
