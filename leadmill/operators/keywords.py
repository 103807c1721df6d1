"""Search planning: which keyword and area next, keyword life cycle, new keywords from old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from leadmill.operators.windows import dealt, first_per_key, least_rows, sample_n

# Cities and synonyms by which productive keywords are extended.
CITIES = ["東京", "大阪", "名古屋", "福岡", "横浜", "埼玉", "千葉", "神戸", "京都", "札幌", "仙台", "広島", "静岡", "新潟", "熊本"]
SYNONYMS = {
    "業者": ["会社", "専門", "業者 おすすめ"], "会社": ["業者", "法人"], "支援": ["代行", "サービス"], "代行": ["支援", "サービス", "アウトソーシング"],
    "サービス": ["会社", "業者"], "コンサルティング": ["コンサル", "支援"], "導入": ["活用", "利用"], "設置": ["工事", "取り付け"],
}


def _before(as_of, hours: float):
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")


def seed_keywords(groups: DataFrame, industries: list[str] | None = None) -> DataFrame:
    """(industry, source, keyword) from groups(industry, google_yahoo, meta), both lists; optionally of some industries."""
    g = groups if industries is None else groups.filter(F.col("industry").isin(industries))
    both = F.explode(F.array(F.struct(F.lit("google_yahoo").alias("source"), F.col("google_yahoo").alias("words")), F.struct(F.lit("meta").alias("source"), F.col("meta").alias("words"))))
    return g.select("industry", both.alias("s")).select("industry", "s.source", F.explode("s.words").alias("keyword")).dropDuplicates(["keyword", "source"])


def next_keywords(keywords: DataFrame, log: DataFrame, source: str, area: str, cooling_h: float, as_of) -> DataFrame:
    """Active keywords of the source that weren't searched in the area within the cooling time, oldest first."""
    own = log.filter((F.col("area_name") == area) & (F.col("source") == source)).groupBy("keyword").agg(F.max("last_searched").alias("_last"))
    rows = keywords.filter((F.col("source") == source) & ~F.col("is_archived")).join(own, "keyword", "left")
    return rows.filter(F.col("_last").isNull() | (F.col("_last") < _before(as_of, cooling_h))).orderBy(F.col("_last").asc_nulls_first(), "keyword").drop("_last")


def available_pairs(keywords: DataFrame, areas: DataFrame, log: DataFrame, source: str, cooling_h: float, as_of) -> DataFrame:
    """(keyword, area, weight): active keywords with each area, less the pairs searched within the cooling time. areas is
    the short list of places that is searched."""
    pairs = keywords.filter((F.col("source") == source) & ~F.col("is_archived")).select("keyword", F.sqrt(F.coalesce("total_found", F.lit(0)) + 1).alias("weight"))
    named = areas.agg(F.array_sort(F.collect_set("name")).alias("_areas"))
    pairs = pairs.join(named, how="cross").select("keyword", "weight", F.explode("_areas").alias("area"))  # one row of names
    recent = log.filter(F.col("last_searched") >= _before(as_of, cooling_h)).select("keyword", F.col("area_name").alias("area")).distinct()
    return pairs.join(recent, ["keyword", "area"], "left_anti").select("keyword", "area", "weight")


def availability(keywords: DataFrame, cooling_h: float, as_of) -> DataFrame:
    """One row: share of active keywords that may be searched; 1 if there are none."""
    active, free = ~F.col("is_archived"), F.col("last_searched").isNull() | (F.col("last_searched") < _before(as_of, cooling_h))
    return keywords.agg(F.coalesce(F.try_divide(F.count_if(active & free).cast("double"), F.count_if(active)), F.lit(1.0)).alias("availability"))


def keyword_yield(keywords: DataFrame, inserts: DataFrame) -> DataFrame:
    """Keywords with total_found and last_new_company brought up to date. inserts(keyword, ts)."""
    new = inserts.groupBy("keyword").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_ts"))
    out = keywords.join(new, "keyword", "left")
    return out.withColumn("total_found", (F.coalesce("total_found", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int")).withColumn("last_new_company", F.greatest("last_new_company", "_ts")).select(keywords.columns)


def keyword_status(keywords: DataFrame, cooling_h: float, as_of) -> DataFrame:
    active = ~F.col("is_archived")
    return keywords.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~active).alias("archived"), F.count_if(active).alias("active"),
        F.count_if(active & F.col("last_searched").isNull()).alias("unsearched"), F.count_if(active & (F.col("last_searched") >= _before(as_of, cooling_h))).alias("cooling"),
    )


def recycle(keywords: DataFrame, source: str, n: int) -> DataFrame:
    """The n longest unsearched archived keywords of the source become active."""
    back = keywords.filter((F.col("source") == source) & F.col("is_archived")).orderBy(F.col("last_searched").asc_nulls_first(), "keyword").limit(n).select(F.col("keyword").alias("_k"), F.lit(True).alias("_back"))
    return keywords.join(back, (F.col("keyword") == F.col("_k")) & (F.col("source") == source), "left").withColumn("is_archived", F.col("is_archived") & F.col("_back").isNull()).select(keywords.columns)


def reserve_left(reserve: DataFrame, keywords: DataFrame) -> DataFrame:
    return reserve.join(keywords.select("keyword").distinct(), "keyword", "left_anti")


def refill(keywords: DataFrame, reserve: DataFrame, source: str, threshold: int, n: int, as_of, seed: int, cooling_h: float = 24) -> DataFrame:
    """Keywords to add: n of the reserve at random if fewer than threshold may be searched, else none."""
    free = keywords.filter((F.col("source") == source) & ~F.col("is_archived") & (F.col("last_searched").isNull() | (F.col("last_searched") < _before(as_of, cooling_h)))).limit(threshold).agg(F.count(F.lit(1)).alias("_free"))
    picked = sample_n(reserve_left(reserve, keywords), "keyword", n, seed)
    return picked.join(free, how="cross").filter(F.col("_free") < threshold).select(picked.columns)  # one row


def archive_stale(keywords: DataFrame, days: int, as_of) -> DataFrame:
    limit = _before(as_of, 24 * days)
    stale = (F.col("last_searched") < limit) & (F.col("last_new_company").isNull() | (F.col("last_new_company") < limit))
    return keywords.withColumn("is_archived", F.col("is_archived") | F.coalesce(stale, F.lit(False)))


def restore_archived(keywords: DataFrame, min_active: int = 5) -> DataFrame:
    """Sources with at most so many active keywords get all of theirs back."""
    low = keywords.groupBy("source").agg(F.count_if(~F.col("is_archived")).alias("_n")).filter(F.col("_n") <= min_active).select(F.col("source").alias("_s"))
    return keywords.join(low, F.col("source") == F.col("_s"), "left").withColumn("is_archived", F.col("is_archived") & F.col("_s").isNull()).select(keywords.columns)


def apply_keyword_commands(keywords: DataFrame, commands: DataFrame) -> DataFrame:
    """commands(pos, command, keyword, source): 'add' puts a keyword anew with empty counters, 'archive' archives it; the
    last command of a keyword wins."""
    last = first_per_key(commands.filter(F.col("command").isin("add", "archive")), "keyword", F.desc("pos")).select("keyword", F.col("command").alias("_c"), F.col("source").alias("_s"))
    kept = keywords.join(last.filter("_c = 'add'"), "keyword", "left_anti").join(last.filter("_c = 'archive'").select("keyword", "_c"), "keyword", "left").withColumn("is_archived", F.col("is_archived") | F.col("_c").isNotNull()).select(keywords.columns)
    types = dict(keywords.dtypes)
    values = {"keyword": F.col("keyword"), "source": F.col("_s"), "total_found": F.lit(0), "is_archived": F.lit(False)}
    added = last.filter("_c = 'add'").select(*[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in keywords.columns])
    return kept.unionByName(added)


def touch_pairs(log: DataFrame, picks: DataFrame, as_of) -> DataFrame:
    """The log with the picked pairs searched at as_of. picks(keyword, area_name)."""
    new = picks.select("keyword", "area_name", F.lit(as_of).cast("timestamp").alias("last_searched"))
    return log.select("keyword", "area_name", "last_searched").unionByName(new).groupBy("keyword", "area_name").agg(F.max("last_searched").alias("last_searched"))


def expand_keywords(keywords: DataFrame, cities: list[str] = CITIES, synonyms: dict[str, list[str]] = SYNONYMS, per_key: int = 15, total: int = 10_000, seed: int = 0, min_found: int = 3) -> DataFrame:
    """(keyword, base): new variants of productive keywords, cities in random order first, then synonyms; at most per_key
    a keyword and total in all, both with those made before."""
    base = keywords.filter((F.col("total_found") >= min_found) & (F.col("source") != "meta")).select(F.col("keyword").alias("base"))
    geo = base.select("base", F.explode(F.array(*[F.lit(c) for c in cities])).alias("c")).select("base", F.concat_ws(" ", "base", "c").alias("keyword"), F.lit(0).alias("kind"), F.xxhash64("base", "c", F.lit(seed)).alias("place"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(i).alias("i")) for i, (a, b) in enumerate((a, b) for a, bs in synonyms.items() for b in bs)]))
    at = F.expr("locate(p.a, base)")
    changed = F.concat(F.expr("left(base, locate(p.a, base) - 1)"), F.col("p.b"), F.expr("substring(base, locate(p.a, base) + length(p.a))"))
    syn = base.select("base", pairs.alias("p")).filter(at > 0).select("base", changed.alias("keyword"), F.lit(1).alias("kind"), F.col("p.i").cast("long").alias("place"))
    made = keywords.filter("source = 'auto_expanded'")
    had = made.withColumn("base", F.regexp_extract("keyword", r"^(.*) \S+$", 1)).groupBy("base").agg(F.count(F.lit(1)).alias("_had"))
    # tasks sort their rows: there are as many shares as rows ask for, whatever the bytes of a share
    rows = base.count() * (len(cities) + sum(map(len, synonyms.values())))
    new = first_per_key(dealt(geo.unionByName(syn), "keyword", rows), "keyword", ["kind", "place", "base"]).join(keywords.select("keyword"), "keyword", "left_anti")
    new = dealt(new, "base", rows).join(had, "base", "left")
    ranked = new.withColumn("_r", F.row_number().over(W.partitionBy("base").orderBy("kind", "place"))).filter(F.col("_r") <= per_key - F.coalesce("_had", F.lit(0)))
    left = total - made.limit(total).count()
    return (least_rows(ranked, ["_r", "base", "keyword"], left) if left else ranked.limit(0)).select("keyword", "base")


def cross_modifiers(base: DataFrame, mods: list[str]) -> DataFrame:
    return base.select(F.col("keyword").alias("base"), F.explode(F.array(*[F.lit(m) for m in mods])).alias("m")).select(F.concat_ws(" ", "base", "m").alias("keyword"), "base")


def generate_keywords(services: DataFrame, cities: list[str]) -> DataFrame:
    """Distinct keywords in order: service, service + modifier, city + service, city + service + each of its first two
    modifiers. services(service, modifiers)."""
    none, places = F.array().cast("array<string>"), F.array(*[F.lit(c) for c in cities])
    mods = F.coalesce("modifiers", none)
    plain = F.concat(F.array("service"), F.transform(mods, lambda m: F.concat_ws(" ", "service", m)))
    local = F.flatten(F.transform(places, lambda c: F.concat(F.array(F.concat_ws(" ", c, "service")), F.transform(F.slice(mods, 1, 2), lambda m: F.concat_ws(" ", c, "service", m)))))
    return services.select(F.explode(F.concat(plain, local)).alias("keyword")).distinct().orderBy("keyword")


def tune(settings: DataFrame, stats: DataFrame) -> DataFrame:
    """settings(source, cooling_hours, min_delay, max_delay), stats(source, availability, today, baseline, zero_rate,
    extraction_rate, streak): settings for the next run, within fixed floors and ceilings."""
    j = settings.join(stats, "source", "left")
    ill = (F.col("zero_rate") > 0.70) | (F.col("extraction_rate") < 0.08)
    slow = ~ill & (F.col("baseline") > 0) & (F.col("today") < F.col("baseline") * 0.55)
    stable = ~ill & ~slow & (F.col("streak") >= 3)

    def delay(name: str, floor: int, ceiling: int):
        grown, shrunk = F.floor(F.col(name) * 1.20).cast("int"), F.floor(F.col(name) * 0.85).cast("int")
        return F.when(slow, F.least(F.lit(ceiling), grown)).when(stable, F.greatest(F.lit(floor), shrunk)).otherwise(F.col(name)).alias(name)

    cooling = F.when(F.col("availability") < 0.15, F.greatest(F.lit(4), F.col("cooling_hours") - 1)).otherwise(F.col("cooling_hours"))
    return j.select("source", cooling.alias("cooling_hours"), delay("min_delay", 5, 60), delay("max_delay", 20, 300))
