"""Joins: hosts against lists, names against the registry, phones against places, records against pages.

Dimension tables (host lists, area prefixes, neighbours) are small lists that callers hand in; they join by Spark's own
choice, which broadcasts them by their size. No join is by LIKE or OR: containment goes through suffixes or n-grams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from leadmill.functions.text import digits, has, legal_form, name_core, normalize_company, registry_core, strip_garbage, text
from leadmill.functions.urls import host, host_suffixes
from leadmill.operators.scratch import removed, scope, written
from leadmill.operators.windows import dealt, first_per_key, spread


def flag_hosts(df: DataFrame, url: str, hosts: DataFrame, out: str = "listed") -> DataFrame:
    """Adds whether the URL's host is a listed one or below it. hosts(host)."""
    listed = hosts.select(F.lower("host").alias("_host")).distinct()
    hit = df.select(F.col(url).alias("_url")).distinct().withColumn("_host", F.explode(host_suffixes(host(F.col("_url"))))).join(listed, "_host", "left_semi").select("_url").distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, df[url] == hit["_url"], "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_url", "_hit")


def drop_hosts(df: DataFrame, url: str, hosts: DataFrame) -> DataFrame:
    """Rows whose host is neither listed nor below a listed one."""
    return flag_hosts(df, url, hosts, "_listed").filter("not _listed").drop("_listed")


def base_domain(df: DataFrame, url: str, suffixes: DataFrame, out: str = "base_domain") -> DataFrame:
    """Adds the registered domain: one label before the longest public suffix; the host without www. if none fits."""
    urls = df.select(F.col(url).alias("_url")).distinct().withColumn("_h", host(F.col("_url")))
    parts = urls.select("_url", "_h", F.explode(host_suffixes(F.col("_h"))).alias("suffix"))
    best = parts.join(suffixes.select("suffix").distinct(), "suffix", "left_semi").groupBy("_url").agg(F.max_by("suffix", F.length("suffix")).alias("_s"))
    one = F.regexp_extract(F.left(F.col("_h"), F.length("_h") - F.length("_s") - 1), r"([^.]+)$", 1)
    found = urls.join(best, "_url", "left").select("_url", F.when(F.length("_h") > F.length("_s"), F.concat_ws(".", one, "_s")).otherwise(F.regexp_replace("_h", r"^www\.", "")).alias("_d"))
    return df.join(found, df[url].eqNullSafe(found["_url"]), "left").drop("_url", *([out] if out in df.columns else [])).withColumnRenamed("_d", out)


def phone_prefecture(df: DataFrame, phone: str, prefixes: DataFrame, out: str = "phone_pref") -> DataFrame:
    """Adds the prefecture of the longest area prefix (two to five digits); null for mobile, IP and free numbers.
    prefixes(prefix, prefecture)."""
    d = digits(F.col(phone))
    known = F.when(F.startswith(d, F.lit("0")) & ~has(d, "^(?:0[789]0|050|0120|0800|0570|0990)"), d)
    rows = df.withColumn("_d", known)
    lengths = (5, 4, 3, 2)
    for n in lengths:
        p = prefixes.filter(F.length("prefix") == n).select(F.col("prefix").alias(f"_k{n}"), F.col("prefecture").alias(f"_p{n}"))
        rows = rows.join(p, F.left("_d", F.lit(n)) == F.col(f"_k{n}"), "left").drop(f"_k{n}")
    return rows.withColumn(out, F.coalesce(*[f"_p{n}" for n in lengths])).drop("_d", *[f"_p{n}" for n in lengths])


def pref_match(df: DataFrame, pref: str, phone_pref: str, adjacency: DataFrame, out: str = "pref_match") -> DataFrame:
    """Adds match, near (neighbours, as listed), mismatch or unknown. adjacency(src, dst)."""
    near = adjacency.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.lit(True).alias("_near")).distinct()
    rows = df.join(near, (df[pref] == near["_src"]) & (df[phone_pref] == near["_dst"]), "left")
    a, b = text(F.col(pref)), text(F.col(phone_pref))
    level = F.when((a == "") | (b == ""), "unknown").when(a == b, "match").when(F.col("_near"), "near").otherwise("mismatch")
    return rows.withColumn(out, level).drop("_src", "_dst", "_near")


def resolve_exact_or_core(names: DataFrame, registry: DataFrame) -> DataFrame:
    """names(name): the registered company of the same name ('exact'), else of the same core ('partial'), else 'none'."""
    names = names.withColumn("_core", normalize_company(F.col("name")))
    exact = first_per_key(registry.select(F.col("name").alias("_name"), F.col("corp_number").alias("_n1"), F.col("pref").alias("_p1")), "_name", "_n1")
    core = registry.select(normalize_company(F.col("name")).alias("_core"), F.col("name").alias("_o2"), F.col("corp_number").alias("_n2"), F.col("pref").alias("_p2")).filter("_core <> ''")
    core = first_per_key(core, "_core", "_n2")
    both = names.join(exact, names["name"] == exact["_name"], "left").join(core, "_core", "left")
    label = F.when(F.col("_n1").isNotNull(), "exact").when(F.col("_n2").isNotNull(), "partial").otherwise("none")
    return both.select(*[c for c in names.columns if c != "_core"], F.coalesce("_name", "_o2").alias("official_name"), F.coalesce("_n1", "_n2").alias("corp_number"), F.coalesce("_p1", "_p2").alias("pref"), label.alias("confidence"))


def _guarded(names: DataFrame, registry: DataFrame, query: str) -> DataFrame:
    q = names.withColumn("_q", F.col(query)).withColumn("_core", registry_core(F.col(query))).withColumn("_form", legal_form(F.col(query)))
    r = registry.select(registry_core(F.col("name")).alias("_core"), F.col("name").alias("_official"), F.col("corp_number").alias("_num"), F.col("pref").alias("_pref")).filter("_core <> ''")
    hit = q.select("name", "_core", "_form").distinct().join(r, "_core").filter("_form = '' or contains(_official, _form)")
    return first_per_key(hit, "name", "_num").select(F.col("name").alias("_key"), "_official", "_num", "_pref")


def resolve_guarded(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Same core and same legal form; what isn't found is looked up again after a light clean-up."""
    first = _guarded(names.select("name").distinct(), registry, "name")
    rest = names.select("name").distinct().join(first, F.col("name") == F.col("_key"), "left_anti").withColumn("_clean", strip_garbage(F.col("name"))).filter("_clean <> name and length(_clean) >= 4")
    found = first.unionByName(_guarded(rest, registry, "_clean"))
    out = names.join(found, names["name"] == found["_key"], "left")
    return out.select(*names.columns, F.col("_official").alias("official_name"), F.col("_num").alias("corp_number"), F.col("_pref").alias("pref"), F.when(F.col("_num").isNotNull(), "guarded").otherwise("none").alias("confidence"))


def _grams(c, n: int = 3):
    """Distinct n-grams; a shorter text is its own only gram."""
    return F.array_distinct(F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array(c)))


def _met(left: DataFrame, entries: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with what was taken apart into n-grams or digits. Its size is estimated by the rows it came from, which would
    have the driver broadcast it; the hint has both sides shuffled, however small the estimate."""
    return left.join(entries.hint("merge"), keys, how)


def search_trigram(names: DataFrame, registry: DataFrame, k: int = 5) -> DataFrame:
    """(query, official_name, corp_number, pref, pos): registered names that contain the query, at most k by number.
    A query looks up its rarest trigram alone, among distinct names; containment is then checked, so neither a frequent
    trigram nor a name that many companies have costs anything. Of a name its k least numbers are enough, of a query the k
    names whose least number is least."""
    q = names.select(F.col("name").alias("query")).filter("length(query) >= 3").distinct()
    numbered = registry.select("corp_number", "name", "pref").withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy("corp_number"))).filter(F.col("_r") <= k)
    once = registry.groupBy("name").agg(F.min("corp_number").alias("least"))
    grams = once.select("least", "name", F.explode(_grams(F.col("name"))).alias("gram"))
    uses = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    asked = _met(q.select("query", F.explode(_grams(F.col("query"))).alias("gram")), uses, ["gram"], "left")
    rare = asked.groupBy("query").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram")).alias("g")).filter("g.uses > 0").select("query", F.col("g.gram").alias("gram"))
    hits = _met(rare, grams, ["gram"]).filter("contains(name, query)").select("query", "name", "least")
    first = hits.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy("least"))).filter(F.col("_n") <= k).select("query", "name")
    each = _met(first, numbered.drop("_r"), ["name"])
    ranked = each.withColumn("pos", F.row_number().over(W.partitionBy("query").orderBy("corp_number"))).filter(F.col("pos") <= k)
    return ranked.select("query", F.col("name").alias("official_name"), "corp_number", "pref", "pos")


#: Folders that a kept index is dealt into by its trigrams.
INDEX_BUCKETS = 256


def _indexed(registry: DataFrame) -> DataFrame:
    return registry.select("corp_number", "name", "pref", F.explode(_grams(F.col("name"))).alias("gram")).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(INDEX_BUCKETS)).cast("int"))


def refresh_index(registry: DataFrame, path: str) -> int:
    """Brings the stored index under path up to the registry and gives the number of its folders that were written: all at
    first, then those with a trigram of a company that came, went or changed. path/entries holds the companies it has,
    path/grams their trigrams and path/uses how many companies have each, both by folders."""
    spark = registry.sparkSession
    own = registry.select("corp_number", "name", "pref").distinct()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/entries")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        touched, grams = list(range(INDEX_BUCKETS)), _indexed(own)
        return _kept(spark, own, grams, touched, path)
    had = spark.read.schema(own.schema).parquet(f"{path}/entries")
    with scope(spark):
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own.columns]
        alone = lambda a, b: a.join(b.select(*[F.col(c).alias(f"_{c}") for c in own.columns]), same, "left_anti")
        own = written(own, "entries")
        came, went = written(_indexed(alone(own, had)), "came"), written(_indexed(alone(had, own)), "went")
        touched = sorted(r.bucket for r in came.select("bucket").union(went.select("bucket")).distinct().collect())  # INDEX_BUCKETS at most
        if not touched:
            return 0
        old = spark.read.schema(came.schema).parquet(f"{path}/grams").filter(F.col("bucket").isin(touched))
        gone = went.select(*[F.col(c).alias(f"_{c}") for c in (*own.columns, "gram")])
        left = old.join(gone, [*same, F.col("gram") == F.col("_gram")], "left_anti")
        return _kept(spark, own, written(left.unionByName(came), "grams"), touched, path)


def _kept(spark, entries: DataFrame, grams: DataFrame, touched: list[int], path: str) -> int:
    """Writes the touched folders; those that lost all their rows are removed. entries comes last: if a write before it
    fails, the next refresh writes the same folders again."""
    put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")
    put(grams.repartition("bucket").sortWithinPartitions("bucket", "gram"), "grams")
    put(grams.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("uses")), "uses")
    full = {r.bucket for r in grams.select("bucket").distinct().collect()}
    for b in set(touched) - full:
        for name in ("grams", "uses"):
            removed(spark, f"{path}/{name}/bucket={b}")
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    return len(touched)


def search_index(names: DataFrame, path: str, k: int = 5) -> DataFrame:
    """search_trigram against a stored index: only folders of asked trigrams are read."""
    spark = names.sparkSession
    q = names.select(F.col("name").alias("query")).filter("length(query) >= 3").distinct()
    asked = q.select("query", F.explode(_grams(F.col("query"))).alias("gram")).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(INDEX_BUCKETS)).cast("int"))
    read = lambda name, kind, df: spark.read.schema(kind).parquet(f"{path}/{name}").filter(F.col("bucket").isin([r.bucket for r in df.select("bucket").distinct().collect()]))
    uses = read("uses", "gram string, uses long, bucket int", asked)
    rare = _met(asked, uses, ["bucket", "gram"], "left").groupBy("query").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "bucket", "gram")).alias("g"))
    rare = rare.filter("g.uses > 0").select("query", "g.bucket", "g.gram")
    kind = spark.read.parquet(f"{path}/entries").schema.add("gram", "string").add("bucket", "integer")
    hits = _met(rare, read("grams", kind, rare), ["bucket", "gram"]).filter("contains(name, query)")
    ranked = hits.withColumn("pos", F.row_number().over(W.partitionBy("query").orderBy("corp_number"))).filter(F.col("pos") <= k)
    return ranked.select("query", F.col("name").alias("official_name"), "corp_number", "pref", "pos")


def verify_local(names: DataFrame, registry: DataFrame | str, k: int = 5) -> DataFrame:
    """Among a name's first hits the exact one ('exact'), else the first ('partial'). registry: a table, or the path of a
    stored index."""
    hits = (search_index if isinstance(registry, str) else search_trigram)(names, registry, k)
    hits = hits.withColumn("confidence", F.when(F.col("official_name") == F.col("query"), "exact").otherwise("partial"))
    return first_per_key(hits, "query", ["confidence", "pos"]).drop("pos")


#: Digits of a phone that an index of a page's digits is asked for.
PHONE_KEY = 9


def _digit_hits(phones: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, host, page) where the page's digits, one after the other, hold the phone's. phones(id, host, d), pages(host, page,
    text). Each run of PHONE_KEY digits of a page is a key; a phone meets the pages of its host that have its last ones."""
    t = digits(F.col("text"))
    runs = F.when(F.length(t) >= PHONE_KEY, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - PHONE_KEY + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(PHONE_KEY)))))
    keys = spread(pages.select("host", "page", "text"), ["host", "page"]).select("host", "page", F.explode(runs).alias("key"))
    asked = phones.filter(F.length("d") >= PHONE_KEY).withColumn("key", F.right("d", F.lit(PHONE_KEY))).select("id", "host", "d", "key").distinct()
    met = _met(asked, keys, ["host", "key"]).select("id", "host", "d", "page")
    long = _met(met.filter(F.length("d") > PHONE_KEY), pages.select("host", "page", digits(F.col("text")).alias("_t")), ["host", "page"]).filter("contains(_t, d)")
    return met.filter(F.length("d") == PHONE_KEY).select("id", "host", "page").unionByName(long.select("id", "host", "page"))


def _name_hits(names: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, host, page) where the page's text holds the name. names(id, host, core), pages(host, page, text). A name meets
    the pages of its host that have its rarest piece of three characters there (of two or one, if it is shorter)."""
    out = []
    for n in (3, 2, 1):
        own = names.filter(F.length("core") >= 3 if n == 3 else F.length("core") == n)
        asked = own.select("id", "host", "core", F.explode(_grams(F.col("core"), n)).alias("gram"))
        there = _met(pages, own.select("host").distinct(), ["host"], "left_semi").select("host", "page", F.explode(_grams(F.col("text"), n)).alias("gram"))
        there = _met(there, asked.select("host", "gram").distinct(), ["host", "gram"], "left_semi")
        uses = there.groupBy("host", "gram").agg(F.count(F.lit(1)).alias("uses"))
        rare = _met(asked, uses, ["host", "gram"], "left").groupBy("id", "host", "core").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram")).alias("g"))
        met = _met(rare.filter("g.uses > 0").select("id", "host", "core", F.col("g.gram").alias("gram")), there, ["host", "gram"])
        out.append(_met(met, pages.select("host", "page", "text"), ["host", "page"]).filter("contains(text, core)").select("id", "host", "page"))
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def evidence(records: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page_kind, has_name, has_phone): the pages of a record's host that say its name's core or its phone, and one row
    with neither for each kind of page that the host has, if none of that kind says either. records(id, company_name,
    phone, base_url), pages(host, kind, text). Equal pages of a host count once; a record without a name has no name to
    be found. Records meet pages through indexes of digits and name pieces only."""
    own = records.select("id", host(F.col("base_url")).alias("host"), name_core(F.col("company_name")).alias("core"), digits(F.col("phone")).alias("d"))
    told = pages.select("host", F.col("kind").alias("page_kind"), F.col("text"), F.xxhash64("kind", "text").alias("page")).filter("host is not null")
    once = told.groupBy("host", "page").agg(F.first("page_kind").alias("page_kind"), F.first("text").alias("text"))
    hits = _name_hits(own.filter("core <> ''"), once).withColumn("n", F.lit(True)).withColumn("p", F.lit(False)).unionByName(_digit_hits(own, once).withColumn("n", F.lit(False)).withColumn("p", F.lit(True)))
    hits = _met(hits.groupBy("id", "host", "page").agg(F.max("n").alias("has_name"), F.max("p").alias("has_phone")), once.select("host", "page", "page_kind"), ["host", "page"]).select("id", "page_kind", "has_name", "has_phone")
    kinds = _met(own.select("id", "host"), told.select("host", "page_kind").distinct(), ["host"]).select("id", "page_kind").distinct()
    none = _met(kinds, hits.select("id", "page_kind").distinct(), ["id", "page_kind"], "left_anti").select("id", "page_kind", F.lit(False).alias("has_name"), F.lit(False).alias("has_phone"))
    return hits.unionByName(none)


#: Companies of one phone that a task compares with what a directory lists under it.
SHARE = 1000


def directory_mismatch(companies: DataFrame, directory: DataFrame) -> DataFrame:
    """Companies whose phone a directory lists under another name, with the directory's columns: neither core contains the
    other. directory(phone, listed, ...). Cores are worked out before rows meet; companies of a hot phone are dealt in shares
    of about SHARE, and its listings are repeated for each. What comes out is as many rows as there are such pairs."""
    n = int(companies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = spread(companies, companies.columns[0]).withColumn("_d", digits(F.col("phone"))).withColumn("_a", normalize_company(F.col("company_name")))
    listed = directory.select(digits(F.col("phone")).alias("_d"), *[c for c in directory.columns if c != "phone"], normalize_company(F.col("listed")).alias("_b"))
    hot = companies.groupBy(digits(F.col("phone")).alias("_d")).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_n")).filter("_n > 1")
    own = own.join(hot, "_d", "left").withColumn("_s", F.pmod(F.xxhash64(*companies.columns), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    listed = listed.join(hot, "_d", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    both = own.repartition(n, "_d", "_s").join(listed.repartition(n, "_d", "_s").hint("shuffle_hash"), ["_d", "_s"])
    return both.filter("not contains(_a, _b) and not contains(_b, _a)").drop("_d", "_s", "_a", "_b")


def phone_on_domain(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, found_in): paths of the company's host, or of its parent, whose page has the phone's digits."""
    own = companies.select("id", digits(F.col("phone")).alias("d"), F.explode(F.slice(host_suffixes(host(F.col("base_url"))), 1, 2)).alias("host"))
    hits = _digit_hits(own, pages.select("host", F.struct("path", F.xxhash64("text").alias("h")).alias("page"), "text"))
    return _met(companies.select("id"), hits.groupBy("id").agg(F.array_sort(F.collect_set("page.path")).alias("found_in")), ["id"], "left")


def phone_from_blocks(names: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, phone) of the first block of the query's results that has the name's core and a phone. names(id, query_id, name),
    blocks(query_id, pos, text)."""
    from leadmill.functions.text import extract_phone

    hits = names.join(blocks, "query_id").filter(F.contains("text", name_core(F.col("name")))).withColumn("phone", extract_phone(F.col("text"))).filter("phone is not null")
    return first_per_key(hits, "id", "pos").select("id", "phone")


def company_from_blocks(phones: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, name) of the first block that has the phone's digits and a labelled company."""
    from leadmill.operators.pages import company_from_text

    hits = phones.join(blocks, "query_id").filter(F.contains(digits(F.col("text")), digits(F.col("phone")))).withColumn("name", company_from_text(F.col("text"))).filter("name is not null")
    return first_per_key(hits, "id", "pos").select("id", "name")


def find_duplicates(new: DataFrame, existing: DataFrame, rule: str = "A") -> DataFrame:
    """Adds dup_by: the first key that a known company shares (url, phone, name), else null. Rule A lets a shared phone
    through. One semi join a key: an OR would compare all with all."""
    keys = {"A": ["base_url", "normalized_name"], "B": ["base_url", "phone", "normalized_name"]}[rule]
    out = new
    for k in keys:
        seen = existing.select(F.col(k).alias(f"_k_{k}")).filter(F.coalesce(F.col(f"_k_{k}"), F.lit("")) != "").distinct().withColumn(f"_by_{k}", F.lit(k))
        out = out.join(seen, out[k] == seen[f"_k_{k}"], "left").drop(f"_k_{k}")
    return out.withColumn("dup_by", F.coalesce(*[f"_by_{k}" for k in keys])).drop(*[f"_by_{k}" for k in keys])


def ledger_filter(new: DataFrame, ledger: DataFrame, account: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose phone no account has yet, the first of each phone, and the rows to append to the ledger."""
    known = ledger.select(digits(F.col("phone")).alias("_d")).distinct()
    fresh = new.withColumn("_d", digits(F.col("phone"))).join(known, "_d", "left_anti")
    fresh = first_per_key(fresh.filter("_d <> ''"), "_d", "id").unionByName(fresh.filter("_d = ''"))
    rows = fresh.filter("_d <> ''").select("phone", "company_name", F.lit(account).alias("account_id"), "ts")
    return fresh.drop("_d"), rows


def only_new(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return new.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def ttl_lookup(df: DataFrame, cache: DataFrame, hours: int, as_of) -> DataFrame:
    """Adds the cached value that is younger than so many hours."""
    young = cache.filter(F.col("cached_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
    return df.join(first_per_key(young, "base_url", F.desc("cached_at")).select("base_url", "tokutei_url"), "base_url", "left")


def competitors(companies: DataFrame, k: int = 3, match: str = "token") -> DataFrame:
    """(id, competitors): k other companies of the same first keyword token, those of the same area first, then the
    newest; distinct names. A hot token's companies are cut to the newest few of each area and of all before they are
    paired, which can't change the k nearest."""
    token = F.lower(F.get(F.split(F.trim(text(F.col("keyword"))), r"[\s　]+"), F.lit(0)))
    base = companies.withColumn("_token", token).filter("_token <> ''")
    if match == "contains":
        words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "keyword", F.array_join(F.coalesce("all_keywords", F.array().cast("array<string>")), " "))), r"[\s　/]+"), lambda x: x != ""))
        others = companies.withColumn("_token", F.explode(words))
    else:
        others = base
    others = first_per_key(others.select("_token", F.col("area_name").alias("_area"), F.col("company_name").alias("_name"), F.col("id").alias("_id")), ["_token", "_area", "_name"], F.desc("_id"))
    newest = lambda keys, n: others.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_id")))).filter(F.col("_r") <= n).drop("_r")
    # of one name or one's own row at most one falls out, so k + 1 distinct names of each tier are enough
    near = newest(["_token", "_area"], k + 1)
    distinct_far = first_per_key(others, ["_token", "_name"], F.desc("_id"))
    far = distinct_far.withColumn("_r", F.row_number().over(W.partitionBy("_token").orderBy(F.desc("_id")))).filter(F.col("_r") <= 2 * k + 2).drop("_r")
    own = base.select("id", "company_name", "area_name", "_token")
    a = own.join(near, (own["_token"] == near["_token"]) & own["area_name"].eqNullSafe(near["_area"])).select("id", "company_name", "_name", "_id", F.lit(0).alias("_tier"))
    b = own.join(far, "_token").select("id", "company_name", "_name", "_id", F.lit(1).alias("_tier"))
    # at most so many rows a company; tasks sort them, in shares of a bounded number
    pairs = dealt(a.unionByName(b).filter("_id <> id and _name <> company_name"), "id", companies.count() * (3 * k + 3))
    pairs = first_per_key(pairs, ["id", "_name"], ["_tier", F.desc("_id")])
    ranked = pairs.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("_tier", F.desc("_id")))).filter(F.col("_r") <= k)
    names = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_name"))), lambda x: x["_name"]).alias("competitors"))
    return companies.select("id").join(names, "id", "left").select("id", F.coalesce("competitors", F.array().cast("array<string>")).alias("competitors"))
