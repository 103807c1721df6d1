"""Sources and sinks: registry files, lead events, ad payloads, logs, histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadmill.functions.charsets import with_html
from leadmill.functions.text import has, text
from leadmill.functions.urls import host, is_http, unwrap_tracker
from leadmill.operators.scratch import scope
from leadmill.operators.variants import levels
from leadmill.operators.windows import dealt, first_per_key

LEAD = "lp_url STRING, source STRING, keyword STRING, meta_company STRING, area_name STRING, serp_phone STRING, ts TIMESTAMP"
#: Columns of a registry row that are read: number, name, prefecture, city, close date.
REGISTRY_COLUMNS = (1, 6, 11, 13, 18)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """(corp_number, name, pref, city) of open companies from headed CSV files; the first row of a number in file order."""
    schema = ", ".join(f"c{i} STRING" for i in range(30))
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE")
    n, name, pref, city, closed = (F.trim(text(F.col(f"c{i}"))) for i in REGISTRY_COLUMNS)
    rows = raw.select(n.alias("corp_number"), name.alias("name"), pref.alias("pref"), city.alias("city"), closed.alias("_closed"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.filter("corp_number <> '' and name <> '' and _closed = ''")
    return first_per_key(rows, "corp_number", ["_file", "_block", "_row"]).select("corp_number", "name", "pref", "city")


def read_leads(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Lead events from JSON files, as a table or a stream. files_per_batch: at most so many files in one batch of the stream,
    where collectors write files of a bounded number of rows (50 are one flush)."""
    if not streaming:
        return spark.read.schema(LEAD).json(path)
    reader = spark.readStream.schema(LEAD)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def ads_from_archive(df: DataFrame, blocked: list[str]) -> DataFrame:
    """(keyword, url, company, pos) from archive payloads df(keyword, body): link URLs of each ad with its page's name; web
    addresses only, not of blocked hosts."""
    kind = "struct<data: array<struct<page_name: string, ad_creative_link_urls: array<string>>>>"
    ads = df.select("keyword", F.explode(F.from_json("body", kind)["data"]).alias("ad"))
    each = ads.select("keyword", F.posexplode("ad.ad_creative_link_urls").alias("pos", "url"), F.col("ad.page_name").alias("company"))
    bad = "|".join("\\Q" + b + "\\E" for b in blocked) or "(?!)"
    return each.filter(is_http(F.col("url")) & ~has(host(F.col("url")), bad)).select("keyword", "url", "company", "pos")


def ads_from_serp(df: DataFrame, own_host: str) -> DataFrame:
    """(keyword, url, company, pos) from result payloads df(keyword, body): the first ad list that isn't empty, of each ad
    the first usable address, not of the searched site itself, each once."""
    lists = F.coalesce(*[F.expr(f"CASE WHEN size(try_cast(try_variant_get(v, '$.{k}') AS array<variant>)) > 0 THEN try_cast(try_variant_get(v, '$.{k}') AS array<variant>) END") for k in ("ads", "paidResults", "searchAds", "sponsored")])
    ads = df.withColumn("v", F.try_parse_json("body")).select("keyword", lists.alias("ads")).select("keyword", F.posexplode("ads").alias("pos", "v"))
    urls = F.array(*[F.expr(f"try_variant_get(v, '$.{k}', 'string')") for k in ("link", "url", "trackedLink", "displayLink", "domain")])
    full = F.transform(F.filter(urls, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.when(is_http(x), F.coalesce(unwrap_tracker(x, own_host), x)).otherwise(F.concat(F.lit("https://"), x)))
    each = ads.select("keyword", "pos", F.get(F.filter(full, lambda x: ~F.contains(x, F.lit(own_host))), F.lit(0)).alias("url"), F.expr("try_variant_get(v, '$.title', 'string')").alias("company")).filter("url is not null")
    return first_per_key(each, ["keyword", "url"], "pos").select("keyword", "url", "company", "pos")


def ads_from_nested(df: DataFrame, url_keys: list[str], company_keys: list[str]) -> DataFrame:
    """(keyword, url, company, pos) from payloads df(keyword, body): objects at any level that have a web address under one of
    the keys, each address once; pos is its level. The company is the first one at or below the nearest object around the
    address (itself included) that has one and whose first address is this one. Within an object keys come in order of
    their names, an object's own before those below it."""
    pick = lambda keys: F.coalesce(*[F.expr(f"nullif(trim(try_variant_get(v, '$.{k}', 'string')), '')") for k in keys])
    with scope(df.sparkSession) as keep:
        values = df.select("keyword", F.xxhash64("keyword", "body").alias("doc"), F.try_parse_json("body").alias("v"))
        parts = [level.select("keyword", "doc", "path", pick(url_keys).alias("url"), pick(company_keys).alias("company")).filter("url is not null or company is not null") for level in levels(values, ["keyword", "doc"])]
        own = keep(reduce(DataFrame.unionByName, parts), "nested")
    # an element stands under each object around it; tasks sort these rows, in shares of a bounded number
    rows = own.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    own = dealt(own, "doc", rows)
    around = own.withColumn("above", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("path")))
    around = around.groupBy("doc", "above").agg(first("url").alias("_url"), first("company").alias("company"))
    ads = own.filter("url like 'http%'").select("keyword", "doc", "path", "url").distinct()
    above = ads.withColumn("above", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))))
    near = above.join(around, ["doc", "above"]).filter("_url = url and company is not null").groupBy("doc", "path").agg(F.max_by("company", F.size("above")).alias("company"))
    each = ads.join(near, ["doc", "path"], "left").withColumn("pos", F.size("path"))
    return first_per_key(each, ["keyword", "url"], ["pos", "path"]).select("keyword", "url", "company", "pos")


def ad_links_from_html(pages: DataFrame, mark: str = "/aclk", own: str = "(?!)") -> DataFrame:
    """(page_id, url, pos): landing pages behind tracking links of stored result pages, in order, each once."""
    links = F.regexp_extract_all(text(F.col("html")), F.lit(rf"href=[\"']([^\"']*{mark}[^\"']*)[\"']"), F.lit(1))
    each = pages.select("page_id", F.posexplode(links).alias("pos", "href")).withColumn("url", unwrap_tracker(F.replace(F.col("href"), F.lit("&amp;"), F.lit("&")), own)).filter("url is not null")
    return first_per_key(each, ["page_id", "url"], "pos").select("page_id", "url", "pos")


def parse_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """(ts, source, n, captcha, browser_fail, is_error) of log lines; lines without a time are left out."""
    v = F.col(column)
    n = F.regexp_extract(v, r"(\d+)\s*(?:件|URLs?|results?)", 1)
    out = df.select(
        F.try_to_timestamp(F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), F.lower(F.regexp_extract(v, r"\[(\w+)\]", 1)).alias("source"),
        F.coalesce(F.try_to_number(n, F.lit("999999999")).cast("int"), F.lit(0)).alias("n"), has(v, "(?i)captcha").alias("captcha"), has(v, "(?i)browser.*(?:fail|error|crash)|ブラウザ.*失敗").alias("browser_fail"), has(v, r"\bERROR\b|エラー").alias("is_error"),
    )
    return out.filter("ts is not null")


def read_history(spark: SparkSession, path: str, n: int | None = None, schema: str | None = None, order: str = "timestamp") -> DataFrame:
    """JSON lines, bad ones left out, newest first."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    out = (reader.schema(schema) if schema else reader).json(path).orderBy(F.desc(order))
    return out.limit(n) if n else out


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def decode_pages(df: DataFrame, raw: str, header_charset: str | None = None) -> DataFrame:
    """Adds html, decoded from bytes, and charset, the one that they were read in: the header's if the bytes are well-formed
    in it, else the one that they are well-formed in (`charsets.charset_of`), then the page's own. Malformed bytes become
    U+FFFD. A page that is well-formed in two charsets is read in the likelier one, not in the first that was tried."""
    return with_html(df, raw, header_charset, "html", "charset")
