"""The lead stream: each batch is filtered, matched with what is known, deduplicated, enriched and written.

State lies in folders by batch number, dealt into buckets: `companies/<batch>` holds the companies that the batch changed or
added, by buckets of their ids; `keys/<batch>` the names, addresses and phones of those it added, by buckets of their
hashes; `last/<batch>` the highest id so far. A batch looks its own keys up in their buckets, and the companies behind them
in theirs, so what it reads grows with the keys that it meets, not with all companies. Each COMPACT-th batch writes all of
them anew, and folders before that are removed once a later batch runs. A batch that runs again after a failure replaces
its own folders and reads only those before it. Rows arrive in order of time and source, then of a hash of the row,
whatever the order of files and tasks. What a batch writes on the way is removed at its end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from leadmill.functions.text import calc_rank, normalize_company, normalize_phone, phone_confidence
from leadmill.functions.urls import is_article_url, is_http, is_test_url
from leadmill.operators.dedupe import apply_sightings, insert_or_ignore
from leadmill.operators.maintain import locate_rows
from leadmill.operators.scratch import removed, scope, written
from leadmill.operators.match import base_domain, drop_hosts, find_duplicates

#: Each so many batches all companies are written.
COMPACT = 50
#: Folders that companies and keys of a batch are dealt into.
BUCKETS = 64
KEY = "id LONG, kind STRING, value STRING"
COMPANY = "id LONG, company_name STRING, normalized_name STRING, lp_url STRING, base_url STRING, phone STRING, phone_source STRING, ad_sources ARRAY<STRING>, keyword STRING, found_at TIMESTAMP, seen_count INT, rank STRING, phone_confidence INT, corporate_number STRING"


def usable_leads(leads: DataFrame, not_landing: DataFrame, blocked: DataFrame) -> DataFrame:
    """Leads whose address can be a landing page; cheap tests come before any page is looked at."""
    ok = is_http(F.col("lp_url")) & ~is_test_url(F.col("lp_url")) & ~is_article_url(F.col("lp_url"))
    return drop_hosts(drop_hosts(leads.filter(ok), "lp_url", not_landing), "lp_url", blocked)


def candidates(leads: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Usable leads with company, phone and keys. dims: not_landing(host), blocked(host), suffixes(suffix), facts(lp_url,
    company_name, phone, phone_source, corporate_number)."""
    own = base_domain(usable_leads(leads, dims["not_landing"], dims["blocked"]), "lp_url", dims["suffixes"], "base_url")
    own = own.join(dims["facts"], "lp_url", "left")
    rows = own.withColumns({"company_name": F.coalesce("company_name", "meta_company"), "phone": normalize_phone(F.coalesce("phone", "serp_phone"))})
    return rows.withColumn("normalized_name", normalize_company(F.col("company_name"))).filter("normalized_name <> '' and phone <> ''")


def process_batch(rows: DataFrame, companies: DataFrame, last: int) -> tuple[DataFrame, DataFrame]:
    """(companies that the candidates changed or added, rank changes). companies: those that share a key with a candidate at
    least; last: the highest id of all."""
    marked = find_duplicates(rows, companies, "A")
    seen, changes = apply_sightings(companies, marked.filter("dup_by is not null"), changed_only=True)
    fresh = marked.filter("dup_by is null").withColumn("_hash", F.xxhash64("lp_url", "source", "keyword", "company_name", "phone", "ts"))
    # sorted by ranges, so numbers grow along the order of arrival; written once, as they are told apart by them from here on
    new = fresh.orderBy("ts", "source", "_hash").withColumn("id", F.lit(last + 1) + F.monotonically_increasing_id()).withColumn("ad_sources", F.array("source")).withColumn("seen_count", F.lit(1))
    new = new.withColumn("rank", calc_rank(F.col("seen_count"), F.col("ad_sources"))).withColumn("phone_confidence", phone_confidence(F.col("phone_source"), F.lit("unknown")).cast("int")).withColumn("found_at", F.col("ts"))
    new = written(new.select(companies.columns), "leads")
    accepted, _ = insert_or_ignore(new, companies, ["normalized_name", "base_url"], "id")
    return seen.unionByName(accepted), changes


def _keys(rows: DataFrame, *also: str) -> DataFrame:
    """(kind, value, bucket) of each key of the rows."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("normalized_name", "base_url", "phone")])
    keys = rows.select(*also, F.explode(each).alias("k")).filter("k.value <> ''").select(*also, "k.kind", "k.value")
    return keys.withColumn("bucket", _bucket("value"))


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _generation(number: int) -> int:
    """The first batch whose folders a batch reads: the last one before it that wrote all companies."""
    return max(0, number // COMPACT * COMPACT - 1)


def _stored(spark, out: str, table: str, schema: str, number: int, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a table that the batches before a number left, with `_batch`; of some buckets alone, if they are given."""
    parts = [spark.read.schema(f"{schema}, bucket INT").parquet(f"{out}/{table}/{k}").withColumn("_batch", F.lit(k)) for k in range(_generation(number), number)]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, bucket INT, _batch INT")
    return rows.filter(F.col("bucket").isin(buckets)) if buckets is not None else rows


def _latest(rows: DataFrame) -> DataFrame:
    own = [c for c in rows.columns if c not in ("_batch", "bucket")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*own), "_batch").alias("r")).select("r.*")


def known_companies(spark, out: str, number: int) -> DataFrame:
    """All companies before a batch."""
    return _latest(_stored(spark, out, "companies", COMPANY, number))


def companies_met(rows: DataFrame, out: str, number: int) -> DataFrame:
    """The companies before a batch that share a key with one of its rows."""
    spark = rows.sparkSession
    asked = written(_keys(rows).distinct(), "asked")
    some = lambda df: [r.bucket for r in df.select("bucket").distinct().collect()]  # noqa: E731  BUCKETS at most
    ids = _stored(spark, out, "keys", KEY, number, some(asked)).join(asked, ["kind", "value", "bucket"], "left_semi").select("id").distinct()
    ids = written(ids.withColumn("bucket", _bucket("id")), "met")
    return _latest(_stored(spark, out, "companies", COMPANY, number, some(ids)).join(ids, ["id", "bucket"], "left_semi"))


def write_batch(leads: DataFrame, number: int, dims: dict[str, DataFrame], out: str, sheet: DataFrame | None = None) -> None:
    """Works off one batch and writes its folders."""
    spark = leads.sparkSession
    put = lambda df, table: df.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/{table}/{number}")
    with scope(spark):
        rows = written(candidates(leads, dims), "candidates")
        last = _last(spark, out, number)
        after, changes = process_batch(rows, written(companies_met(rows, out, number), "known"), last)
        after = written(after, "after")
        whole = number % COMPACT == COMPACT - 1
        if whole:
            after = known_companies(spark, out, number).join(after.select("id"), "id", "left_anti").unionByName(after)
        put(_keys(after if whole else after.filter(F.col("id") > last), "id"), "keys")
        put(after.withColumn("bucket", _bucket("id")), "companies")
        top = max(last, after.agg(F.max("id")).first()[0] or 0)
        spark.createDataFrame([(top,)], "id long").coalesce(1).write.mode("overwrite").parquet(f"{out}/last/{number}")
        told = locate_rows(changes.withColumn("corporate_number", F.lit(None).cast("string")), sheet) if sheet is not None else changes
        told.write.mode("overwrite").parquet(f"{out}/rank_changes/{number}")
    for k in range(_generation(_generation(number)), _generation(number)):  # of the generation before; later batches don't read it
        for table in ("companies", "keys", "last"):
            removed(spark, f"{out}/{table}/{k}")


def _last(spark, out: str, number: int) -> int:
    return spark.read.schema("id long").parquet(f"{out}/last/{number - 1}").first()[0] if number else 0


def run_lead_stream(leads: DataFrame, dims: dict[str, DataFrame], out: str, trigger: str = "300 seconds", once: bool = False, sheet: DataFrame | None = None):
    """Starts the stream: companies and rank changes of each batch under out. once: works off what is there and ends."""
    writer = leads.writeStream.foreachBatch(lambda df, number: write_batch(df, number, dims, out, sheet)).option("checkpointLocation", f"{out}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()
