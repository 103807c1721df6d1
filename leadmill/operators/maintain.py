"""Batch maintenance and export: each makes a new snapshot from an old one and a table of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmill.functions.names import is_valid_company
from leadmill.functions.text import calc_rank, cut_unit, demote_rank, digits, garbage_name_reason, has_entity_word, is_freephone, is_garbage_phone, needs_reextract, normalize_company, phone_confidence, score_to_rank, text, to_halfwidth
from leadmill.operators.match import resolve_exact_or_core
from leadmill.operators.windows import first_per_key


def drop_junk(df: DataFrame, as_of, days: int) -> DataFrame:
    """Without rows older than so many days that have neither name nor phone."""
    junk = (text(F.col("company_name")) == "") & (text(F.col("phone")) == "") & (F.to_date("found_date") < F.date_sub(F.to_date(F.lit(as_of)), days))
    return df.filter(~F.coalesce(junk, F.lit(False)))


def exportable(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce("exported", F.lit(False)) & (text(F.col("corporate_number")) != ""))


def registry_gate(df: DataFrame) -> DataFrame:
    """Without rows that have no registry number though the lookup didn't fail."""
    return df.filter((text(F.col("corporate_number")) != "") | F.coalesce("lookup_error", F.lit(False)))


def only_entities(df: DataFrame) -> DataFrame:
    return df.filter(has_entity_word(F.col("company_name")))


def export_rows(df: DataFrame) -> DataFrame:
    """The sheet's 14 columns, six of them left to people."""
    own = {"found_date": F.date_format("found_date", "yyyy-MM-dd"), "company_name": to_halfwidth(F.col("company_name")), "phone": F.col("phone"), "lp_url": F.col("lp_url"), "industry": F.col("industry"), "keyword": F.col("keyword"), "rank": F.coalesce("rank", F.lit("C")), "corporate_number": F.col("corporate_number")}
    manual = ["assignee", "called_on", "result", "next_action", "memo", "status"]
    return df.select(*[text(c.cast("string")).alias(n) for n, c in own.items()], *[F.lit("").alias(n) for n in manual])


def export_full(df: DataFrame, path: str) -> None:
    """Rewrites the export: a header and all rows by id."""
    df.select("id", "company_name", "phone", "lp_url", "keyword", "rank").orderBy("id").write.mode("overwrite").csv(path, header=True)


def _sheet_key(name: str, phone: str):
    return F.concat_ws("|", to_halfwidth(text(F.col(name))), digits(F.col(phone)))


def reconcile_export(unexported: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows found on the sheet, with its first row index; rows to send again)."""
    there = sheet.groupBy(_sheet_key("company_name", "phone").alias("_k")).agg(F.min("row_index").alias("_row"))
    both = unexported.withColumn("_k", _sheet_key("company_name", "phone")).join(there, "_k", "left")
    found = both.filter("_row is not null").withColumn("exported", F.lit(True)).withColumn("sheet_row", F.col("_row").cast("int")).drop("_k", "_row")
    return found, both.filter("_row is null").drop("_k", "_row")


def propagate_rank(sheet: DataFrame, companies: DataFrame) -> DataFrame:
    """(row_index, rank) of sheet rows whose rank changes: by phone, by bare digits, else C."""
    raw = first_per_key(companies.filter("coalesce(phone, '') <> ''"), "phone", "id").select(F.col("phone").alias("_p"), F.col("rank").alias("_r1"))
    bare = first_per_key(companies.withColumn("_d", digits(F.col("phone"))).filter("_d <> ''"), "_d", "id").select("_d", F.col("rank").alias("_r2"))
    rows = sheet.withColumn("_key", digits(F.col("phone")))
    rows = rows.join(raw, F.col("phone") == F.col("_p"), "left").join(bare, F.col("_key") == F.col("_d"), "left")
    new = F.coalesce("_r1", "_r2", F.lit("C"))
    return rows.filter(~new.eqNullSafe(F.col("rank"))).select("row_index", new.alias("rank"))


def locate_rows(updates: DataFrame, sheet: DataFrame) -> DataFrame:
    """Adds row_index: of the registry number, else of the first row with the same normalised name."""
    number = sheet.filter("coalesce(corporate_number, '') <> ''").groupBy(F.col("corporate_number").alias("_n")).agg(F.min("row_index").alias("_r1"))
    name = sheet.withColumn("_name", normalize_company(F.col("company_name"))).filter("_name <> ''").groupBy("_name").agg(F.min("row_index").alias("_r2"))
    out = updates.join(number, F.col("corporate_number") == F.col("_n"), "left").join(name, F.col("normalized_name") == F.col("_name"), "left")
    return out.withColumn("row_index", F.coalesce("_r1", "_r2")).drop("_n", "_r1", "_name", "_r2")


def mark_exported(companies: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(id, sheet_row)."""
    m = rows.groupBy(F.col("id").alias("_i")).agg(F.min("sheet_row").alias("_row"))
    out = companies.join(m, F.col("id") == F.col("_i"), "left")
    return out.withColumn("exported", F.coalesce("exported", F.lit(False)) | F.col("_i").isNotNull()).withColumn("sheet_row", F.coalesce("_row", "sheet_row").cast("int")).select(companies.columns)


def merge_reextracted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with an action: UPDATE takes a valid new name or phone that differs, DELETE marks rows without a valid name
    before and after, KEEP is the rest. new(id, company_name, phone)."""
    n = new.select(F.col("id").alias("_i"), F.col("company_name").alias("_name"), F.col("phone").alias("_phone"))
    j = old.join(n, F.col("id") == F.col("_i"), "left")
    good = F.coalesce(is_valid_company(F.col("_name")), F.lit(False))
    differs = (good & ~F.col("_name").eqNullSafe(F.col("company_name"))) | (F.col("_phone").isNotNull() & ~F.col("_phone").eqNullSafe(F.col("phone")))
    bad = ~F.coalesce(is_valid_company(F.col("company_name")), F.lit(False)) & ~good
    j = j.withColumn("action", F.when(F.col("_i").isNotNull() & bad, "DELETE").when(F.col("_i").isNotNull() & differs, "UPDATE").otherwise("KEEP"))
    up = F.col("action") == "UPDATE"
    return j.withColumn("company_name", F.when(up & good, F.col("_name")).otherwise(F.col("company_name"))).withColumn("phone", F.when(up, F.coalesce("_phone", "phone")).otherwise(F.col("phone"))).drop("_i", "_name", "_phone")


def backfill_numbers(companies: DataFrame, lookups: DataFrame) -> DataFrame:
    """lookups(id, corp_number, error): a hit fills the number, hits and misses use up a try, errors don't."""
    up = first_per_key(lookups, "id", F.desc(F.col("corp_number").isNotNull())).select(F.col("id").alias("_i"), "corp_number", F.coalesce("error", F.lit(False)).alias("_error"))
    j = companies.join(up, F.col("id") == F.col("_i"), "left")
    tried = F.col("_i").isNotNull() & ~F.coalesce("_error", F.lit(False))
    number = F.when(text(F.col("corporate_number")) == "", F.coalesce("corp_number", "corporate_number")).otherwise(F.col("corporate_number"))
    return j.withColumn("nta_retry_count", (F.coalesce("nta_retry_count", F.lit(0)) + F.when(tried, 1).otherwise(0)).cast("int")).withColumn("corporate_number", number).select(companies.columns)


def backfill_prefecture(companies: DataFrame, registry: DataFrame, prefixes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Fills registered prefecture, fit and confidence by registry number, and demotes the rank that sightings give where
    the phone is of a distant place; running it again changes nothing."""
    from leadmill.operators.match import phone_prefecture, pref_match

    r = first_per_key(registry, "corp_number", "pref").select(F.col("corp_number").alias("_n"), F.col("pref").alias("_pref"))
    j = companies.join(r, F.col("corporate_number") == F.col("_n"), "left").withColumn("nta_prefecture", F.coalesce("_pref", "nta_prefecture")).drop("_n", "_pref")
    j = pref_match(phone_prefecture(j.drop("pref_match"), "phone", prefixes, "_phone_pref"), "nta_prefecture", "_phone_pref", adjacency)
    base = calc_rank(F.col("seen_count"), F.col("ad_sources"))
    j = j.withColumn("phone_confidence", phone_confidence(F.col("phone_source"), F.col("pref_match")).cast("int")).withColumn("rank", F.when(F.col("pref_match") == "mismatch", demote_rank(base)).otherwise(base))
    return j.select(companies.columns)


def replace_freephone(companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Free numbers give way to a fixed line that was found, on the page first, then in the directory. candidates(id,
    page_phone, directory_phone)."""
    c = candidates.groupBy(F.col("id").alias("_i")).agg(F.min("page_phone").alias("_a"), F.min("directory_phone").alias("_b"))
    j = companies.join(c, F.col("id") == F.col("_i"), "left")
    usable = lambda x: F.when(~is_freephone(F.col(x)), F.col(x))
    return j.withColumn("phone", F.when(is_freephone(F.col("phone")), F.coalesce(usable("_a"), usable("_b"), "phone")).otherwise(F.col("phone"))).select(companies.columns)


def drop_freephone(companies: DataFrame, export: DataFrame) -> DataFrame:
    """Without companies that have a free number, are exported with one, or share the name of one exported so."""
    free = export.filter(is_freephone(F.col("phone")))
    out = companies.filter(~is_freephone(F.col("phone")))
    out = out.join(free.select(digits(F.col("phone")).alias("_d")).distinct(), digits(F.col("phone")) == F.col("_d"), "left_anti")
    names = free.select(normalize_company(F.col("company_name")).alias("_n")).filter("_n <> ''").distinct()
    return out.join(names, F.col("normalized_name") == F.col("_n"), "left_anti")


def repair_names(companies: DataFrame, facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Names mended by pattern, else by what was extracted anew, else blank; then matched with the registry. facts(id,
    company_name)."""
    f = first_per_key(facts, "id", "company_name").select(F.col("id").alias("_i"), F.col("company_name").alias("_again"))
    j = companies.join(f, F.col("id") == F.col("_i"), "left").withColumn("_cut", cut_unit(F.col("company_name")))
    again = F.when(F.coalesce(is_valid_company(F.col("_again")), F.lit(False)), F.col("_again")).otherwise("")
    j = j.withColumn("name", F.when(~needs_reextract(F.col("_cut")), F.col("_cut")).otherwise(again)).drop("_i", "_again", "_cut")
    known = resolve_exact_or_core(j.select("name").filter("name <> ''").distinct(), registry).select(F.col("name").alias("_k"), "corp_number")
    out = j.join(known, F.col("name") == F.col("_k"), "left")
    return out.withColumn("company_name", F.col("name")).withColumn("corporate_number", F.coalesce("corporate_number", "corp_number")).select(companies.columns)


def rerank_by_evidence(companies: DataFrame, scores: DataFrame) -> DataFrame:
    s = scores.groupBy(F.col("id").alias("_i")).agg(F.sum("score").alias("_s"))
    return companies.join(s, F.col("id") == F.col("_i"), "left").withColumn("rank", F.when(F.col("_s").isNotNull(), score_to_rank(F.col("_s"))).otherwise(F.col("rank"))).select(companies.columns)


def rerank_by_sightings(companies: DataFrame) -> DataFrame:
    return companies.withColumn("rank", calc_rank(F.col("seen_count"), F.col("ad_sources")))


def janitor(companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with a reason)."""
    why = F.coalesce(garbage_name_reason(F.col("company_name")), F.when(is_garbage_phone(F.col("phone")), F.lit("phone")))
    marked = companies.withColumn("reason", why)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def ensure_columns(df: DataFrame, spec: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds missing columns with their default: {name: (type, default)}."""
    for name, (kind, default) in spec.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def relax_unique(df: DataFrame, keep_unique: list[str], order: str) -> DataFrame:
    """A rebuild under fewer unique keys: the first row of each stays."""
    for k in keep_unique:
        known = df.filter(F.col(k).isNotNull())
        df = first_per_key(known, k, order).unionByName(df.filter(F.col(k).isNull()))
    return df
