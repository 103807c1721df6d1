"""Further registered queries: sources and sinks, texts, pages, maintenance, alerts on tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadmill.functions import text as T
from leadmill.functions.charsets import encoded
from leadmill.operators import keywords as K, maintain as D, match as J, pages as H, windows as W
from leadmill.operators.scratch import shared_folder
from leadmill.plans.catalog import _FORMAT, _QUERIES5, AS_OF, COMPANIES, DIGITS, KEYWORDS, RECORDS, REGISTRY, SHEET, TABLE_PAGES, _company, query
from leadmill.sources import readers as S
from leadmill.streaming import alerts as R
from leadmill.streaming.flush import flush_groups


def _folder(spark, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


_BAD_PHONE = "length(d) = 8 OR regexp_matches(substr(d, 5), '^(0{6,}|1{6,}|2{6,}|3{6,}|4{6,}|5{6,}|6{6,}|7{6,})$')"
_CUSTOMERS = f"SELECT c_custkey AS id, c_name, {_company()} AS company, {DIGITS} AS d FROM {{customer}}"


# Sources and sinks


@query("s1_registry", "SELECT CAST(p_partkey AS VARCHAR) AS corp_number, p_name AS name, p_brand AS pref, p_type AS city FROM part WHERE p_partkey % 11 <> 0", part="part")
def _(spark, part):
    path = _folder(spark, "registry")
    values = {1: F.col("p_partkey").cast("string"), 6: F.col("p_name"), 11: F.col("p_brand"), 13: F.col("p_type"), 18: F.when(F.col("p_partkey") % 11 == 0, "2020-01-01").otherwise("")}
    part.select(*[values.get(i, F.lit("x")).alias(f"h{i}") for i in range(30)]).write.csv(path, header=True)
    return S.load_registry(spark, path)


@query("s2_leads", "SELECT lp_url, source, company_name AS meta_company, phone AS serp_phone FROM l", l=f"SELECT 'https://c' || CAST(c_custkey AS STRING) || '.example/' AS lp_url, c_mktsegment AS source, c_name AS company_name, {DIGITS} AS phone FROM {{customer}}")
def _(spark, leads):
    path = _folder(spark, "leads")
    leads.select("lp_url", "source", F.col("company_name").alias("meta_company"), F.col("phone").alias("serp_phone"), F.lit("2024-01-01T00:00:00").alias("ts")).write.json(path)
    return S.read_leads(spark, path).select("lp_url", "source", "meta_company", "serp_phone")


@query("s8_history", "SELECT CAST(date AS VARCHAR) AS timestamp, n FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1) ORDER BY 1 DESC LIMIT 5", events="events")
def _(spark, events):
    path = _folder(spark, "history")
    days = events.groupBy(F.to_date("ts").cast("string").alias("timestamp")).agg(F.count("*").alias("n"))
    S.append_history(days.filter("n % 2 = 0"), path)
    S.append_history(days.filter("n % 2 = 1"), path)
    return S.read_history(spark, path, 5, "timestamp string, n long")


@query("s10_seed_keywords", "SELECT DISTINCT 'google_yahoo' AS source, p_name AS keyword FROM part WHERE p_size < 25 UNION SELECT DISTINCT 'meta', p_type FROM part WHERE p_size < 25", part="part")
def _(spark, part):
    groups = part.groupBy(F.col("p_size").alias("industry")).agg(F.collect_set("p_name").alias("google_yahoo"), F.collect_set("p_type").alias("meta"))
    return K.seed_keywords(groups.withColumn("industry", F.col("industry").cast("string")), [str(i) for i in range(25)]).select("source", "keyword")


@query("s11_ensure_columns", "SELECT p_partkey, 'C' AS rank, CAST(NULL AS INT) AS sheet_row FROM part", part="part")
def _(spark, part):
    return D.ensure_columns(part.select("p_partkey"), {"rank": ("string", "C"), "sheet_row": ("int", None), "p_partkey": ("long", 0)})


@query("s14_export_full", "SELECT CAST(id AS VARCHAR) AS id, company_name, phone, lp_url, keyword, rank FROM comp", comp=COMPANIES)
def _(spark, comp):
    path = _folder(spark, "export")
    D.export_full(comp, path)
    return spark.read.schema("id string, company_name string, phone string, lp_url string, keyword string, rank string").csv(path, header=True)


#: Pages in ASCII with a line in Japanese of each page's own.
_JAPANESE = "regexp_replace(html, '[^\\x00-\\x7F]', ''{g}) || '会社名：株式会社' || translate(CAST(page_id AS STRING), '0123456789', '東京むカタの特定商取引') || '、ｶﾅ。'"
_CHARSET = "CASE page_id % {n} WHEN 0 THEN 'utf-8' WHEN 1 THEN 'shift_jis' WHEN 2 THEN 'euc-jp' ELSE 'iso-2022-jp' END"


@query("s15_charsets", "SELECT page_id, md5(html) AS digest FROM pages", pages="pages")
def _(spark, pages):
    raw = pages.select("page_id", F.encode("html", "UTF-8").alias("raw"))
    return S.decode_pages(raw, "raw").select("page_id", F.md5("html").alias("digest"))


@query("s15_unlabelled", f"SELECT page_id, {_CHARSET.format(n=3)} AS charset, md5({_JAPANESE.format(g=", 'g'")}) AS digest FROM pages", pages="pages")
def _(spark, pages):
    """Pages whose charset no header names, and their own text names wrongly if at all."""
    bare = pages.withColumn("said", F.expr(_JAPANESE.format(g="").replace("\\", "\\\\")))
    raw = encoded(bare.withColumn("as", F.expr(_CHARSET.format(n=3))), "said", "as", "raw").select("page_id", "raw")
    return S.decode_pages(raw, "raw").select("page_id", "charset", F.md5("html").alias("digest"))


#: State of a page in its scripts: JSON of its own, an object with escapes and bare keys, a parsed string.
_STATE = f"""CASE c_custkey % 4 WHEN 0 THEN '<script id="__NEXT_DATA__" type="application/json">‹"props":‹"list":[‹"x":1›,‹"company":‹"tel":"' || {DIGITS} || '","name":"' || {_company()} || '"››]››</script>'
 WHEN 1 THEN '<script>function f() ‹ return ‹a: 1›; › window.__STATE__ = ‹a: [1, 2,], /* shop */ shop: ‹"legal_name": "#u682a#u5f0f#u4f1a#u793e' || substr(c_name, 10) || '商事"››;</script>'
 WHEN 2 THEN '<script>var s = JSON.parse("‹#"shop#":‹#"corp_name#":#"' || {_company()} || '#"››");</script>' ELSE '<script>x = ‹"company": ‹"id": 7›, "name": "' || {_company()} || '"›</script>' END"""


@query("h8_state_names", f"SELECT c_custkey AS page_id, {_company()} AS company FROM customer WHERE c_custkey % 4 <> 3", pages=f"SELECT c_custkey AS page_id, replace(replace(replace({_STATE}, '#', chr(92)), '‹', chr(123)), '›', chr(125)) AS html FROM {{customer}}")
def _(spark, pages):
    """The fourth kind has a name that is no company's."""
    return H.spa_names(pages).filter("pos = 0").select("page_id", "company")


# Texts


@query("p24_scripts", "SELECT id, id % 5 IN (0, 1, 3) AS japanese, id % 5 IN (2, 4) AS english, id % 5 = 2 AS local FROM comp", comp=COMPANIES)
def _(spark, comp):
    c = F.col("company_name")
    return comp.select("id", T.is_japanese_company(c).alias("japanese"), T.is_english_only(c).alias("english"), T.needs_local_name(c).alias("local"))


@query("p14_p21_leaks", "SELECT id, id % 2 = 0 AS leak, id % 3 = 0 AS again FROM comp", comp=COMPANIES)
def _(spark, comp):
    leak = F.when(F.col("id") % 2 == 0, F.concat(F.lit("会社名："), "company_name")).otherwise(F.col("company_name"))
    again = F.when(F.col("id") % 6 == 0, F.concat("company_name", F.lit("・有限会社・株式会社"))).when(F.col("id") % 3 == 0, F.concat(F.lit("本社"), "company_name")).otherwise(F.col("company_name"))
    return comp.select("id", T.has_label_leak(leak).alias("leak"), T.needs_reextract(again).alias("again"))


@query("p20_page_state", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'captcha' WHEN 1 THEN 'empty' ELSE 'ok' END AS state FROM pages", pages="pages")
def _(spark, pages):
    html = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<p>unusual traffic</p>"))).when(F.col("page_id") % 3 == 2, F.col("html"))
    return pages.select("page_id", H.page_state(html).alias("state"))


@query("p11_p16_gates", "SELECT id, 'entity' AS gate FROM comp WHERE id % 5 <> 4 UNION ALL SELECT id, 'registry' FROM comp WHERE corporate_number <> '' OR id % 2 = 0", comp=COMPANIES)
def _(spark, comp):
    return D.only_entities(comp).select("id", F.lit("entity").alias("gate")).unionByName(D.registry_gate(comp.withColumn("lookup_error", F.col("id") % 2 == 0)).select("id", F.lit("registry").alias("gate")))


@query("f16_f23_spelling", "SELECT id, CASE id % 5 WHEN 0 THEN '株式会社' || c_name WHEN 1 THEN c_name || '株式会社' WHEN 2 THEN c_name || ' Inc.' WHEN 3 THEN '有限会社' || c_name ELSE c_name END AS expanded, '<' || c_name || '&A¥' AS plain, c_name AS bare, c_name || ' x-1' AS half FROM c", c=_CUSTOMERS)
def _(spark, c):
    short = F.when(F.col("id") % 5 == 0, F.concat(F.lit("㈱ "), "c_name")).when(F.col("id") % 5 == 1, F.concat("c_name", F.lit("(株)"))).when(F.col("id") % 5 == 2, F.concat("c_name", F.lit(" Inc."))).when(F.col("id") % 5 == 3, F.concat(F.lit("（有）"), "c_name")).otherwise(F.col("c_name"))
    form = F.element_at(F.array(*[F.lit(x) for x in (" Co., Ltd.", " Inc.", ", LLC", " Holdings", "")]), (F.col("id") % 5 + 1).cast("int"))
    return W.spread(c, "id").select("id", T.expand_abbreviations(short).alias("expanded"), T.unescape_entities(F.concat(F.lit("&lt;"), "c_name", F.lit("&#38;&#x41;&yen;&foo"))).alias("plain"), T.strip_english_form(F.concat("c_name", form)).alias("bare"), T.to_halfwidth(T.to_fullwidth(F.concat("c_name", F.lit(" x-1")))).alias("half"))


@query("f22_f28_cuts", "SELECT id, company_name AS unit, company_name AS light FROM comp", comp=COMPANIES)
def _(spark, comp):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("（仮称）", " - 採用情報", "ホームページ", " All Rights Reserved.", "所在地", "の求人情報", "代表者名山田")]), (F.col("id") % 7 + 1).cast("int"))
    unit = F.when(F.col("id") % 2 == 0, F.concat("company_name", F.lit(" 名古屋支店"))).otherwise(F.concat("company_name", F.lit(" 10周年記念")))
    return comp.select("id", T.cut_unit(unit).alias("unit"), T.strip_garbage(F.concat("company_name", tail)).alias("light"))


@query("f31_f34_spans", "SELECT id, CASE id % 3 WHEN 0 THEN '山田太郎' WHEN 1 THEN '鈴木一郎' END AS person, company AS spans, id % 4 < 2 AS address FROM c", c=_CUSTOMERS)
def _(spark, c):
    said = F.when(F.col("id") % 3 == 0, "院長：山田太郎").when(F.col("id") % 3 == 1, "鈴木一郎 理事長").otherwise("お知らせ")
    token = F.element_at(F.array(*[F.lit(x) for x in ("〒100-0001", "渋谷区1-1", "商事", "ABC")]), (F.col("id") % 4 + 1).cast("int"))
    spans = T.company_spans(F.concat(F.lit("当社、 "), "company", F.lit(" です")))
    return c.select("id", T.representative(said).alias("person"), F.array_join(spans, "+").alias("spans"), T.is_address_token(token).alias("address"))


@query("f8_all_phones", f"SELECT id, CASE WHEN {_BAD_PHONE} THEN '06-6666-1234' WHEN regexp_matches(d, '^0[789]0') OR left(d, 4) IN ('0120', '0800', '0570', '0990') THEN '06-6666-1234+' || {_FORMAT} ELSE CASE WHEN left(d, 2) IN ('03', '06') AND length(d) = 10 THEN {_FORMAT} || '+06-6666-1234' ELSE '06-6666-1234+' || {_FORMAT} END END AS phones FROM c", c=_CUSTOMERS)
def _(spark, c):
    return c.select("id", F.array_join(T.extract_phones(F.concat(F.lit("電話 "), "d", F.lit("\nTEL 06-6666-1234 FAX 03-9999-0000"))), "+").alias("phones"))


@query("f24_match_key", "SELECT id, lower(replace(c_name, ' ', '')) || 'ab' AS k FROM c", c=_CUSTOMERS)
def _(spark, c):
    return c.select("id", T.match_key(F.concat(T.to_fullwidth(F.col("c_name")), F.lit(" Ａ ｂ"))).alias("k"))


# Windows, picks and unions


@query("w3_best_match", "SELECT id, company_name AS name FROM comp", comp=COMPANIES)
def _(spark, comp):
    names = F.array(F.concat(F.lit("x"), "company_name"), F.lower("company_name"), F.col("company_name"), F.lit("株式会社"))
    return W.best_match(comp.select("id", F.col("company_name").alias("query"), F.posexplode(names).alias("pos", "name")), "id").select("id", "name")


@query("w6_trend", """, d AS (SELECT CAST(ts AS DATE) AS date, count(*) / 1000 AS v FROM events GROUP BY 1), x AS (SELECT max_by(v, date) AS newest, min_by(v, date) AS oldest FROM d), p AS (SELECT v AS previous FROM d ORDER BY date DESC LIMIT 1 OFFSET 1)
SELECT newest, oldest, previous, CASE WHEN newest - oldest > 0.01 THEN 'up' WHEN newest - oldest < -0.01 THEN 'down' ELSE 'flat' END AS trend FROM x, p""".replace(", d AS", "WITH d AS", 1), events="events")
def _(spark, events):
    days = events.groupBy(F.to_date("ts").alias("timestamp")).agg((F.count("*") / 1000).alias("seigoritsu"))
    return W.trend(days).select("newest", "oldest", "previous", "trend")


@query("w11_nearest_phone", "SELECT id, CASE id % 2 WHEN 0 THEN '03-5555-1111' ELSE '06-6666-1234' END AS phone FROM c", c=_CUSTOMERS)
def _(spark, c):
    far = "大阪市北区の梅田にある大きな建物の二階の受付と三階の事務所の番号はこちらです"
    body = F.when(F.col("id") % 2 == 0, F.concat(F.lit("03-5555-1111 "), "company", F.lit(f" {far} 06-6666-1234"))).otherwise(F.concat(F.lit(f"03-5555-1111 {far} "), "company", F.lit(" 06-6666-1234")))
    rows = c.select("id", body.alias("body"), "company", F.array(F.lit("03-5555-1111"), F.lit("06-6666-1234")).alias("phones"))
    return W.nearest_phone(rows, "body", "company", "phones").select("id", "phone")


@query("t5_least_recent", "SELECT keyword, row_number() OVER (ORDER BY last_searched NULLS FIRST, keyword) AS n FROM kw ORDER BY 2 LIMIT 40", kw=KEYWORDS)
def _(spark, kw):
    first = W.least_recent(kw, "last_searched")
    # the order as a column: of the first rows, ties by keyword
    top = first.orderBy(F.col("last_searched").asc_nulls_first(), "keyword").limit(40)
    return top.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("last_searched", F.lit("1900-01-01").cast("timestamp")).alias("t"), "keyword"))).alias("a")).select(F.posexplode("a").alias("i", "r")).select("r.keyword", (F.col("i") + 1).cast("long").alias("n"))


@query("t8_refill_all", "SELECT keyword FROM kw WHERE total_found >= 4 AND keyword NOT IN (SELECT keyword FROM kw WHERE total_found < 4)", kw=KEYWORDS)
def _(spark, kw):
    return K.refill(kw.filter("total_found < 4"), kw.select("keyword"), "meta", 1_000_000, 10_000_000, AS_OF, 5)


@query("u3_reserve_left", "SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS keyword FROM part WHERE p_partkey % 4 <> 1", reserve="SELECT p_name || ' ' || CAST(p_partkey AS STRING) AS keyword, p_partkey AS k FROM {part}")
def _(spark, reserve):
    return K.reserve_left(reserve.select("keyword"), reserve.filter("k % 4 = 1"))


@query("t9_retain_latest", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500", events="events")
def _(spark, events):
    return W.retain_latest(events, "event_id").select("event_id")


@query("u1_merge_sources", "SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_split_to_array(ad_sources, '[+,]'), ['Bing', 'Meta']))), '+') AS sources FROM comp", comp=COMPANIES)
def _(spark, comp):
    return comp.select("id", F.array_join(W.merge_sources(F.split("ad_sources", "[+,]"), F.array(F.lit("Bing"), F.lit("Meta"))), "+").alias("sources"))


@query("u2_ordered_union", "SELECT p_name AS k, arg_min(f, (f * 1000000000 + pos)) AS f FROM (SELECT p_name, 0 AS f, p_partkey AS pos FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_name, 1, p_partkey FROM part) GROUP BY 1", part="part")
def _(spark, part):
    side = lambda rows, f: rows.select(F.col("p_name").alias("k"), F.lit(f).alias("f"), F.col("p_partkey").alias("pos"))
    return W.ordered_union([side(part.filter("p_partkey % 3 = 0"), 0), side(part, 1)], "k").select("k", "f")


@query("k1_expand_all", "SELECT keyword || ' ' || c AS keyword, keyword AS base FROM kw, (VALUES ('東京'), ('大阪'), ('名古屋'), ('福岡'), ('横浜'), ('埼玉'), ('千葉'), ('神戸'), ('京都'), ('札幌'), ('仙台'), ('広島'), ('静岡'), ('新潟'), ('熊本')) t(c) WHERE total_found >= 3 AND source <> 'meta'", kw=KEYWORDS)
def _(spark, kw):
    return K.expand_keywords(kw, total=100_000_000)


# Pages


@query("h6_container_phones", f"SELECT id AS page_id, {_FORMAT} AS phone FROM c WHERE NOT ({_BAD_PHONE})", c=_CUSTOMERS, pages=TABLE_PAGES)
def _(spark, c, pages):
    return H.container_phones(H.blocks(pages)).select("page_id", "phone").distinct()


@query("h7_pairs", f"SELECT id AS page_id, company, {_FORMAT} AS phone FROM c WHERE NOT ({_BAD_PHONE})", c=_CUSTOMERS, pages=TABLE_PAGES)
def _(spark, c, pages):
    return H.container_pairs(H.blocks(pages))


@query("h10_phones", f"SELECT id AS page_id, CASE WHEN id % 2 = 0 THEN 0 ELSE 11 END AS tier, {_FORMAT} AS phone FROM c WHERE NOT ({_BAD_PHONE})", c=_CUSTOMERS, pages=TABLE_PAGES)
def _(spark, c, pages):
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="tel:'), F.regexp_extract("html", r"<td>(\d+)</td>", 1), F.lit('">tel</a></body>'))).otherwise("</body>")
    linked = pages.withColumn("html", F.replace("html", F.lit("</body>"), link))
    valid = H.page_phones(linked).filter(T.is_valid_phone(F.col("phone")))
    return valid.select("page_id", "tier", "phone")


@query("h17_assemble", "SELECT id AS lead_id, CASE WHEN id % 2 = 0 THEN company ELSE company || '店' END AS name, '03-5555-1234' AS phone, '03-5555-1234+06-6666-1234' AS phones, 'landing' AS source, CASE WHEN id % 2 = 0 THEN 'n' || CAST(id AS VARCHAR) END AS corp_number FROM c", c=_CUSTOMERS)
def _(spark, c):
    row = lambda kind, company, phone, n: c.select(F.col("id").alias("lead_id"), F.lit(kind).alias("kind"), company.cast("string").alias("company"), F.lit(phone).cast("string").alias("phone"), F.lit(n).alias("ord"))
    facts = row("legal", F.when(F.col("id") % 2 == 0, F.col("company")), None, 0).unionByName(row("landing", F.concat("company", F.lit("店")), "03-5555-1234", 1)).unionByName(row("contact", F.lit(None), "06-6666-1234", 2))
    registry = c.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("corp_number"), F.col("company").alias("name"), F.lit("東京都").alias("pref"))
    out = H.assemble_companies(c.select(F.col("id").alias("lead_id"), F.col("c_name").alias("meta_company")), facts, registry)
    return out.withColumn("phones", F.array_join("phones", "+"))


@query("h20_company_in_text", "SELECT id, company FROM c", c=_CUSTOMERS)
def _(spark, c):
    said = F.when(F.col("id") % 3 == 0, F.concat(F.lit("お知らせ\n会社名："), "company", F.lit("\n住所"))).when(F.col("id") % 3 == 1, F.concat(F.lit("販売業者\n"), "company", F.lit("\n"))).otherwise(F.concat(F.lit("Copyright 2024 "), "company", F.lit(" All Rights Reserved.")))
    return c.select("id", H.company_from_text(said).alias("company"))


# Maintenance


@query("d8_mark_exported", "SELECT id, exported OR id % 3 = 0 AS exported, CASE WHEN id % 3 = 0 THEN CAST(id * 2 AS INT) END AS sheet_row FROM comp", comp=COMPANIES)
def _(spark, comp):
    rows = comp.filter("id % 3 = 0").select("id", (F.col("id") * 2).cast("int").alias("sheet_row"))
    return D.mark_exported(comp.withColumn("sheet_row", F.lit(None).cast("int")), rows.unionByName(rows)).select("id", "exported", "sheet_row")


@query("d18_repair_names", "SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN company ELSE '' END ELSE company_name END AS company_name, CASE WHEN id % 4 <> 0 THEN 'r' || CAST(id AS VARCHAR) END AS corporate_number FROM comp JOIN c USING (id)", comp=COMPANIES, c=_CUSTOMERS)
def _(spark, comp, c):
    broken = comp.withColumns({"company_name": F.when(F.col("id") % 4 == 0, F.concat(F.lit("販売業者名"), "company_name")).otherwise(F.concat("company_name", F.lit(" 大阪支店"))), "corporate_number": F.lit(None).cast("string")})
    facts = c.filter("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.col("company")).otherwise("x").alias("company_name"))
    registry = comp.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("corp_number"), F.col("company_name").alias("name"), F.lit("東京都").alias("pref"))
    return D.repair_names(broken, facts, registry).select("id", "company_name", "corporate_number")


@query("d17_exported_freephone", "SELECT id FROM comp WHERE left(phone, 4) NOT IN ('0120', '0800', '0570', '0990') AND id % 10 <> 3", comp=COMPANIES)
def _(spark, comp):
    export = comp.filter("id % 10 = 3").select("company_name", F.lit("0120-111-222").alias("phone"))
    return D.drop_freephone(comp, export).select("id")


@query("j11_locate_by_name", "SELECT c.id, s.row_index FROM comp c LEFT JOIN sheet s ON s.row_index = c.id", comp=COMPANIES, sheet=SHEET)
def _(spark, comp, sheet):
    named = comp.withColumns({"corporate_number": F.lit(None).cast("string"), "normalized_name": T.normalize_company(F.col("company_name"))})
    return D.locate_rows(named, sheet).select("id", "row_index")


# Alerts on tables


_ALERTS = "SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, event_type AS problem, value, user_id FROM {events}"


@query("r6_suppress", "SELECT id FROM a WHERE id % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM a r WHERE r.id % 7 = 0 AND r.problem = a.problem AND r.ts <= a.ts AND a.ts < r.ts + CASE WHEN r.id % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 5 HOUR END)", a=_ALERTS)
def _(spark, a):
    repairs = a.filter("id % 7 = 0").select("ts", "problem", F.when(F.col("id") % 2 == 1, 5.0).alias("hours"))
    alerts = a.filter("id % 7 <> 0").select("ts", F.col("id").cast("string").alias("source"), "problem", F.lit("warning").alias("severity"), "value")
    return R.suppress(alerts, repairs).select(F.col("source").cast("long").alias("id"))


@query("r9_silence", """, g AS (SELECT user_id AS source, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, (SELECT max(ts) FROM a) AS last FROM a)
SELECT CAST(source AS VARCHAR) AS source, CAST(ts + INTERVAL 21600 SECOND AS VARCHAR) AS ts FROM g WHERE coalesce(nxt, last) - ts > INTERVAL 21600 SECOND OR (nxt IS NULL AND last - ts = INTERVAL 21600 SECOND)""", a=_ALERTS)
def _(spark, a):
    return R.silence_alerts(a.select("ts", F.col("user_id").cast("string").alias("source")), 21600).select("source", F.col("ts").cast("string").alias("ts"))


@query("r8_flush_groups", "SELECT id, CAST(ceil(row_number() OVER (PARTITION BY area_name ORDER BY id) / 50.0) AS BIGINT) AS flush FROM comp", comp=COMPANIES)
def _(spark, comp):
    """Rows of a sheet go out fifty at a time."""
    return flush_groups(comp, "area_name", ["id"]).select("id", "flush")


@query("j5_stored_index", "SELECT query, corp_number, pos FROM (SELECT q.name AS query, corp_number, row_number() OVER (PARTITION BY q.name ORDER BY corp_number) AS pos FROM q JOIN reg ON contains(reg.name, q.name)) WHERE pos <= 5", q=_QUERIES5, reg=REGISTRY)
def _(spark, q, reg):
    """The index of a registry without its newest companies is brought up to date and searched."""
    path = _folder(spark, "index")
    J.refresh_index(reg.filter(F.col("corp_number").substr(-1, 1) != "7"), path)
    J.refresh_index(reg, path)
    return J.search_index(q, path).select("query", "corp_number", "pos")
