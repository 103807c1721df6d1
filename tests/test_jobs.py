"""Joins, jobs, sources and maintenance by example."""

from datetime import date, datetime

from pyspark.sql import functions as F

from leadmill.operators import dedupe, keywords as K, maintain as D, match as J, pages as H, quality as Q, windows as W
from leadmill.sources import readers as S
from leadmill.streaming import leads as L

AS_OF = "2024-01-20 12:00:00"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_registry(spark, tmp_path):
    head = ",".join(f"h{i}" for i in range(30))
    line = lambda n, name, closed="": ",".join(["x", n, "x", "x", "x", "x", name, "x", "x", "x", "x", "東京都", "x", "千代田区", "x", "x", "x", "x", closed, *["x"] * 11])
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text("\n".join([head, line("1", "A社"), line("2", "B社", "2020-01-01"), line("", "C社"), line("1", "D社"), line("3", "E社")]))
    got = sorted((r.corp_number, r["name"], r.pref, r.city) for r in S.load_registry(spark, f"{tmp_path}/r").collect())
    assert got == [("1", "A社", "東京都", "千代田区"), ("3", "E社", "東京都", "千代田区")]


def test_payloads(spark):
    serp = rows(spark, [("k", '{"ads":[],"paidResults":[{"link":"https://own.example/x","url":"https://a.example/"},{"domain":"b.example"},{"link":"https://a.example/"}]}'), ("bad", "{")], "keyword string, body string")
    assert sorted(r.url for r in S.ads_from_serp(serp, "own.example").collect()) == ["https://a.example/", "https://b.example"]
    html = rows(spark, [(1, '<a href="/aclk?sa=1&amp;adurl=https%3A%2F%2Fa.example%2F">x</a><a href="/aclk?adurl=https%3A%2F%2Fa.example%2F">y</a>', )], "page_id long, html string")
    assert [(r.url, r.pos) for r in S.ad_links_from_html(html).collect()] == [("https://a.example/", 0)]
    logs = rows(spark, [("2024-01-20 10:00:00 [Yahoo] found 12件",), ("2024-01-20 10:01:00 [Google] CAPTCHA ERROR",), ("no time",)], "value string")
    assert [(r.source, r.n, r.captcha, r.is_error) for r in S.parse_logs(logs).orderBy("ts").collect()] == [("yahoo", 12, False, False), ("google", 0, True, True)]


def test_history(spark, tmp_path):
    S.append_history(rows(spark, [("2024-01-01", 0.5), ("2024-01-02", 0.7), ("2024-01-03", 0.6)], "timestamp string, seigoritsu double"), f"{tmp_path}/h")
    h = S.read_history(spark, f"{tmp_path}/h", schema="timestamp string, seigoritsu double")
    t = W.trend(h).first()
    assert (t.newest, t.oldest, t.previous, t.trend) == (0.6, 0.5, 0.7, "up")
    assert S.read_history(spark, f"{tmp_path}/h", 1, "timestamp string, seigoritsu double").count() == 1


def test_charsets(spark):
    old = spark.conf.get("spark.sql.legacy.javaCharsets")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        data = [(1, bytearray("日本".encode()), None), (2, bytearray("日本".encode("shift_jis")), "Shift_JIS"), (3, bytearray(b"<meta charset=euc-jp>" + "日本".encode("euc-jp")), None)]
        got = [r.html[-2:] for r in S.decode_pages(rows(spark, data, "i int, raw binary, cs string"), "raw", "cs").orderBy("i").collect()]
        assert got == ["日本"] * 3
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", old)


def test_evidence_and_verdicts(spark):
    rec = rows(spark, [(1, "株式会社田中", "03-5555-1234", "https://a.example/"), (2, "株式会社鈴木", "03-5555-9999", "https://b.example/"), (3, "株式会社佐藤", "03-5555-8888", "https://c.example/")], "id long, company_name string, phone string, base_url string")
    pages = rows(spark, [("a.example", "tokutei", "販売業者 株式会社田中 TEL 03-5555-1234", "/law"), ("b.example", "tokutei", "販売業者 鈴木 TEL 03-0000", "/law"), ("c.example", "base", "電話 0355558888", "/")], "host string, kind string, text string, path string")
    e = J.evidence(rec, pages)
    assert sorted((r.id, r.has_name, r.has_phone) for r in e.collect()) == [(1, True, True), (2, True, False), (3, False, True)]
    v = {r.id: r.result for r in Q.verdicts(e.withColumn("order", F.lit(0))).collect()}
    assert v == {1: "tokutei_ok", 2: "phone_mismatch", 3: "base_ok"}
    found = {r.id: r.found_in for r in J.phone_on_domain(rec, pages).collect()}
    assert found == {1: ["/law"], 2: None, 3: ["/"]}


def test_blocks_joins(spark):
    blocks = rows(spark, [(1, 0, "何か 03-1111-2222"), (1, 1, "会社名：株式会社田中 電話 03-5555-1234")], "query_id int, pos int, text string")
    names = rows(spark, [(7, 1, "株式会社田中")], "id int, query_id int, name string")
    assert [(r.id, r.phone) for r in J.phone_from_blocks(names, blocks).collect()] == [(7, "03-5555-1234")]
    b2 = rows(spark, [(1, 0, "会社名：株式会社鈴木\n電話 03-5555-1234")], "query_id int, pos int, text string")
    assert [(r.id, r["name"]) for r in J.company_from_blocks(rows(spark, [(8, 1, "03-5555-1234")], "id int, query_id int, phone string"), b2).collect()] == [(8, "株式会社鈴木")]


def test_ttl(spark):
    cache = rows(spark, [("a", "t1", datetime(2024, 1, 20)), ("b", "t2", datetime(2024, 1, 1))], "base_url string, tokutei_url string, cached_at timestamp")
    assert {r.base_url: r.tokutei_url for r in J.ttl_lookup(rows(spark, [("a",), ("b",)], "base_url string"), cache, 72, AS_OF).collect()} == {"a": "t1", "b": None}


def test_windows(spark):
    c = rows(spark, [(1, "株式会社Ab", "株式会社ab", 0), (1, "株式会社Ab", "株式会社Ab", 1), (2, "x", "y", 0)], "id int, query string, name string, pos int")
    assert {r.id: r["name"] for r in W.best_match(c, "id").collect()} == {1: "株式会社Ab", 2: "y"}
    h = rows(spark, [("p", "pending", 1), ("p", "pending", 3), ("q", "done", 2)], "problem string, status string, ts int")
    assert [(r.problem, r.ts) for r in W.latest_pending(h).collect()] == [("p", 3)]
    assert W.mark_done(h, "p", 2).filter("status = 'pending'").count() == 1
    f = rows(spark, [(1, "name", "Tanaka Inc", 0, True), (1, "name", "株式会社田中", 5, True), (1, "phone", "03", 1, False), (1, "phone", "06", 2, True)], "id int, field string, value string, priority int, ok boolean")
    assert {(r.field, r.value) for r in W.resolve_fields(f, "id").collect()} == {("name", "株式会社田中"), ("phone", "06")}
    u = W.ordered_union([rows(spark, [("a", 1), ("b", 0)], "k string, pos int"), rows(spark, [("a", 0), ("c", 0)], "k string, pos int")], "k")
    assert {(r.k, r.pos) for r in u.collect()} == {("a", 1), ("b", 0), ("c", 0)}
    urls = W.candidate_urls(rows(spark, [("s", "s/law", 0)], "site string, url string, pos int"), rows(spark, [("s",)], "site string"), ["/law", "/company"])
    assert {(r.url, r.priority) for r in urls.collect()} == {("s/law", 0), ("s/company", 1001)}
    assert W.least_recent(rows(spark, [(1, None), (2, 5)], "i int, t int"), "t").first().i == 1


COMPANY = "id long, company_name string, normalized_name string, phone string, base_url string, ad_sources array<string>, seen_count int, rank string, phone_source string, corporate_number string, nta_prefecture string, pref_match string, phone_confidence int, exported boolean, sheet_row int, found_date date, nta_retry_count int"


def companies(spark):
    one = lambda i, name, phone, number: (i, name, name, phone, f"u{i}", ["Google"], 1, "C", "lp", number, None, None, None, False, None, date(2024, 1, 1), 0)
    return rows(spark, [one(1, "株式会社田中", "03-5555-1234", "n1"), one(2, "株式会社鈴木", "011-555-1234", "n2"), one(3, "", "", None)], COMPANY)


def test_maintenance(spark):
    c = companies(spark)
    prefixes, near = rows(spark, [("03", "東京都"), ("011", "北海道")], "prefix string, prefecture string"), rows(spark, [("東京都", "千葉県")], "src string, dst string")
    reg = rows(spark, [("n1", "株式会社田中", "東京都"), ("n2", "株式会社鈴木", "東京都")], "corp_number string, name string, pref string")
    once = D.backfill_prefecture(c, reg, prefixes, near)
    got = {r.id: (r.pref_match, r.phone_confidence, r["rank"]) for r in once.collect()}
    assert got == {1: ("match", 70, "C"), 2: ("mismatch", 35, "C"), 3: ("unknown", 60, "C")}
    assert {r.id: r["rank"] for r in D.backfill_prefecture(once, reg, prefixes, near).collect()} == {k: v[2] for k, v in got.items()}
    m = D.merge_reextracted(c, rows(spark, [(1, "株式会社田中商店", None), (3, "x", None)], "id long, company_name string, phone string"))
    assert {r.id: (r.action, r.company_name) for r in m.collect()} == {1: ("UPDATE", "株式会社田中商店"), 2: ("KEEP", "株式会社鈴木"), 3: ("DELETE", "")}
    fixed = D.repair_names(c.withColumn("company_name", F.concat("company_name", F.lit(" 名古屋支店"))), rows(spark, [], "id long, company_name string"), reg)
    assert {r.id: r.company_name for r in fixed.collect()}[1] == "株式会社田中"
    assert {r.id: r["rank"] for r in D.rerank_by_evidence(c, rows(spark, [(1, 5), (1, 3)], "id long, score int")).collect()} == {1: "S", 2: "C", 3: "C"}
    assert D.drop_junk(c, AS_OF, 7).count() == 2 and D.exportable(c).count() == 2
    marked = D.mark_exported(c, rows(spark, [(1, 9)], "id long, sheet_row int"))
    assert [(r.id, r.sheet_row) for r in marked.filter("exported").collect()] == [(1, 9)]
    assert D.registry_gate(c.withColumn("lookup_error", F.col("id") == 3)).count() == 3 and D.only_entities(c).count() == 2
    assert len(D.export_rows(c.withColumns({x: F.lit("v") for x in ("lp_url", "industry", "keyword")})).columns) == 14
    assert D.ensure_columns(c.select("id"), {"rank": ("string", "C")}).first()["rank"] == "C"
    assert D.relax_unique(rows(spark, [(1, "a"), (2, "a"), (3, None)], "i int, k string"), ["k"], "i").count() == 2


def test_full_export(spark, tmp_path):
    c = companies(spark).withColumn("lp_url", F.lit("u")).withColumn("keyword", F.lit("k"))
    D.export_full(c, f"{tmp_path}/x")
    assert spark.read.csv(f"{tmp_path}/x", header=True).count() == 3


def test_sightings_change(spark):
    c = companies(spark)
    after, changes = dedupe.apply_sightings(c, rows(spark, [("03-5555-1234", "zz", "Meta"), ("zz", "u2", "Google")], "phone string, base_url string, source string"))
    got = {r.id: (r.seen_count, r.ad_sources, r["rank"]) for r in after.collect()}
    assert got[1] == (2, ["Google", "Meta"], "A") and got[2] == (2, ["Google"], "B") and got[3][0] == 1
    assert [(r.id, r.old_rank, r["rank"]) for r in changes.collect()] == [(1, "C", "A")]


def test_tune_and_seed(spark):
    settings = rows(spark, [("a", 8, 10, 60), ("b", 8, 10, 60), ("c", 4, 5, 20)], "source string, cooling_hours int, min_delay int, max_delay int")
    stats = rows(spark, [("a", 0.1, 5, 20.0, 0.0, 0.5, 0), ("b", 0.9, 20, 20.0, 0.0, 0.5, 3), ("c", 0.1, 1, 20.0, 0.9, 0.5, 3)], "source string, availability double, today int, baseline double, zero_rate double, extraction_rate double, streak int")
    assert {r.source: tuple(r)[1:] for r in K.tune(settings, stats).collect()} == {"a": (7, 12, 72), "b": (8, 8, 51), "c": (4, 5, 20)}
    groups = rows(spark, [("i", ["x", "y"], ["z"]), ("j", ["w"], [])], "industry string, google_yahoo array<string>, meta array<string>")
    assert sorted((r.source, r.keyword) for r in K.seed_keywords(groups, ["i"]).collect()) == [("google_yahoo", "x"), ("google_yahoo", "y"), ("meta", "z")]
    assert K.cross_modifiers(rows(spark, [("a",)], "keyword string"), ["b"]).first().keyword == "a b"


def test_more_pages(spark):
    page = '<html><head><meta property="og:site_name" content="株式会社山田 | x"><title>t</title></head><body><script>var o={"companyName":"株式会社佐藤"}</script><div>会社名：株式会社伊藤</div><p>Copyright 2024 株式会社高橋 All Rights Reserved.</p><cite>https://bad.example/</cite><cite>www.Good.example/x</cite><h1>導入事例</h1><p>企業名：株式会社渡辺</p><a href="https://client.example/">公式サイト</a></body></html>'
    p = rows(spark, [(1, "https://me.example/case/1", page)], "page_id long, url string, html string")
    assert [r.company for r in H.site_names(p).collect()] == ["株式会社山田"]
    assert [r.company for r in H.spa_names(p).collect()] == ["株式会社佐藤"]
    assert [r.company for r in H.div_pairs(H.blocks(p)).collect()] == ["株式会社伊藤", "株式会社渡辺"]
    assert [r.site for r in H.guess_site(p, ["bad"]).collect()] == ["www.good.example"]
    assert [(r.client, r.site) for r in H.case_clients(p, ["me.example"]).collect()] == [("株式会社伊藤", "https://client.example/")]
    legal = rows(spark, [(1, "販売業者：株式会社田中\nTEL：03-5555-1234\n\n販売業者：株式会社鈴木\nTEL：06-6666-1234", "株式会社鈴木")], "page_id long, text string, company string")
    assert [r.phone for r in H.legal_block_phone(legal).collect()] == ["06-6666-1234"]
    facts = rows(spark, [("s", "A社", None, 0), ("s", "B社", "03", 1), ("t", None, "06", 0), ("t", "C社", None, 1)], "site string, company string, phone string, ord int")
    assert {r.site: (r.company, r.phone) for r in H.merge_site_pages(facts).collect()} == {"s": ("B社", "03"), "t": ("C社", "06")}
    leads = rows(spark, [(1, None), (2, "株式会社広告")], "lead_id long, meta_company string")
    f = rows(spark, [(1, "legal", "株式会社田中", None, 0), (1, "landing", "株式会社他", "03-5555-1234", 1), (1, "contact", None, "06-6666-1234", 2)], "lead_id long, kind string, company string, phone string, ord int")
    got = {r.lead_id: (r["name"], r.phone, r.phones, r.source, r.corp_number) for r in H.assemble_companies(leads, f, rows(spark, [("n1", "株式会社田中", "東京都")], "corp_number string, name string, pref string")).collect()}
    assert got == {1: ("株式会社田中", "03-5555-1234", ["03-5555-1234", "06-6666-1234"], "landing", "n1"), 2: ("株式会社広告", None, [], None, None)}
    ev = H.ad_evidence(rows(spark, [(1, "a.example", 4)], "id int, domain string, quality int"), rows(spark, [(1, "serp", '<div class="ad">a.example</div>'), (1, "library", "a.example")], "id int, kind string, html string"))
    assert [(r.score, r["rank"]) for r in ev.collect()] == [(9, "S")]
    flags = H.snapshot_flags(p).first()
    assert not flags.captcha and flags.results == 0
    assert p.select(H.page_state(F.col("html")).alias("s")).first().s == "ok"


def test_lead_stream(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    lead = lambda url, source, name=None, phone=None: json.dumps({"lp_url": url, "source": source, "keyword": "k", "meta_company": name, "serp_phone": phone, "ts": "2024-01-01T00:00:00"})
    (tmp_path / "in" / "a.json").write_text("\n".join([lead("https://a.example.com/lp", "Google", "株式会社田中", "0355551234"), lead("https://www.a.example.com/x", "Yahoo", "株式会社田中", "0355551234"), lead("https://bit.ly/x", "Yahoo", "株式会社短", "0355551111"), lead("https://b.example.com/blog/1", "Yahoo", "株式会社記事", "0355552222"), lead("", "Yahoo")]))
    (tmp_path / "in2").mkdir()
    dims = {
        "not_landing": rows(spark, [("bit.ly",)], "host string"), "blocked": rows(spark, [("blocked.example",)], "host string"), "suffixes": rows(spark, [("com",)], "suffix string"),
        "facts": rows(spark, [], "lp_url string, company_name string, phone string, phone_source string, corporate_number string"),
    }
    L.run_lead_stream(S.read_leads(spark, f"{tmp_path}/in", streaming=True), dims, f"{tmp_path}/out", once=True).awaitTermination(120)
    first = spark.read.parquet(f"{tmp_path}/out/companies/0").collect()
    assert [(r.company_name, r.phone) for r in first] == [("株式会社田中", "03-5555-1234")]
    (tmp_path / "in" / "b.json").write_text(lead("https://c.example.com/", "Meta", "株式会社田中", "0355551234"))
    L.run_lead_stream(S.read_leads(spark, f"{tmp_path}/in", streaming=True), dims, f"{tmp_path}/out", once=True).awaitTermination(120)
    second = spark.read.parquet(f"{tmp_path}/out/companies/1").collect()
    assert [(r.company_name, r.seen_count, sorted(r.ad_sources)) for r in second] == [("株式会社田中", 2, ["Google", "Meta"])]
    assert spark.read.parquet(f"{tmp_path}/out/rank_changes/1").count() == 1
