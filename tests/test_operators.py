"""Joins, deduplication and windows against plain Python models and examples."""

import random

from pyspark.sql import functions as F

from leadmill.operators import dedupe, match, pages as H, windows as W
from leadmill.sources import readers as S
from leadmill.streaming import alerts as R


def test_insert_or_ignore_is_sequential(spark):
    random.seed(5)
    for case in range(3):
        rows = [(i, random.choice(["a", "b", "c", "d", None]), random.choice(["x", "y", "z", None]), random.choice(["p", "q", "r", "s", "t"])) for i in range(25)]
        old = [(100 + i, random.choice(["a", None]), None, "t") for i in range(case)]
        seen = [{v for r in old if (v := r[k]) is not None} for k in (1, 2, 3)]
        want = []
        for r in rows:
            if not any(r[k] is not None and r[k] in seen[k - 1] for k in (1, 2, 3)):
                want.append(r[0])
                for k in (1, 2, 3):
                    seen[k - 1] |= {r[k]} - {None}
        schema = "id long, k1 string, k2 string, k3 string"
        got, lost = dedupe.insert_or_ignore(spark.createDataFrame(rows, schema), spark.createDataFrame(old, schema), ["k1", "k2", "k3"], "id")
        assert sorted(r.id for r in got.collect()) == want
        assert lost.count() == len(rows) - len(want)


def test_duplicate_rules(spark):
    old = spark.createDataFrame([("n", "u", "p")], "normalized_name string, base_url string, phone string")
    new = spark.createDataFrame([("n", "x", "x"), ("x", "u", "x"), ("x", "x", "p"), ("x", "x", "x")], "normalized_name string, base_url string, phone string")
    by = lambda rule: [r.dup_by for r in match.find_duplicates(new.withColumn("i", F.monotonically_increasing_id()), old, rule).orderBy("i").collect()]
    assert by("A") == ["normalized_name", "base_url", None, None]
    assert by("B") == ["normalized_name", "base_url", "phone", None]


def test_nearest_pair(spark):
    rows = [(1, 0, "A社", None), (1, 6, "B社", None), (1, 7, None, "03-5555-1234"), (2, 0, "C社", None), (2, 20, None, "x"), (3, 5, "D社", "same")]
    got = {r.doc_id: (r.company, r.phone, r.distance) for r in W.nearest_pair(spark.createDataFrame(rows, "doc_id long, line int, company string, phone string")).collect()}
    assert got == {1: ("B社", "03-5555-1234", 1), 3: ("D社", "same", 0)}


def test_trigram_search(spark):
    registry = spark.createDataFrame([(1, "株式会社東京商事", "a"), (2, "東京商事販売", "b"), (3, "大阪", "c")], "corp_number long, name string, pref string")
    names = spark.createDataFrame([("東京商事",), ("大阪商事",), ("x",)], "name string")
    assert sorted((r.query, r.corp_number, r.pos) for r in match.search_trigram(names, registry).collect()) == [("東京商事", 1, 1), ("東京商事", 2, 2)]


PAGE = '<html><head><script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"x"},{"@type":"Organization","name":["株式会社山田商事"],"telephone":["bad","03-5555-1234"]}]}</script></head><body></body></html>'
TABLE = "<html><body><nav><a href='/x'>会社名: 株式会社リンク</a></nav><table><tr><th>会社名</th><td>株式会社田中産業</td></tr><tr><th>電話番号</th><td>06-6666-1234</td></tr></table><dl><dt>販売業者</dt><dd>有限会社鈴木</dd></dl></body></html>"


def test_page_jobs(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", PAGE), (2, "https://b.example/", TABLE), (3, "https://c.example/", None)], "page_id long, url string, html string")
    assert [(r.page_id, r.company, r.phone) for r in H.jsonld_orgs(pages).collect()] == [(1, "株式会社山田商事", "03-5555-1234")]
    b = H.blocks(pages)
    assert sorted(r.company for r in H.table_pairs(b).collect()) == ["有限会社鈴木", "株式会社田中産業"]
    assert [(r.page_id, r.company, r.phone) for r in H.container_pairs(b).collect()] == [(2, "株式会社田中産業", "06-6666-1234")]
    assert {r.page_id: (r.company, r.source) for r in H.page_company(pages, b).collect()} == {1: ("株式会社山田商事", "json_ld"), 2: ("株式会社田中産業", "table")}


def test_line_pairs(spark):
    texts = [(1, "会社名：株式会社田中\n住所\nTEL：03-5555-1234"), (2, "販売業者\n株式会社鈴木\n\n06-6666-1234"), (3, "何もない")]
    got = {r.page_id: (r.company, r.phone) for r in H.line_pairs(spark.createDataFrame(texts, "page_id long, text string")).collect()}
    assert got == {1: ("株式会社田中", "03-5555-1234"), 2: ("株式会社鈴木", "06-6666-1234")}


def test_nearest_phone(spark):
    rows = spark.createDataFrame([("東京店 03-5555-1111 本社 株式会社田中 06-6666-1234", "株式会社田中", ["03-5555-1111", "06-6666-1234"]), ("", "x", []), ("a", "x", ["03-5555-1111"])], "body string, company string, phones array<string>")
    assert sorted(str(r.phone) for r in W.nearest_phone(rows, "body", "company", "phones").collect()) == ["03-5555-1111", "06-6666-1234", "None"]


def test_long_pages_are_read_whole(spark):
    late = '<script>var big = 1;</script><script>var a = {"companyName": "株式会社後方商事"};</script><h1>Late</h1><a href="/late">late link</a><p>late text</p>'
    page = "<html><body><script>" + "x" * 150_000 + "</script>" + "<p>word</p>" * 50_000 + late + "</body></html>"
    pages = spark.createDataFrame([(1, "https://a.example.com/", page)], "page_id long, url string, html string")
    assert "late text" in pages.select(H.visible_text(F.col("html")).alias("t")).first().t
    assert "late text" in pages.select(H.visible_text_lines(F.col("html")).alias("t")).first().t
    assert [r.company for r in H.spa_names(pages).collect()] == ["株式会社後方商事"]
    assert any("/late" in str(r) for r in H.links(pages).collect())


def test_stretches_of_time_say_the_same(spark):
    random.seed(8)
    rows = [(i, random.randrange(400), random.choice(["a", "a", "a", "b", None]), "search" if i % 2 else "extract", random.random() < 0.6) for i in range(600)]
    tele = spark.createDataFrame(rows, "id long, ts long, source string, kind string, ok boolean")
    by = {}
    for i, ts, source, kind, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        by.setdefault(source, []).append((i, ts, kind, ok))
    for size in (40, 7, 10_000):
        got = {r.id: (r.seen, r.rate) for r in W.rolling_success(tele, 20, 5, rows=size).collect()}
        streak = {r.id: r.streak for r in W.streaks(tele.withColumn("t", F.col("ts") * 1000 + F.col("id")), "ok", order="t", rows=size).collect()}
        assert len(got) == len(streak) == 600
        for own in by.values():
            run = 0
            for k, (i, _, _, ok) in enumerate(own):
                last = [o[3] for o in own[max(0, k - 19) : k + 1]]
                assert got[i][0] == len(last) and (got[i][1] is None) == (len(last) < 5) and (got[i][1] is None or abs(got[i][1] - sum(last) / len(last)) < 1e-9)
                run = run % 3 + 1 if ok else 0
                assert streak[i] == run
        want, low_want = [], []
        for source, own in by.items():
            run, low = 0, False
            for k, (_, ts, _, ok) in enumerate([o for o in own if o[2] == "search"]):
                run = 0 if ok else run + 1
                want += [(source, ts)] * (run == 3)
            some = [o for o in own if o[2] == "extract"]
            for k, (_, ts, _, _) in enumerate(some):
                last = [o[3] for o in some[max(0, k - 9) : k + 1]]
                now = len(last) >= 5 and sum(last) / len(last) < 0.45
                low_want += [(source, ts)] * (now and not low)
                low = now
        key = lambda rs: sorted((str(r.source), int(r.ts.timestamp())) for r in rs)
        assert key(R.failure_streak_alerts(tele, 3, size).collect()) == sorted((str(s), t) for s, t in want)
        assert key(R.low_success_alerts(tele, 10, 0.45, size).collect()) == sorted((str(s), t) for s, t in low_want)


def test_nested_ads_at_any_depth(spark):
    import json

    ad = {"page_name": "近く", "snapshot": {"link_url": "https://a.example/"}}
    for _ in range(6):
        ad = {"edges": [ad]}
    body = {"data": ad, "other": [{"page_name": "x", "link_url": "https://b.example/"}, {"link_url": "https://c.example/"}, {"link_url": "ftp://d"}, {"link_url": " "}]}
    rows = spark.createDataFrame([("k", json.dumps(body)), ("k", json.dumps(body)), ("bad", "{"), ("none", "[]"), ("null", None)], "keyword string, body string")
    got = {(r.keyword, r.url): r.company for r in S.ads_from_nested(rows, ["link_url"], ["page_name"]).collect()}
    assert got == {("k", "https://a.example/"): "近く", ("k", "https://b.example/"): "x", ("k", "https://c.example/"): None}
    assert S.ads_from_nested(rows.limit(0), ["link_url"], ["page_name"]).count() == 0
