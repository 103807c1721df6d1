"""Steps whose cost must grow no faster than their input."""

from pyspark.sql import functions as F

from leadmill.operators import match as J, pages as H


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trigram_search_through_copies(spark):
    """Grams are never broadcast, however small they are thought to be; of a name that many have, only k are met."""
    reg = spark.range(3000).select(F.col("id").alias("corp_number"), F.concat(F.lit("株式会社large ring "), (F.col("id") % 3).cast("string"), F.lit("号")).alias("name"), F.lit("x").alias("pref"))
    names = spark.createDataFrame([("large ring 1",), ("ring",), ("none",)], "name string")
    got = J.search_trigram(names, reg)
    assert "Broadcast" not in _plan(got)
    found = {}
    for r in got.collect():
        found.setdefault(r.query, {})[r.pos] = (r.corp_number, r.official_name[-2])
    assert found == {"large ring 1": {i + 1: (1 + 3 * i, "1") for i in range(5)}, "ring": {i + 1: (i, str(i % 3)) for i in range(5)}}


def test_digits_and_names_are_not_broadcast(spark):
    """Runs of digits and pieces of names meet by shuffles, and pages are dealt before they are taken apart."""
    own = spark.createDataFrame([(1, "株式会社東海", "0355551234", "https://a.example"), (2, "株式会社西海", "0666661234", "https://a.example")], "id long, company_name string, phone string, base_url string")
    pages = spark.createDataFrame([("a.example", "base", "/law", "株式会社東海 TEL 03-5555-1234"), ("a.example", "base", "/x", "TEL 03-5555-12")], "host string, kind string, path string, text string")
    got = J.phone_on_domain(own, pages)
    assert "Broadcast" not in _plan(got) and "REPARTITION_BY_COL" in _plan(got)
    assert {r.id: r.found_in for r in got.collect()} == {1: ["/law"], 2: None}
    said = J.evidence(own, pages)
    assert "Broadcast" not in _plan(said)
    assert sorted(map(tuple, said.collect())) == [(1, "base", True, True), (2, "base", False, False)]


def _pages(spark):
    cells = "<table><tr><th>会社名</th><td>株式会社東海</td></tr><tr><th>電話番号</th><td>0355551234</td></tr></table>"
    html = f'<html><body><a href="tel:06-6666-1234">tel</a>{cells}<p>企業名：株式会社東海</p><a href="https://b.example/">公式サイト</a></body></html>'
    return spark.createDataFrame([(1, "https://a.example/", html), (2, "https://a.example/", None)], "page_id long, url string, html string")


def test_pages_are_dealt_and_read_once(spark):
    """Elements are made after pages are dealt, and only once, however many places of a page are looked into."""
    pages = _pages(spark)
    assert "REPARTITION_BY_COL" in _plan(H.blocks(pages))
    for f in (H.page_phones, H.page_company, lambda p: H.container_pairs(H.blocks(p)), lambda p: H.container_phones(H.blocks(p))):
        assert "MapInArrow" not in _plan(f(pages))
    assert sorted((r.phone, r.tier) for r in H.page_phones(pages).collect()) == [("03-5555-1234", 11), ("06-6666-1234", 0)]
    assert [tuple(r) for r in H.page_company(pages).collect()] == [(1, "株式会社東海", "table")]
    assert [tuple(r) for r in H.container_pairs(H.blocks(pages)).collect()] == [(1, "株式会社東海", "03-5555-1234")]


def test_page_texts_are_dealt_first(spark):
    """What is said on a page is worked out after pages are dealt, and no filter pulls it before that."""
    pages = _pages(spark)
    for df in (H.site_names(pages), H.case_clients(pages, ["c.example"])):
        plan = _plan(df)
        assert "REPARTITION_BY_COL" in plan and "rlike" not in plan.lower().split("repartition_by_col")[-1].lower()
    assert [tuple(r) for r in H.case_clients(pages, ["c.example"]).collect()] == [(1, "株式会社東海", "https://b.example/")]


def test_references_that_lack_their_end(spark):
    """`&amp` needs no `;`, a name cut off goes: the same in a query and its SQL."""
    import duckdb

    from leadmill.functions.text import unescape_entities
    from leadmill.plans.catalog import _referred

    said = ["ver&amp", "doó&amp;&amp;&am", "a &copy b&quot", "x&cop&mid y", "&amp;", "p & q", "&am&amp;"]
    want = ["ver&", "doó&&", 'a © b"', "x y", "&", "p & q", "&"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in said], "x string").select(unescape_entities(F.col("x"))).collect()] == want
    assert [duckdb.sql(f"SELECT {_referred('x')} FROM (SELECT '{x}' AS x)").fetchall()[0][0] for x in said] == want


def test_directory_shares(spark, monkeypatch):
    """A hot phone's companies are dealt in shares, and every pair that differs comes out as often as it is there."""
    monkeypatch.setattr(J, "SHARE", 7)
    own = spark.range(40).select("id", F.lit("0311112222").alias("phone"), F.concat(F.lit("株式会社n"), (F.col("id") % 3).cast("string")).alias("company_name"))
    listed = spark.createDataFrame([("03-1111-2222", "n1"), ("03-1111-2222", "m9"), ("03-1111-2222", "m9"), ("06-1111-2222", "m8")], "phone string, listed string")
    out = J.directory_mismatch(own, listed)
    assert "_s" in _plan(out)
    want = sorted([(i, "n1") for i in range(40) if i % 3 != 1] + [(i, "m9") for i in range(40)] * 2)
    assert sorted((r.id, r.listed) for r in out.collect()) == want


def test_costly_columns_are_dealt_first(spark):
    from leadmill.operators import windows as W
    from leadmill.plans import catalog, more  # noqa: F401

    rows = spark.createDataFrame([(1, "a", "b", 0), (1, "a", "a", 1)], "id long, query string, name string, pos int")
    assert "REPARTITION_BY_COL" in _plan(W.best_match(rows, "id")) and [r.name for r in W.best_match(rows, "id").collect()] == ["a"]
    assert "REPARTITION_BY_COL" in _plan(catalog.QUERIES["f16_f23_spelling"](spark, "/root/testdata/sf0.001"))


def test_few_bytes_are_dealt_over_all_tasks(spark):
    """Pages of few bytes aren't put together in one task before they are parsed, nor elements before they are judged."""
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("https://a.example/").alias("url"), F.lit("<p>会社名：株式会社東海</p>").alias("html"))
    at = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert at(H.blocks(pages)) >= 8 and at(H.div_pairs(H.blocks(pages))) >= 8 and at(H.case_clients(pages, []).select("client")) >= 8


def test_elements_are_made_once_for_tables_and_divs(spark):
    b = H.blocks(_pages(spark))
    for df in (H.table_pairs(b), H.div_pairs(b)):
        assert _plan(df).count("MapInArrow") == 1 and "Join" not in _plan(df)
    assert [r.company for r in H.table_pairs(b).collect()] == ["株式会社東海"] and [r.company for r in H.div_pairs(b).collect()] == ["株式会社東海"]


def test_rows_and_links_of_elements(spark):
    """A label alone in its row takes the next row's first cell, one beside another cell doesn't; blocks in links are out."""
    table = "<table><tr><th>会社名</th></tr><tr><td>株式会社東海</td></tr><tr><td>販売業者</td><td>株式会社西海</td></tr></table>"
    divs = "<a><div>会社名：株式会社リンク</div></a><div><p>会社名</p><p>株式会社南海</p></div><div>商号：株式会社北海</div>"
    b = H.blocks(spark.createDataFrame([(1, table + divs), (2, table)], "page_id long, html string"))
    assert sorted((r.page_id, r.company) for r in H.table_pairs(b).collect()) == [(p, c) for p in (1, 2) for c in ("株式会社東海", "株式会社西海")]
    assert sorted(r.company for r in H.div_pairs(b).collect()) == ["株式会社北海", "株式会社南海"]


def test_jsonld_is_read_in_one_pass(spark):
    """Objects, lists, @graph and what they name are unrolled where they stand, not by a union of passes over the pages."""
    body = '[{"@type": "Organization", "name": "株式会社東海"}, {"@graph": [{"@type": "WebSite", "publisher": {"@type": "Organization", "name": "株式会社西海", "telephone": "03-5555-1234"}}]}]'
    pages = spark.createDataFrame([(1, f'<script type="application/ld+json">{body}</script>'), (2, None)], "page_id long, html string")
    got = H.jsonld_orgs(pages)
    assert "Union" not in _plan(got)
    assert sorted((r.company, r.phone) for r in got.collect()) == [("株式会社東海", None), ("株式会社西海", "03-5555-1234")]


def test_variants_of_keywords_are_dealt_by_their_number(spark, monkeypatch):
    """Variants are sorted in shares of a bounded number of rows."""
    from leadmill.operators import keywords as K, windows as W

    monkeypatch.setattr(W, "SHARE_ROWS", 20)
    rows = spark.range(40).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("keyword"), F.lit("google").alias("source"), F.lit(5).alias("total_found"))
    plan = _plan(K.expand_keywords(rows, cities=["東京", "大阪"], synonyms={"業者": ["会社"]}))
    assert "hashpartitioning(keyword" in plan and plan.count("REPARTITION_BY_NUM") == 2
    assert K.expand_keywords(rows, cities=["東京", "大阪"], synonyms={"業者": ["会社"]}).count() == 80


def test_competitors_are_ranked_in_bounded_shares(spark, monkeypatch):
    from leadmill.operators import windows as W
    from leadmill.plans import catalog

    assert {"j14_duplicates", "j15_ledger", "j16_competitors", "j17_only_new", "j1_next_keywords", "j2_available_pairs"} <= set(catalog.QUERIES) & set(catalog.ORACLE_SQL)
    monkeypatch.setattr(W, "SHARE_ROWS", 10)
    rows = spark.createDataFrame([(i, f"n{i}", "k x", "a") for i in range(5)], "id long, company_name string, keyword string, area_name string")
    got = J.competitors(rows)
    assert "REPARTITION_BY_NUM" in _plan(got)
    assert {r.id: r.competitors for r in got.collect()}[4] == ["n3", "n2", "n1"]


def test_nested_ads_are_dealt_by_their_number(spark, monkeypatch):
    from leadmill.operators import windows as W
    from leadmill.sources import readers as S

    monkeypatch.setattr(W, "SHARE_ROWS", 1)
    got = S.ads_from_nested(spark.createDataFrame([("k", '{"n": "c", "list": [{"u": "https://a.example/"}]}')], "keyword string, body string"), ["u"], ["n"])
    assert "REPARTITION_BY_NUM" in _plan(got)
    assert [tuple(r)[:3] for r in got.collect()] == [("k", "https://a.example/", "c")]
