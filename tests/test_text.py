"""Names, phones, scores and URLs by example."""

import html
from html.entities import html5

from pyspark.sql import functions as F

from leadmill.functions import sql, text as T, urls as U
from leadmill.functions.names import is_valid_company, is_valid_company_labelled, normalize_names, sanitize_names


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_names(spark):
    cases = {
        "サンテク(株式会社山陽テクノサービス)": "株式会社山陽テクノサービス",
        "一級建築士事務所 株式会社 北条工務店": "一級建築士事務所 株式会社 北条工務店",
        "©2024 株式会社田中産業": "株式会社田中産業",
        "【公式】株式会社田中産業": "株式会社田中産業",
        "㈲田中商店": "有限会社田中商店",
        "サンプル㈱": "サンプル株式会社",
        "株式会社オオクシ‐採用サイト": "株式会社オオクシ",
        "株式会社田中産業（東京本社）": "株式会社田中産業",
        "株式会社 田中 千代田区丸の内1丁目2番地": "株式会社 田中",
        "株式会社ハツカ代表取締役CEO": "株式会社ハツカ",
        "SUN マルシェ株式会社 東京都渋谷区": "SUN マルシェ株式会社",
        "SBS holdings Inc. All rights reserved.": "SBS holdings Inc.",
        "株式会社 ZENB JAPAN 「会社概要」はこちら": "株式会社 ZENB JAPAN",
        "自然派くらぶ生活協同組合ホームページ": "自然派くらぶ生活協同組合",
        "株式会社キューブ代表者名代表取締役会長兼社長松村智明（コード番号": "株式会社キューブ",
        "のぞみ税理士法人の大阪市エリアの事務STAFFのバイト・アルバイト求人情報": "のぞみ税理士法人",
        "株式会社アクセスの採用・求人情報": "株式会社アクセス",
        "株式会社サンフジ企画の個人情報のお取り扱いについて": "株式会社サンフジ企画",
        "株式会社きのこの採用情報": "株式会社きのこ",
        "ICONIC Co.,Ltd.（グローバル転職のアイコニック": "ICONIC Co.,Ltd.",
        "株式会社タキオン.": "株式会社タキオン",
        "株式会社田中産業(以下、弊社)": "株式会社田中産業",
        "株式会社小野写真館本社所在地": "株式会社小野写真館",
        "田中建設株式会社（仮称）（東京支社）": "田中建設株式会社",
        "単調な工場作業はイヤだ！【株式会社八王子】": "株式会社八王子",
        "内装工事の株式会社山田": "株式会社山田",
        "無人内見 MUJIN24 物件一覧 セキスイハイム東海株式会社": "セキスイハイム東海株式会社",
        "有限会社山本 佐世保市・長崎のFP": "有限会社山本",
        "田中クリニック 大阪市北区1-2": "田中クリニック",
        "株式会社 SUN マルシェ 渋谷区1-1": "株式会社 SUN マルシェ",
        "株式会社 千成屋 〒123-4567 東京都港区": "株式会社 千成屋",
        "「株式会社田中産業」": "株式会社田中産業",
        "株式会社" + " ".join(f"語{i}" for i in range(90)): "株式会社語0",
        "株式会社 " + " ".join(f"語{i}" for i in range(90)): "株式会社 " + " ".join(f"語{i}" for i in range(90)),
        "株式会社代表": "株式会社代表",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string")
    got = {r.raw: r["name"] for r in normalize_names(rows, "raw").collect()}
    assert {k: got[k] for k in cases} == cases
    assert got[None] == ""


def test_sanitize_names(spark):
    rows = spark.createDataFrame([("株式会社ABC 採用情報",), ("株式会社ABC代表取締役",), ("こちらは会社の名前ではなく長い文章がここに書いてありますよ",), ("",)], "raw string")
    got = {r.raw: r["name"] for r in sanitize_names(rows, "raw").collect()}
    assert got["株式会社ABC 採用情報"] == "株式会社ABC"
    assert got["株式会社ABC代表取締役"] == "株式会社ABC"
    assert got["こちらは会社の名前ではなく長い文章がここに書いてありますよ"] is None
    assert got[""] is None
    rows = spark.createDataFrame([("フランチャイズ加盟店 山田株式会社",), ("採用情報",), ("山田 太郎株式会社 公式サイト 採用情報",)], "raw string")
    assert {r.raw: r["name"] for r in sanitize_names(rows, "raw").collect()} == {"フランチャイズ加盟店 山田株式会社": "山田株式会社", "採用情報": None, "山田 太郎株式会社 公式サイト 採用情報": "山田 太郎株式会社"}


def test_light_names(spark):
    assert apply(spark, T.strip_garbage, ["株式会社A（仮称）", "株式会社B - 採用情報", "株式会社C）", "株式会社Dの求人情報", None, ""]) == ["株式会社A", "株式会社B", "株式会社C", "株式会社D", "", ""]


def test_validity(spark):
    assert apply(spark, is_valid_company, ["田中産業", "株式会社田中のサービス一覧", "行政書士法人田中事務所", "株式会社田中産業", "株式会社"]) == [False, False, True, True, False]
    assert apply(spark, is_valid_company_labelled, ["田中クリニック", "不動産", "株式会社田中"]) == [True, False, True]


def test_normalize_company(spark):
    assert apply(spark, T.normalize_company, ["（株）リクルート", "リクルート株式会社", None, "ＡＢＣ㈱"]) == ["リクルート", "リクルート", "", "abc"]


def test_phones(spark):
    got = apply(spark, T.extract_phone, ["+81-3-5555-1234", "０３－５５５５－１２３４", "03-1234-5678", "0120-123-456", "FAX: 03-9999-1111", None, "tel:0355551234", "06-6666-1234\n090-1111-2345"])
    assert got == ["03-5555-1234", "03-5555-1234", None, "0120-123-456", None, None, "03-5555-1234", "06-6666-1234"]
    sme = apply(spark, lambda c: T.extract_phones(c, "sme"), ["06-6666-1234\n090-1111-2345"])
    assert sme == [["090-1111-2345", "06-6666-1234"]]
    assert apply(spark, T.is_valid_phone, ["03-5555-1234", "0120-000-000", "03-0000-0000", "045-111-2222", "12"]) == [True, False, False, True, False]


def test_scores(spark):
    rows = spark.createDataFrame([("lp_tokutei_section", "unknown", 90), ("lp_hp", "match", 80), ("tokutei_hp", "match", 100), ("lp", "mismatch", 35), (None, None, 50)], "s string, p string, want int")
    assert all(r.got == r.want for r in rows.select("want", T.phone_confidence(F.col("s"), F.col("p")).alias("got")).collect())
    rows = spark.createDataFrame([(1, ["a"], "C"), (2, ["a"], "B"), (1, ["a", "b"], "A"), (5, ["a"], "S"), (1, ["a", "b", "c"], "S"), (1, None, "C")], "n int, s array<string>, want string")
    assert all(r.got == r.want for r in rows.select("want", T.calc_rank(F.col("n"), F.col("s")).alias("got")).collect())
    assert apply(spark, T.demote_rank, ["S", "A", "B", "C", None]) == ["A", "B", "C", "C", "C"]
    assert apply(spark, T.classify_industry, ["外壁塗装 東京", "塗装", "税理士 大阪", "xyz", None]) == ["外壁・屋根塗装", "塗装", "税理士", "", ""]


def test_entities_and_widths(spark):
    named = [f"a &{n} b &eacute;&{n}" for n in html5 if n.endswith(";")]
    assert apply(spark, T.unescape_entities, named) == [html.unescape(x) for x in named]
    assert apply(spark, T.unescape_entities, ["a&amp;b", "&#26666;&#x5F0F;", "A&nbsp;B", "x &foo y", None]) == ["a&b", "株式", "A\xa0B", "x  y", ""]
    assert apply(spark, lambda c: T.to_halfwidth(T.to_fullwidth(c)), ["Ab 1-!"]) == ["Ab 1-!"]


def test_urls(spark):
    assert apply(spark, U.normalize_url, ["http://www.Example.co.jp/path/?q=1#x"]) == ["https://example.co.jp/path"]
    assert apply(spark, U.unwrap_tracker, ["https://g.example/aclk?adurl=https%3A%2F%2Fa.example%2Fx%3Fy%3D1", "https://r.example/r/https%3A%2F%2Fb.example%2F", "https://c.example/**https://d.example/", "https://b.example/a?u=a1aHR0cHM6Ly9lLmV4YW1wbGUv", "https://f.example/", None]) == ["https://a.example/x?y=1", "https://b.example/", "https://d.example/", "https://e.example/", None, None]
    rows = spark.createDataFrame([("https://a.example/b/c.html", "../d", "https://a.example/d"), ("https://a.example/b/", "e", "https://a.example/b/e"), ("https://a.example/", "//a.example/f", "https://a.example/f"), ("https://a.example/", "https://x.example/", None), ("https://a.example/", "mailto:x@y", None)], "b string, h string, want string")
    assert all(r.got == r.want for r in rows.select("want", U.resolve_link(F.col("b"), F.col("h")).alias("got")).collect())


def test_sql_functions(spark):
    sql.register_sql(spark)
    row = spark.sql("SELECT lead_rank(2, array('a')) AS a, lead_demote('S') AS b, lead_digits('03-1') AS c, lead_match_key('Ａ Ｂ') AS d, lead_is_freephone('0120-1') AS e").first()
    assert tuple(row) == ("B", "A", "031", "ab", True)
    values = ["㈱田中商店 大阪支店", "【公式】株式会社山田（東京本社） 採用情報", "TEL 03-5555-1234 FAX 03-5555-9999", "https://www.A.example/blog/1?x=1", "院長：山田太郎 it's \\d &amp;&#65;", "0120-123-456", "", None, "Foo Co., Ltd."]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    for name, args, f in sql.FUNCTIONS:
        if args == "s STRING":
            got = rows.select("i", F.expr(f"{name}(s)").alias("q"), f(F.col("s")).alias("d")).collect()
            assert all(r.q == r.d for r in got), name
    assert spark.sql("SELECT lead_resolve_link('https://a.example/b/', 'e') AS x, lead_phone_confidence('lp_hp', 'match') AS y").first() == ("https://a.example/b/e", 80)
