"""Charsets by bytes; values in scripts and the names in them."""

import json
import random

from leadmill.operators import pages as H, scratch, scripts, variants
from leadmill.sources import readers as S


def test_unlabelled_charsets(spark):
    texts = ["<p>株式会社田中商事（東京都）の特定商取引法に基づく表記です。電話03-5555-1234、カタカナ＆ひらがな。</p>", "ascii only \\ ~", "む。", "会社概要 事業内容", "ｶﾀｶﾅと漢字", ""]
    rows = [(c, t, t.encode(c, "strict")) for c in ("utf-8", "shift_jis", "euc-jp", "iso-2022-jp") for t in texts if not (c == "iso-2022-jp" and "ｶ" in t)]
    rows += [("cp932", "㈱田中①の会社です", "㈱田中①の会社です".encode("cp932")), ("bad", "�abc", b"\xffabc"), ("null", None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "c string, t string, raw binary, named string")
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert [(r.c, r.html) for r in S.decode_pages(df, "raw").collect()] == [(c, t) for c, t, _ in rows]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_header_before_bytes_and_meta_after(spark):
    rows = [("meta charset=euc-jp 田中".encode("euc-jp"), "shift_jis"), ("田中です".encode("shift_jis"), "utf-8"), ("é".encode("latin1"), "ISO-8859-1"), ("é".encode("cp1252") + b"<meta charset='windows-1252'>", None), ("ひ".encode(), "no-such")]
    df = spark.createDataFrame(rows, "raw binary, h string")
    assert [(r.html, r.charset) for r in S.decode_pages(df, "raw", "h").collect()] == [("meta charset=euc-jp 田中", "euc-jp"), ("田中です", "shift_jis"), ("é", "iso-8859-1"), ("é<meta charset='windows-1252'>", "windows-1252"), ("ひ", "utf-8")]


def test_literals():
    got = list(scripts.values_of(r"""
      (function(){ if (a) { b({c: 1}); } })();
      window.__S__ = {a: 'it\'s', "b": [1, .5, 0x1F, -2e3,], /* } */ c: undefined, d: !0, // {
        e: `x\u{1F600}`, f: "😀\x41", 7: null,};
      x = {y: function() { return {z: 1}; }}; t = `${a}`; u = {v: 1 + 2};
      var p = JSON.parse('{"q":"\\u682a \\"r\\""}'), l = [{m: "</"}];
    """))
    assert [(n, json.loads(t)) for n, t in got] == [
        ("", {"c": 1}), ("window.__S__", {"a": "it's", "b": [1, 0.5, 31, -2000.0], "c": None, "d": True, "e": "x😀", "f": "😀A", "7": None}), ("JSON.parse", {"q": '株 "r"'}), ("l", [{"m": "</"}]),
    ]
    assert scripts.literal_at("{" * 3000, 0) is None and scripts.literal_at('{"a":1]', 0) is None


def _walk(v, depth=0):
    """Names by the plain rule, an object's own before those below."""
    if depth > 8:
        return
    if isinstance(v, dict):
        yield from (v[k] for k in sorted(H.STATE_KEYS) if isinstance(v.get(k), str) and v[k].strip())
    for x in [v[k] for k in sorted(v)] if isinstance(v, dict) else v[:30] if isinstance(v, list) else []:
        yield from _walk(x, depth + 1)


def test_state_names_by_json(spark):
    random.seed(2)

    def made(depth):
        if depth == 0 or random.random() < 0.2:
            return random.choice([1, None, "x", True, "株式会社乙"])
        if random.random() < 0.4:
            return [made(depth - 1) for _ in range(random.choice([1, 2, 35]) if depth < 4 else 2)]
        keys = random.sample([*H.STATE_KEYS, "a", "b", "c d", "é"], 4)
        return {k: random.choice(["株式会社" + random.choice("甲乙丙"), " ", 5]) if k in H.STATE_KEYS and random.random() < 0.7 else made(depth - 1) for k in keys}

    values = [made(random.randint(1, 11)) for _ in range(60)]
    pages = spark.createDataFrame([(i, f"<script type='application/json'>{json.dumps(v, ensure_ascii=i % 2 == 0)}</script>") for i, v in enumerate(values)] + [(900, None), (901, ""), (902, "<script>{{{</script>")], "page_id long, html string")
    got = {}
    for r in sorted(H.state_names(pages).collect(), key=lambda r: (r.page_id, r.script, r.no, r.path, r.at)):
        got.setdefault(r.page_id, []).append(r.raw)
    assert got == {i: names for i, v in enumerate(values) if (names := [x.strip() for x in _walk(v) if x.strip()])}


def test_names_in_nested_objects(spark):
    pages = spark.createDataFrame([(1, '<script>window.S={shop:{company:{name:"(株)甲商店"}}}</script>'), (2, '<script>x({"a":{"name":"株式会社乙"}});"companyName":"株式会社丙"</script>'), (3, None)], "page_id long, html string")
    assert {(r.page_id, r.company) for r in H.spa_names(pages).collect()} == {(1, "株式会社甲商店"), (2, "株式会社丙")}
    assert H.spa_names(pages.limit(0)).count() == 0


def test_scopes_leave_nothing_but_what_is_kept(spark, tmp_path):
    import os

    folder = scratch.shared_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch.scope(spark) as keep:
        df = spark.createDataFrame([(1, '{"a":{"b":[{"c":1}]}}')], "id int, json string").selectExpr("id", "try_parse_json(json) AS v")
        parts = variants.levels(df, ["id"])
        kept = keep(parts[-2].select("id", "path", "keys"), "kept")
    assert [(r.path, r["keys"]) for r in kept.collect()] == [([0, 0, 0], ["a", "b", None])]
    assert [f.split("-")[0] for f in set(os.listdir(folder)) - before] == ["kept"]


def test_names_at_any_depth_and_place(spark):
    """No level, item or repeated key is too far: the only name of a page lies below level 8, after item 30, or thousands
    of levels down, deeper than JSON readers go."""
    name = {"corpName": "株式会社甲"}  # a key that is read in objects alone
    deep, far, both = {"a": name}, [0] * 40 + [name], [[1]] * 31 + [{"b": {"company": {"name": "株式会社甲"}}}]
    for _ in range(9):
        deep, both = {"a": deep}, [both]
    very = '{"a":[' * 8000 + json.dumps(name) + "]}" * 8000
    said = [json.dumps(deep), json.dumps(far), json.dumps(both), very, '{"x":1,"x":{"corpName":"株式会社甲"}}', '{"a":' + "9" * 5000 + ',"corpName":"株式会社甲"}']
    pages = spark.createDataFrame([(i, f"<script type='application/json'>{t}</script>") for i, t in enumerate(said)], "page_id long, html string")
    want = {(i, "株式会社甲") for i in range(len(said))}
    assert {(r.page_id, r.company) for r in H.spa_names(pages).collect()} == want
    assert {(r.page_id, r.company, r.source) for r in H.page_company(pages).collect()} == {(*w, "spa") for w in want}


def test_json_without_recursion():
    random.seed(5)

    def made(depth):
        kind = random.randrange(5 if depth else 3)
        return [random.random(), None, 'é"\\ \n', [made(depth - 1) for _ in range(random.randrange(4))] if depth else 0, {random.choice("abc\""): made(depth - 1) for _ in range(random.randrange(4))} if depth else 0][kind]

    for _ in range(300):
        v = made(5)
        text = json.dumps(v, indent=random.choice([None, 1]))
        assert scripts._loaded_flat(text) == scripts.loaded(text) == v
        for bad in (text + "]", text[:-1], "[" + text, text.replace(",", ",,", 1), text.replace(":", "", 1)):
            try:
                json.loads(bad)
            except ValueError:
                for read in (scripts.loaded, scripts._loaded_flat):
                    try:
                        read(bad)
                    except ValueError:
                        continue
                    raise AssertionError(bad)
    assert [(p[:], k) for p, k, _ in scripts.containers({"b": [1, {}, []], "a": {"c": {}}})] == [([], None), ([0], "a"), ([0, 0], "c"), ([1], "b"), ([1, 1], None), ([1, 2], None)]


def test_company_of_a_page_from_far_within_its_state(spark):
    """A name in script data goes before the title's, however far within."""
    deep, far = {"corpName": "株式会社甲商店"}, [0] * 30 + [{"corpName": "株式会社甲商店"}]
    for _ in range(9):
        deep = [deep]
    pages = spark.createDataFrame([(i, f"<html><head><title>株式会社乙商事</title></head><script>window.S = {json.dumps(v)};</script></html>") for i, v in enumerate((deep, far))], "page_id long, html string")
    assert sorted(tuple(r) for r in H.page_company(pages).collect()) == [(i, "株式会社甲商店", "spa") for i in range(2)]
