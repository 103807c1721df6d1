"""Operators whose work must not meet in one task, a pair of all or an endless round: against plain models."""

import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from leadmill.operators import dedupe, graph, keywords as K, match, scratch, windows as W


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _one_by_one(rows, keys):
    taken, won = [set() for _ in range(keys)], []
    for r in sorted(rows):
        if not any(v is not None and v in t for v, t in zip(r[1:], taken, strict=True)):
            won.append(r[0])
            for v, t in zip(r[1:], taken, strict=True):
                t.add(v)
    return won


def _rounds(monkeypatch):
    count, plain = [0], dedupe._round

    def counted(*args):
        count[0] += 1
        return plain(*args)

    monkeypatch.setattr(dedupe, "_round", counted)
    return count


@pytest.mark.parametrize("one_task,component", [(1_000_000, 200_000), (50, 200_000), (1_000_000, 30)])
def test_insert_or_ignore_of_random_rows(spark, monkeypatch, one_task, component):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    monkeypatch.setattr(dedupe, "COMPONENT_ROWS", component)
    random.seed(component + one_task)
    rows = [(i, *(random.choice([None, *range(220)]) for _ in range(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k1 long, k2 long, k3 long").repartition(3)
    got, lost = dedupe.insert_or_ignore(df, df.limit(0), ["k1", "k2", "k3"], "id")
    want = _one_by_one(rows, 3)
    assert sorted(r.id for r in got.collect()) == want and lost.count() == len(rows) - len(want)


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    """Each row shares a key with the one before it and another with the one after it."""
    n, count = 10_000, _rounds(monkeypatch)
    chain = [(i, f"a{(i + 1) // 2}", f"b{i // 2}", "") for i in range(n)]
    hot = [(n + i, "a0", f"c{i}", f"d{i}") for i in range(2_000)]
    rows = [(i, a, b, d or f"e{i}") for i, a, b, d in chain + hot]
    df = spark.createDataFrame(rows, "id long, k1 string, k2 string, k3 string").repartition(4)
    got, _ = dedupe.insert_or_ignore(df, df.limit(0), ["k1", "k2", "k3"], "id")
    assert sorted(r.id for r in got.collect()) == _one_by_one(rows, 3) and count[0] < 10


def test_components(spark, monkeypatch):
    random.seed(3)
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(900) if i % 30] + [(f"x{random.randint(0, 400)}", f"x{random.randint(0, 400)}") for _ in range(150)]
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        above[top(a)] = top(b)
    want = {frozenset(x for x in above if top(x) == t) for t in {top(x) for x in above}}
    df = spark.createDataFrame(edges, "a string, b string")
    for limit in (1_000_000, 60):
        monkeypatch.setattr(graph, "ONE_TASK", limit)
        with scratch.scope(spark):
            groups = {}
            for r in graph.components(df).collect():
                groups.setdefault(r.component, set()).add(r.id)
        assert {frozenset(g) for g in groups.values()} == want and all(c in g for c, g in groups.items())
        with scratch.scope(spark):
            assert graph.components(df.limit(0)).count() == 0


def test_many_least_rows(spark):
    random.seed(6)
    rows = [(i, random.choice([None, 0.0, 1.5, 1.5, math.exp(random.uniform(-20, 20))]), random.choice("abc") * (i % 3), i // 700) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, s string, k int").repartition(4)
    nulls_first = lambda *vs: tuple((v is not None, v) if v is not None else (False, 0) for v in vs)
    for n in (0, 1, 40, 700, 1500, 2999, 3000, 9000):
        for order, key in ((["x", "id"], lambda r: nulls_first(r[1], r[0])), (["k", "s", "id"], lambda r: nulls_first(r[3], r[2], r[0])), (["s", "id"], lambda r: nulls_first(r[2], r[0]))):
            got = W.least_rows(df, order, n, top=50)
            assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in sorted(rows, key=key)[:n])
            assert got.columns == df.columns


def test_large_samples_come_from_no_single_task(spark):
    df = spark.range(20_000).withColumn("keyword", F.concat(F.lit("k"), F.col("id")))
    limit, W.TOP = W.TOP, 100
    try:
        for got in (W.sample_n(df, "keyword", 7_000, 5), W.weighted_pick(df, F.sqrt(F.col("id") + 1), 7_000, 5)):
            assert "SinglePartition" not in re.sub(r"TakeOrderedAndProject\(limit=\d{1,3},", "", _plan(got)) and got.count() == 7_000
    finally:
        W.TOP = limit


def test_samples_by_plain_sorting(spark):
    """The rows that sorting all hashes gives, few and many."""
    df = spark.range(3_000).withColumn("keyword", F.concat(F.lit("k"), F.col("id") % 2900))
    hashed = [(r.h, r.keyword, r.id) for r in df.select(F.xxhash64("keyword", F.lit(5)).alias("h"), "keyword", "id").collect()]
    limit = W.TOP
    try:
        for W.TOP in (limit, 70):
            assert sorted(r.keyword for r in W.sample_n(df, "keyword", 900, 5).collect()) == sorted(k for _, k, _ in sorted(hashed)[:900])
            drawn = sorted((-math.log((((h % 2**64) >> 11) + 0.5) / 2**53) / (math.sqrt(i + 1) * (10 if k.endswith("7") else 1)), k) for h, k, i in hashed)
            got = W.weighted_pick(df, F.sqrt(F.col("id") + 1), 900, 5, F.endswith("keyword", F.lit("7")))
            assert sorted(r.keyword for r in got.collect()) == sorted(k for _, k in drawn[:900])
    finally:
        W.TOP = limit


def test_expanded_keywords_keep_the_total(spark):
    kw = spark.createDataFrame([(f"w{i}", "google", 5, False) for i in range(300)] + [("w1 東京", "auto_expanded", 0, False)], "keyword string, source string, total_found int, is_archived boolean")
    limit, W.TOP = W.TOP, 50
    try:
        few = K.expand_keywords(kw, total=1_000).collect()
    finally:
        W.TOP = limit
    assert len(few) == 999 and {(r.keyword, r.base) for r in few} == {(r.keyword, r.base) for r in K.expand_keywords(kw, total=1_000).collect()}


def test_stretches_are_even_in_bursts(spark):
    """Most rows come in a minute of a year; windows over stretches say what windows over keys say."""
    random.seed(1)
    rows = [(i, random.choice([random.randint(0, 31_000_000), 15_000_000 + random.randint(0, 60), 15_000_000 + random.randint(0, 60)]), random.choice("aaab"), random.random() < 0.5) for i in range(6_000)]
    df = spark.createDataFrame(rows, "id long, ts long, source string, ok boolean")
    sizes = [r["count"] for r in W.in_stretches(df, ["ts", "id"], 500)[0].groupBy("_stretch").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = W.rolling_success(df, 30, 5, rows=500)
    assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got)
    one = {r.id: (r.seen, r.rate) for r in W.rolling_success(df, 30, 5).collect()}
    assert {r.id: (r.seen, r.rate) for r in got.collect()} == one
    number = {r.id: r.number for r in W.numbered(df, "source", ["ts", "id"], rows=500).collect()}
    assert number == {r.id: r.number for r in W.numbered(df, "source", ["ts", "id"]).collect()} and max(number.values()) == sum(r[2] == "a" for r in rows)


def test_evidence_on_a_portal(spark):
    """Many records and pages of one host meet only where a page says something; all pairs say the same."""
    random.seed(7)
    names = [f"株式会社{random.choice('山川田中')}{random.choice('東西南北')}{random.choice(['', '商事', '興業X'])}" for _ in range(80)] + ["株式会社", "", None, "A社"]
    phones = [f"03-{random.randint(1000, 1099)}-{random.randint(1000, 1009)}" for _ in range(80)] + ["090-1234-5678", "123", None, ""]
    rec = [(i, n, p, f"https://{random.choice(['portal.example', 'b.example', 'none.example'])}/x") for i, (n, p) in enumerate(zip(names, phones, strict=True))]
    pages = [(random.choice(["portal.example", "b.example"]), random.choice(["tokutei", "base"]), " ".join([str(random.choice(names)), "TEL", str(random.choice(phones)), str(random.choice(phones)), "A社"][: random.randint(0, 5)]), f"/{k % 9}") for k in range(60)] + [("portal.example", "base", None, "/n")]
    r = spark.createDataFrame(rec, "id long, company_name string, phone string, base_url string")
    p = spark.createDataFrame(pages, "host string, kind string, text string, path string")
    cores = {x.id: (x.c, x.d) for x in r.select("id", match.name_core(F.col("company_name")).alias("c"), match.digits(F.col("phone")).alias("d")).collect()}
    only = lambda t: re.sub(r"\D", "", t or "")
    want, found = set(), {}
    for i, _, _, url in rec:
        core, d = cores[i]
        own = [(h, k, t, path) for h, k, t, path in pages if h == url.split("/")[2]]
        hits = {(k, t): (bool(core) and core in (t or ""), len(d or "") >= 9 and d in only(t)) for _, k, t, _ in own}
        want |= {(i, k, *h) for (k, _), h in hits.items() if any(h)}
        said = {k for (k, _), h in hits.items() if any(h)}
        want |= {(i, k, False, False) for k in {k for _, k, _, _ in own} - said}
        found[i] = sorted({path for _, _, t, path in own if len(d or "") >= 9 and d in only(t)}) or None
    assert {tuple(x) for x in match.evidence(r, p).collect()} == want and len(want) > 40
    assert {x.id: x.found_in for x in match.phone_on_domain(r, p).collect()} == found


def test_work_of_evidence_grows_with_hits(spark):
    """A host of n records and n pages makes about n candidate rows, not n times n."""
    for n in (200, 800):
        r = spark.range(n).select("id", F.concat(F.lit("株式会社"), F.lpad(F.col("id").cast("string"), 8, "q")).alias("company_name"), F.concat(F.lit("0"), (F.col("id") * 7919 + 300000000).cast("string")).alias("phone"), F.lit("https://portal.example/").alias("base_url"))
        p = r.select(F.lit("portal.example").alias("host"), F.lit("base").alias("kind"), F.concat_ws(" ", "company_name", "phone").alias("text"))
        own = r.select("id", F.lit("portal.example").alias("host"), match.name_core(F.col("company_name")).alias("core"), match.digits(F.col("phone")).alias("d"))
        pages = p.select("host", F.xxhash64("text").alias("page"), "text")
        assert match._digit_hits(own, pages).count() == n and match._name_hits(own, pages).count() == n


def test_scratch_of_insert_or_ignore_is_removed(spark):
    import os

    folder = scratch.shared_folder(spark)
    before = set(os.listdir(folder))
    tag = uuid.uuid4().hex
    df = spark.createDataFrame([(1, tag), (2, tag)], "id int, k string")
    got, _ = dedupe.insert_or_ignore(df, df.limit(0), ["k"], "id")
    assert [r.id for r in got.collect()] == [1] and [f.split("-")[0] for f in set(os.listdir(folder)) - before] == ["accepted"]


def test_a_stored_index_follows_the_registry(spark, tmp_path):
    random.seed(4)
    kana = "アイウエオカキクケコ山川田中東西"
    rows = [(str(i), "".join(random.choice(kana) for _ in range(random.randint(2, 7))), random.choice(["東京都", None])) for i in range(300)]
    kind, path = "corp_number string, name string, pref string", f"{tmp_path}/index"
    names = spark.createDataFrame([(r[1][: random.randint(2, 5)],) for r in rows[:60]] + [("ない名前",), (None,), (rows[5][1],)], "name string")
    one = lambda df: sorted(tuple(r) for r in df.collect())
    registry = spark.createDataFrame(rows, kind)
    assert match.refresh_index(registry, path) == match.INDEX_BUCKETS and match.refresh_index(registry, path) == 0
    assert one(match.search_index(names, path)) == one(match.search_trigram(names, registry)) and one(match.verify_local(names, path)) == one(match.verify_local(names, registry))
    changed = spark.createDataFrame([(n, "山田" + m if n == "7" else m, p) for n, m, p in rows[3:]] + [("900", "川田中西東", None)], kind)
    assert 0 < match.refresh_index(changed, path) < 40
    found = match.search_index(names, path)
    assert one(found) == one(match.search_trigram(names, changed))
    few = match.search_index(names.filter(F.col("name") == rows[5][1]), path)
    for scan in re.findall(r"FileScan parquet [^\n]*path[^\n]*|FileScan parquet [^\n]*", _plan(few)):
        if "bucket" in scan:  # folders of the name's own pieces at most
            asked = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", scan)
            assert asked and len((asked[1] or asked[2]).split(",")) <= len(rows[5][1])
    assert "PartitionFilters" in _plan(few)
    assert match.refresh_index(changed.limit(0), path) > 0 and match.search_index(names, path).count() == 0
