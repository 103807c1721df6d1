"""SimHash near duplicates against all pairs."""

import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from leadmill.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def _fingerprint(t, k=3):
    t = "".join(c.lower() if c.isascii() else c for c in t or "")
    w = [x for x in re.split("[\\x20\\x09-\\x0D]+", t) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(prints, links):
    above = {p: p for p in prints}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        above[top(a)] = top(b)
    return {p: top(p) for p in above}


def _expected(rows, radius=2):
    """(id, hex, component) of (id, fingerprint) rows, by all pairs."""
    prints = {p for _, p in rows}
    top = _groups(prints, [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= radius])
    least = {}
    for i, p in rows:
        if i is not None:
            least[top[p]] = min(least.get(top[p], i), i)
    return sorted([(i, f"{p:016x}", least.get(top[p])) for i, p in rows], key=str)


def test_masks_cover():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        assert all(any(not any(m >> p & 1 for p in places) for m in masks) for places in combinations(range(64), radius))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_of_dense_fingerprints(spark, radius):
    random.seed(radius)
    prints = {0}
    for base in [random.getrandbits(64) for _ in range(3)]:
        for _ in range(120):
            x = base
            for _ in range(random.randint(0, 7)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    want = _groups(prints, [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= radius])
    classes = lambda top: {frozenset(p for p in prints if top[p] == t) for t in set(top.values())}
    limit = simhash.SMALL
    try:
        for simhash.SMALL in (2, limit):  # large buckets by points, or pairs too
            links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, radius).collect()]
            assert all(0 < (a ^ b).bit_count() <= radius for a, b in links) and classes(_groups(prints, links)) == classes(want)
    finally:
        simhash.SMALL = limit


def test_op12(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_simhash"](spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == _expected([(d, _fingerprint(t)) for d, t in docs])


def test_odd_texts(spark):
    random.seed(5)
    long = " ".join(random.choice("abcdefgh") * random.randint(1, 3) for _ in range(90_000))
    texts = [(1, None), (2, ""), (3, "  \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE two three"), (8, "É one\ttwo\x0bthree"), (9, long), (9, long + " x"), (None, "one two"), (None, "only here without id")]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in texts], "doc_id long, text string, print long, component_id string")
    got = simhash.near_duplicates(df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == _expected([(i, _fingerprint(t)) for i, t in texts])
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.withColumn("text", F.lit(None).cast("string"))).select("component_id").distinct().count() == 1
