"""Vector codes against SQL and a plain computation, the trie against all distances."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import queries, vectors

SF = "/root/testdata/sf0.001"


def _plain(rows, parts=4, entries=256, rounds=4):
    """{id: (code, error)} and codebooks of sound (id, vector) rows, by all distances and Python's integers."""
    cut = {i: [[int(c) for c in np.floor(np.array(v, np.float64) * 1024)][p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for i, v in rows}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, part: min(range(len(books[p])), key=lambda e: (far(part, books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = {}
            for c in cut.values():
                own.setdefault(nearest(p, c[p]), []).append(c[p])
            for e, ps in own.items():
                new[p][e] = [sum(x) // len(ps) for x in zip(*ps, strict=True)]
        books = new
    out = {}
    for i, c in cut.items():
        at = [nearest(p, c[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e in at), sum(far(c[p], books[p][at[p]]) for p in range(parts)))
    return out, books


@pytest.mark.parametrize("largest,block", [(2, 5), (3, 64), (900, 64), (1 << 39, 7)])
def test_trie_equals_all_distances(largest, block):
    rng, limit, vectors.BLOCK = np.random.default_rng(largest), vectors.BLOCK, block
    try:
        for dim in (1, 2, 5, 8):
            book = rng.integers(-largest, largest + 1, (9, dim))
            for x in (np.unique(rng.integers(-largest, largest + 1, (200, dim)), axis=0), rng.integers(-largest, largest + 1, (50, dim))):
                entry, far = vectors.PartTrie(book).walk(x)
                want = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in book] for r in x], object)
                assert entry.tolist() == want.argmin(1).tolist() and [int(v) for v in far] == [int(v) for v in want.min(1)]
    finally:
        vectors.BLOCK = limit


def test_op11_in_sql(spark):
    con = duckdb.connect()
    path = f"{SF}/embeddings.parquet"
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    rel = con.sql(queries.ORACLE_SQL["op11_vector_codes"])
    got = queries.QUERIES["op11_vector_codes"](spark, SF)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall())


def test_codes_by_a_plain_computation(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 1024]) for i in range(300)] + [(900, [1e30] * 8), (901, [-0.5, 0.0] * 4)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    odd = [(5000, None), (5001, [float("nan")] * 8), (5002, [1.0, None] * 4), (5003, [float("inf")] * 8)]
    other = [(6000, [1.0, 2.0]), (6001, [])]
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows + odd + other], "vec_id long, embedding array<double>, code string, uses string")
    books, dim = vectors.fitted(df, "embedding", "vec_id", entries=16)
    rows = [(i, v if i != 900 else [vectors.LARGEST / 1024] * 8) for i, v in rows]
    want, plain = _plain(rows, entries=16)
    got = {r.vec_id: (r.code, r.error) for r in vectors.coded(df.select("vec_id", "embedding"), books, dim, "embedding").collect()}
    assert books.tolist() == [list(map(list, b)) for b in plain] and dim == 8
    assert got == {i: (c, min(e, vectors._LONG)) for i, (c, e) in want.items()} | {i: (None, None) for i, _ in other}
    back = vectors.coded(df.select("vec_id", "embedding"), books, dim, "embedding").filter("vec_id = 3").select(vectors.decoded("code", books).alias("v")).first().v
    assert back == [x for p in range(4) for x in plain[p][int(want[3][0][2 * p : 2 * p + 2], 16)]]
    assert vectors.codebooks_sha256(books) == hashlib.sha256(",".join(str(x) for b in plain for e in b for x in e).encode()).hexdigest()


def test_codes_of_few_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0, 3.0], "x"), (1, [1.0, 2.0, 3.0], None), (1, [0.0, 0.0, 0.0], None)], "vec_id long, embedding array<float>, label string")
    books, dim = vectors.fitted(df, "embedding", "vec_id")
    assert dim == 3 and books.shape == (4, 3, 1)
    assert {(r.vec_id, r.error) for r in vectors.coded(df, books, dim, "embedding").collect()} == {(None, 0), (1, 0)}
    for none in (df.limit(0), df.withColumn("embedding", F.lit(None).cast("array<float>"))):
        books, dim = vectors.fitted(none, "embedding", "vec_id")
        assert dim == 0 and vectors.coded(none, books, dim, "embedding").count() == 0


def test_op11_over_odd_tables(spark, tmp_path):
    rows = [(1, [0.5] * 64, None), (2, [0.25] * 64, None), (2, [0.25] * 64, 7), (3, None, 7), (None, [0.75] * 64, 8)]
    for name, n in (("all", 5), ("none", 0)):
        spark.createDataFrame(rows[:n], "vec_id long, embedding array<float>, label int").withColumn("error", F.lit("clash")).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = queries.QUERIES["op11_vector_codes"](spark, f"{tmp_path}/{name}").collect()
        assert len(got) == (4 if n else 0) and all(r.error == 0 and r.label_error == 0 for r in got)
