"""The queries as registered, on the smallest tables, against brute force or DuckDB."""

import hashlib
import html as entities
import math
import os
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_llm_operators import _components, _contaminated
from tokenizers import Tokenizer

from leadmill.llm import lm, quality, queries, toxicity
from leadmill.llm.urls import OP2_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def query(spark, n):
    return queries.QUERIES[next(k for k in queries.QUERIES if k.startswith(f"op{n}_"))](spark, SF)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op1(spark, docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, query(spark, 1).collect())) == sorted(want)


@pytest.mark.parametrize("n", [2, 3])
def test_in_sql(spark, n):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    rel = con.sql(queries.ORACLE_SQL[next(k for k in queries.ORACLE_SQL if k.startswith(f"op{n}_"))])
    got = query(spark, n)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall()) and OP2_SQL


def test_op3_by_brute_force(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(d, n, hit, len(found), sha(",".join(found)), bad) for d, n, hit, found, bad in _contaminated(docs, items)]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in query(spark, 3).collect()) == sorted(want)


def test_op4(spark, docs):
    library, at, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for d, t in sorted(docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, query(spark, 4).collect())) == want


def _space_words(t):
    return [w for w in re.split("[\\x20\\x09-\\x0D]+", t or "") if w]


def test_op5(spark, docs):
    got = {r.doc_id: r for r in query(spark, 5).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        ws, g = _space_words(t), got[d]
        win = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        covered = {k + j for k in range(len(ws) - 2) if win[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if _space_words(x)]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws)) and g.kept == (not g.base_failed and g.rule is None)


def test_op6(spark, docs):
    want = _components([(d, "".join(c.lower() if c.isascii() else c for c in t or "")) for d, t in docs], 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in query(spark, 6).collect()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in query(spark, 6).collect())


def _naive_score(model, t):
    """All maximal segments by their definition: the best one, then the same on both sides of it."""
    words = re.findall(r"[^\W\d_]+", (t or "").lower())
    found = []

    def split(s):
        best, low, at = (0.0, 0, 0), (0.0, 0), 0.0
        for i, x in enumerate(s):
            at += x
            if at - low[0] > best[0] + 1e-12:
                best = (at - low[0], low[1], i + 1)
            if at < low[0]:
                low = (at, i + 1)
        if best[0] > 0:
            found.append(best[0])
            split(s[: best[1]])
            split(s[best[2] :])

    split([model.word_score(w) for w in words])
    return model.probability(*model.evidence(len(words), found))


def test_op7(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.trained(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in query(spark, 7).collect()}
    for d, t in docs:
        r = got[d]
        assert r.held_out == toxicity.crc_held_out(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert abs(r.score - _naive_score(model, t)) < 1e-9


def test_op8(spark, docs):
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    cut = {d: ["", *lm.tokens(t)] for d, t in docs}
    counts = {d: (Counter(zip(c, c[1:], strict=False)), Counter(c[:-1]), Counter(c[1:])) for d, c in cut.items()}
    models = []
    for ds in (good & set(cut), set(cut)):
        models.append((ds, [sum((counts[d][k] for d in ds), Counter()) for k in range(3)]))
    vocabulary = len(models[1][1][2])
    got = {r.doc_id: r for r in query(spark, 8).collect()}
    for d, c in cut.items():
        losses = []
        for ds, (pair, left, word) in models:
            own = counts[d] if d in ds else (Counter(), Counter(), Counter())
            total = sum(word.values()) - sum(own[2].values())
            seen = len(word) - sum(word[w] == n for w, n in own[2].items())
            out = []
            for a, b in zip(c, c[1:], strict=False):
                p, n, w = pair[a, b] - own[0][a, b], left[a] - own[1][a], word[b] - own[2][b]
                unigram = (max(w - 0.75, 0) + 0.75 * seen / vocabulary) / total if total else 1 / vocabulary
                back = 0.75 * min(1, 8 / math.sqrt(n)) if n else 1.0
                out.append(-math.log((1 - back) * max(p - 0.75, 0) / max(n, 1) + back * unigram))
            losses.append(sum(out) / len(out) if out else None)
        r = got[d]
        assert r.n_tokens == len(c) - 1
        if losses[0] is not None:
            assert abs(r.target_loss - losses[0]) < 1e-8 and abs(r.background_loss - losses[1]) < 1e-8 and abs(r.score - (losses[0] - losses[1])) < 1e-8


def test_op9(spark, docs):
    rows = query(spark, 9).collect()
    texts = dict(docs)
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 16)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(0 <= s < 16 and sorted(slots) == list(range(len(slots))) for s, slots in by.items())


def test_op10(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in query(spark, 10).collect():
        page = pages[r.page_id]
        article = re.search(r"<article>(.*?)</article>", page.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1|h2|h3|li|ul|ol|div|blockquote)\b[^>]*>", re.sub(r"<!--.*?-->", "", article[1], flags=re.S)) if article else []
        said = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
        assert (r.text, r.n_chars, r.url) == ("\n\n".join(filter(None, said)), len(r.text), page.url)


def test_pipeline_by_brute_force(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = dict(docs)

    def frame():
        return table.filter(F.col("doc_id").isin(list(now))).select("doc_id", "text")

    rules = quality.learned_rules(frame(), labels.select("doc_id", "quality"))
    kept = {r.doc_id for r in frame().select("doc_id", quality.judgement(F.col("text"), rules)["kept"].alias("k")).filter("k").collect()}
    now = {d: t for d, t in now.items() if d in kept}
    model = toxicity.trained(frame(), labels.select("doc_id", "toxic"))
    now = {d: t for d, t in now.items() if _naive_score(model, t) < 0.5}
    groups = _components([(d, "".join(c.lower() if c.isascii() else c for c in t or "")) for d, t in now.items()], 5, 80)
    now = {d: t for d, t in now.items() if groups[d][1] == d}
    bad = {d for d, *_, hit in _contaminated(list(now.items()), items) if hit}
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in now.items() if d not in bad}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and all(r.decoded_sha256 == sha(now[r.doc_id]) for r in got)
