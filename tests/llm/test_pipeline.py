"""The pipeline on planted cases: what must go goes, what is clean stays."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from leadmill.llm import common, neardup, queries

KEPT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    random.seed(11)
    words = [f"word{i}" for i in range(3000)]
    text = lambda n=120: " ".join(random.choice(words) for _ in range(n))
    item = text(40)
    docs = [(i, text()) for i in range(120)]
    bad = [(200 + i, " ".join(w + "###" for w in text().split())) for i in range(40)]
    rude = [(300 + i, text(50) + f" nasty{'abc'[i % 3]} nastyb you nastyc " + text(50)) for i in range(40)]
    copies = [(400, docs[0][1]), (401, docs[1][1] + " tail"), (402, docs[1][1])]
    leaked = [(500, text(30) + " " + item + " " + text(30))]
    short = [(600, "too short"), (601, None), (602, "")]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in [*docs, *bad, *rude, *copies, *leaked, *short]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, int(d < 200 or d >= 300), int(300 <= d < 400)) for d, *_ in rows if d < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == KEPT
        now.write.parquet(f"{tmp_path}/{len(seen)}")
        now = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    clean = {d for d, _ in docs}
    assert clean <= seen[0] and not seen[0] & ({d for d, _ in bad} | {600, 601, 602})
    assert clean <= seen[1] and len(seen[1] & {d for d, _ in rude}) <= 2
    assert clean <= seen[2] and not seen[2] & {400, 401, 402}
    assert clean <= seen[3] and 500 not in seen[3]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == seen[3] and all(r.n_tokens == len(r.ids) > 0 for r in out)


def test_stages_on_null_ids_repeats_and_empty_tables(spark, tmp_path):
    random.seed(14)
    text = lambda: " ".join(f"word{random.randrange(900)}" for _ in range(80))
    one = text()
    rows = [(1, one), (1, one), (1, text()), (None, text()), (None, one), (None, None), (2, "x y"), (3, one)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit(9)).withColumn("contaminated", F.lit("clash"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(one.split()[:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality rules"](spark, docs, str(tmp_path)).count() == 6
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == 8
    near = stages["minhash near-dedup"](spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text == one) for r in near) == [("1", False), ("1", True), ("2", False), ("None", False), ("None", False), ("None", True)]
    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect()
    assert all(one not in (r.text or "") for r in clean) and {r.doc_id for r in clean} >= {None, 2}
    assert stages["bpe encoding"](spark, docs, str(tmp_path)).count() == 8
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def test_what_is_exploded_is_not_broadcast_by_the_size_of_its_source(spark, monkeypatch):
    """Buckets of texts, 120 a text, are joined by shuffles however small Spark takes them for; all else where it was
    counted to be large."""
    random.seed(12)
    base = [f"b{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*base[:34], *random.sample([f"x{j}" for j in range(8)], 6)])) for i in range(60)], "doc_id long, text string")
    plans = []
    plain = neardup.written

    def watched(df, tag, under=None):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, tag, under)

    monkeypatch.setattr(neardup, "written", watched)
    monkeypatch.setattr(neardup, "SMALL", 2)
    found = lambda: sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, k=2).collect())
    want = found()
    assert [tag for tag, plan in plans if "Broadcast" in plan and tag == "members"] == []
    plans.clear()
    monkeypatch.setattr(common, "BROADCAST_IDS", -1)
    monkeypatch.setattr(common, "OWN_CHOICE", -1)
    monkeypatch.setattr(neardup, "OWN_CHOICE", -1)
    assert found() == want
    seen = {tag for tag, _ in plans}
    # what is left is joined with what Spark takes for the product of both sides
    assert seen >= {"members", "rare", "dealt"} and {tag for tag, plan in plans if "Broadcast" in plan} <= {"open", "components", "near-duplicates"}
    ids = spark.range(2)
    assert "Broadcast" not in spark.range(9).join(common.maybe_broadcast(ids), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
