"""The corpus pipeline: quality rules, toxicity, near-duplicate removal, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a frame that is written and
read again as the next one's docs; all but the last return the columns of documents.

Rejected: documents that fail the base or meet a learned rule; those with a toxicity score of 0.5 or more; all but the
one of least doc_id of each group of near copies (five-word shingles, similarity 0.8 or more; of rows of that group which
repeat the id one stays, rows of other texts that repeat it stay); those that the benchmark contaminates, with all rows
of their id. A null doc_id is a document without copies. Null and empty texts fail the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadmill.llm import bpe, decontaminate, neardup, quality, toxicity
from leadmill.llm.common import dropped, maybe_broadcast, shared_folder, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.learned_rules(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return docs.select(COLUMNS).filter(quality.judgement(F.col("text"), rules)["kept"])


def toxic_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.trained(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return docs.select(*COLUMNS, toxicity.scorer(spark, model)(F.col("text"))["score"].alias("_score")).filter("_score < 0.5").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("_t"))
    found = neardup.near_duplicates(hashed.select("doc_id", "text", "_t"), k=5, keep=("_t",))
    # rows that repeat the id that stays are copies too, if they are of its component: the one of least hash stays
    stays = found.filter("doc_id = component_id and component is not null").groupBy("doc_id", "component").agg(F.min("_t").alias("_stays"), F.count("*").alias("_n"))
    again = written(stays.filter("_n > 1"), "repeated")
    gone = found.filter("doc_id <> component_id").select("doc_id", "_t")
    if not again.limit(1).count():
        gone = written(gone.distinct(), "dropped")
        return hashed.join(maybe_broadcast(gone), ["doc_id", "_t"], "left_anti").select(COLUMNS)
    other = found.join(maybe_broadcast(again), ["doc_id", "component"]).filter("_t <> _stays").select("doc_id", "_t")
    gone = written(gone.union(other).distinct(), "dropped")
    kept = hashed.join(maybe_broadcast(gone), ["doc_id", "_t"], "left_anti")
    same = again.select("doc_id", F.col("_stays").alias("_t")).distinct()
    one = kept.join(maybe_broadcast(same), ["doc_id", "_t"], "left_semi").groupBy("doc_id", "_t").agg(*[F.first(c).alias(c) for c in COLUMNS[1:]])
    return kept.join(maybe_broadcast(same), ["doc_id", "_t"], "left_anti").select(COLUMNS).unionByName(one.select(COLUMNS))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    named, nameless = docs.select(COLUMNS).filter("doc_id is not null"), docs.select(COLUMNS).filter("doc_id is null")
    # ids instead of texts go through the shuffle
    bad = written(decontaminate.contamination(named.select("doc_id", "text"), items, keep=["doc_id"]).filter("contaminated").select("doc_id").distinct(), "contaminated")
    kept = named.join(maybe_broadcast(bad), "doc_id", "left_anti")
    return kept.select(COLUMNS).unionByName(decontaminate.contamination(nameless, items).filter("not contaminated").select(COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.with_text(bpe.with_ids(docs.select("doc_id", "text")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_passages),
    ("minhash near-dedup", near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("bpe encoding", encoded),
]

#: Learned rules, model scores and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage written to the shared folder before the next reads it; what a later stage's output
    replaces is removed."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}")
        if k:
            dropped(spark, f"{base}/{k - 1}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
