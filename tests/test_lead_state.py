"""The lead stream's state: any cut into batches gives what one batch gives, a batch may run again, little is read."""

import os
import random
from datetime import datetime, timedelta

import pytest

from leadmill.sources.readers import LEAD
from leadmill.streaming import leads as L


@pytest.fixture
def dims(spark):
    return {
        "not_landing": spark.createDataFrame([("bit.ly",)], "host string"), "blocked": spark.createDataFrame([("blocked.example",)], "host string"), "suffixes": spark.createDataFrame([("com",)], "suffix string"),
        "facts": spark.createDataFrame([], "lp_url string, company_name string, phone string, phone_source string, corporate_number string"),
    }


def _leads(n, seed):
    random.seed(seed)
    at = datetime(2024, 1, 1)
    kanji = "山川田中東西南北上下"
    return [(f"https://{random.choice('abcdefghij')}{random.randint(0, 9)}.com/lp", random.choice(["Google", "Yahoo", "Meta"]), "k", "株式会社" + random.choice(kanji) + random.choice(kanji), None, f"035555{random.randint(1000, 1040)}", at + timedelta(minutes=i)) for i in range(n)]


def _state(spark, out, number):
    return sorted((r.normalized_name, r.base_url, r.phone, r.seen_count, tuple(r.ad_sources), r["rank"]) for r in L.known_companies(spark, out, number).collect())


def _plain(rows):
    """One lead after the other."""
    known = []
    for url, source, _, name, _, phone, _ in rows:
        core, base, phone = name.removeprefix("株式会社"), url.split("/")[2], f"{phone[:2]}-{phone[2:6]}-{phone[6:]}"
        if any(c["name"] == core or c["base"] == base for c in known):
            met = next((c for c in known if c["phone"] == phone), None) or next((c for c in known if c["base"] == base), None)
            if met:
                met["seen"] += 1
                met["sources"].add(source)
        else:
            known.append({"name": core, "base": base, "phone": phone, "seen": 1, "sources": {source}})
    return sorted((c["name"], c["base"], c["phone"], c["seen"], tuple(sorted(c["sources"]))) for c in known)


def test_batches_of_one_lead_are_the_plain_model(spark, dims, tmp_path, monkeypatch):
    """With whole rewrites on the way, whose earlier folders go."""
    monkeypatch.setattr(L, "COMPACT", 4)
    rows, out = _leads(9, 3), f"{tmp_path}/out"
    for k, r in enumerate(rows):
        L.write_batch(spark.createDataFrame([r], LEAD), k, dims, out)
    assert [x[:5] for x in _state(spark, out, len(rows))] == _plain(rows)
    assert sorted(int(f) for f in os.listdir(f"{out}/companies")) == [7, 8]


def test_a_batch_may_run_again_and_reads_little(spark, dims, tmp_path):
    out, folder = f"{tmp_path}/out", spark.conf.get("spark.checkpoint.dir")
    L.write_batch(spark.createDataFrame(_leads(150, 5), LEAD), 0, dims, out)
    one = _state(spark, out, 1)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    again = spark.createDataFrame(_leads(3, 6), LEAD)
    L.write_batch(again, 1, dims, out)
    two = _state(spark, out, 2)
    L.write_batch(again, 1, dims, out)
    assert _state(spark, out, 2) == two != one and _state(spark, out, 1) == one
    assert set(os.listdir(folder)) <= before  # nothing is left on the way
    with L.scope(spark):
        rows = L.candidates(again, dims)
        plan = L.companies_met(rows, out, 1)._jdf.queryExecution().executedPlan().toString()
        met = L.companies_met(rows, out, 1).count()
    scan = next(x for x in plan.split("PartitionFilters: [")[1:] if "bucket" in x.split("]")[0]).split("]")[0]
    assert 0 < met < len(one) and len(scan.split("IN (")[1].split(")")[0].split(",")) <= met if "IN (" in scan else met
