"""A stream worked off at once agrees with the table; order within a key is kept."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadmill.streaming import alerts as R, flush

SCHEMA = "ts TIMESTAMP, source STRING, kind STRING, n INT, ok BOOLEAN"
START = datetime(2024, 1, 1)


def _files(path, rows):
    os.makedirs(path)
    with open(f"{path}/a.json", "w") as f:
        for minute, source, kind, n, ok in rows:
            f.write(json.dumps({"ts": (START + timedelta(minutes=minute)).isoformat(), "source": source, "kind": kind, "n": n, "ok": ok}) + "\n")


def _run(spark, df, tmp, mode="append"):
    name = f"t{abs(hash(str(tmp)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_zero_yield(spark, tmp_path):
    rows = [(i, "yahoo", "search", 0, False) for i in range(12)] + [(i, "google", "search", i % 2, True) for i in range(12)] + [(600, "yahoo", "search", 1, True)]
    _files(f"{tmp_path}/in", rows)
    table = R.zero_yield_alerts(spark.read.schema(SCHEMA).json(f"{tmp_path}/in")).collect()
    stream = _run(spark, R.zero_yield_alerts(spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in")), tmp_path)
    assert {r.source for r in table} == {"yahoo"}
    assert {(r.ts, r.tries) for r in stream} == {(r.ts, r.tries) for r in table}


def _cut(spark, tmp, rows, schema, pieces, build, name):
    """The rows as a stream of so many files, one a batch, in the order given; then a row far ahead, which lets the watermark
    pass all others."""
    os.makedirs(f"{tmp}/{name}")
    step = -(-len(rows) // pieces)
    for k in range(0, len(rows), step):
        with open(f"{tmp}/{name}/{k:06d}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows[k : k + step])
        os.utime(f"{tmp}/{name}/{k:06d}.json", (k + 1, k + 1))
    return build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp}/{name}"))


def _collected(spark, df, tmp, name):
    out = _run(spark, df, f"{tmp}/{name}-out")
    return sorted((r.ts, r.source, r.problem, r.severity, r.value) for r in out)


def _late(rows, minutes, seed):
    """The rows in an order in which each comes at most so many minutes behind one that is later."""
    random.seed(seed)
    return sorted(rows, key=lambda r: datetime.fromisoformat(r["ts"]).timestamp() + random.random() * minutes * 60)


IDS = "id LONG, " + SCHEMA
TAIL = {"ts": (START + timedelta(days=300)).isoformat(), "source": "tail", "id": 10**6}


@pytest.mark.parametrize("kind,build", [("search", lambda d: R.failure_streak_alerts(d, 3)), ("extract", lambda d: R.low_success_alerts(d, 10, 0.3)), ("beat", lambda d: R.silence_alerts(d, 240))])
def test_any_cut_into_batches_tells_what_the_table_tells(spark, tmp_path, kind, build):
    random.seed(kind)
    rows = [{"id": i, "ts": (START + timedelta(seconds=40 * random.randint(0, 500))).isoformat(), "source": random.choice("ab"), "kind": kind, "n": 0, "ok": random.random() < 0.35} for i in range(240)]
    tail = {**TAIL, "kind": kind, "n": 0, "ok": True}
    names = [f.name for f in spark.createDataFrame([], IDS).schema]
    table = spark.createDataFrame([tuple(datetime.fromisoformat(r[c]) if c == "ts" else r[c] for c in names) for r in [*rows, tail]], IDS)
    want = sorted((r.ts, r.source, r.problem, r.severity, r.value) for r in build(table).collect())
    assert len(want) > 3
    for seed, pieces in ((1, 1), (2, 5)):
        stream = _cut(spark, tmp_path, [*_late(rows, 9, seed), tail], IDS, pieces, build, f"cut{pieces}")
        assert _collected(spark, stream, tmp_path, f"cut{pieces}") == want


def test_suppressed_alerts_in_any_cut(spark, tmp_path):
    random.seed(9)
    kinds = "ts TIMESTAMP, source STRING, problem STRING, severity STRING, value DOUBLE, hours DOUBLE, repair BOOLEAN"
    rows = []
    for _ in range(150):
        ts = (START + timedelta(minutes=5 * random.randint(0, 200))).isoformat()
        repair = random.random() < 0.15
        rows.append({"ts": ts, "source": "" if repair else random.choice("ab"), "problem": random.choice("pq"), "severity": "warning", "value": 1.0, "hours": random.choice([None, 0.5, 3.0]) if repair else None, "repair": repair})
    tail = {"ts": TAIL["ts"], "source": "tail", "problem": "tail", "severity": "warning", "value": 1.0, "hours": None, "repair": False}
    build = lambda d: R.suppress(d.filter("not repair"), d.filter("repair"), 1)
    names = [f.name for f in spark.createDataFrame([], kinds).schema]
    table = spark.createDataFrame([tuple(datetime.fromisoformat(r[c]) if c == "ts" else r[c] for c in names) for r in [*rows, tail]], kinds)
    want = sorted((r.ts, r.source, r.problem, r.severity, r.value) for r in build(table).collect() if r.source != "tail")
    assert 20 < len(want) < 140
    for seed, pieces in ((1, 1), (2, 5)):
        stream = _cut(spark, tmp_path, [*_late(rows, 9, seed), tail], kinds, pieces, build, f"cut{pieces}")
        assert _collected(spark, stream, tmp_path, f"cut{pieces}") == want


def test_rows_of_a_flush(spark, tmp_path):
    """Flushes by number and by time; what waits when a run ends goes with the next one."""
    kind, out = "sheet STRING, row INT", f"{tmp_path}/out"
    os.makedirs(f"{tmp_path}/in")

    def put(name, rows):
        with open(f"{tmp_path}/in/{name}.tmp", "w") as f:
            f.writelines(json.dumps({"sheet": s, "row": n}) + "\n" for s, n in rows)
        os.rename(f"{tmp_path}/in/{name}.tmp", f"{tmp_path}/in/{name}.json")

    def start(**trigger):
        df = flush.flushed(spark.readStream.schema(kind).json(f"{tmp_path}/in"), "sheet", 50, 3)
        return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(**trigger).start()

    put("a", [("s", i) for i in range(120)] + [("t", i) for i in range(7)])
    q = start(processingTime="1 second")
    for _ in range(60):
        time.sleep(0.5)
        if os.path.isdir(f"{out}/_spark_metadata") and spark.read.parquet(out).count() >= 100:
            break
    q.stop()
    assert q.exception() is None
    got = spark.read.parquet(out)
    by = {(r.sheet, r.flush, r.cause): r["count"] for r in got.groupBy("sheet", "flush", "cause").count().collect()}
    assert by[("s", 1, "rows")] == by[("s", 2, "rows")] == 50 and set(by) <= {("s", 1, "rows"), ("s", 2, "rows"), ("s", 3, "time"), ("t", 1, "time")}
    put("b", [("s", i) for i in range(120, 125)])
    q = start(processingTime="1 second")
    for _ in range(60):
        time.sleep(1)
        if spark.read.parquet(out).count() == 132:
            break
    q.stop()
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted((s, n) for s, n, *_ in got) == sorted([("s", i) for i in range(125)] + [("t", i) for i in range(7)])  # none lost, none twice
    assert {(s, f, c) for s, _, f, c in got} >= {("s", 1, "rows"), ("s", 2, "rows"), ("s", 3, "time"), ("t", 1, "time")}


def test_flush_groups(spark):
    rows = spark.createDataFrame([(k % 3, n) for n in range(130) for k in range(3)], "sheet int, n int")
    assert {(r.sheet, r.n): r.flush for r in flush.flush_groups(rows, "sheet", ["n"]).collect()} == {(k, n): n // 50 + 1 for n in range(130) for k in range(3)}


def test_live_sightings(spark):
    rows = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "a")], "lp_url string, source string")
    assert {r.lp_url: r["rank"] for r in R.live_sightings(rows).collect()} == {"u": "A", "v": "C"}
    assert R.hourly_stats(spark.createDataFrame([(START, "a", "search", 0, True)], SCHEMA)).select(F.col("zero_rate")).first()[0] == 1.0
