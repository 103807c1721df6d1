"""Streams: lead pipeline, alerts over telemetry, live sightings.

telemetry(ts, source, kind, n, ok); event time and a watermark bound the state. Windowed and grouped ones are plain
DataFrame work on a stream or a table; the four that need order within a key use stateful processors, which hold rows back
until the watermark has passed them and so tell the same however the rows are cut into batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadmill.functions.text import calc_rank
from leadmill.operators.windows import STRETCH, runs, with_rows_before

#: Late events are waited for so long.
LATENESS = "10 minutes"


def _timed(df: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Event time as a timestamp; a watermark on streams."""
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", lateness) if df.isStreaming else df


def zero_yield_alerts(tele: DataFrame, min_tries: int = 10) -> DataFrame:
    """Sources with so many search tries within an hour and nothing found: critical."""
    g = _timed(tele.filter("kind = 'search'")).groupBy(F.window("ts", "1 hour", "5 minutes"), "source").agg(F.count(F.lit(1)).alias("tries"), F.sum("n").alias("found"))
    return g.filter((F.col("tries") >= min_tries) & (F.col("found") == 0)).select(F.col("window.end").alias("ts"), "source", F.lit("zero_yield").alias("problem"), F.lit("critical").alias("severity"), "tries")


def error_burst_alerts(tele: DataFrame, n: int = 5) -> DataFrame:
    g = _timed(tele.filter("kind = 'write' and not ok")).groupBy(F.window("ts", "1 hour", "5 minutes"), "source").agg(F.count(F.lit(1)).alias("errors"))
    return g.filter(F.col("errors") >= n).select(F.col("window.end").alias("ts"), "source", F.lit("write_errors").alias("problem"), F.lit("warning").alias("severity"), "errors")


def hourly_stats(tele: DataFrame) -> DataFrame:
    """(window, source, tries, zero_rate, extraction_rate) by hour."""
    search, extract = F.col("kind") == "search", F.col("kind") == "extract"
    g = _timed(tele).groupBy(F.window("ts", "1 hour"), "source")
    share = lambda a, b: F.coalesce(F.try_divide(F.count_if(a).cast("double"), F.count_if(b)), F.lit(0.0))
    return g.agg(F.count_if(search).alias("tries"), share(search & (F.col("n") == 0), search).alias("zero_rate"), share(extract & F.col("ok"), extract).alias("extraction_rate"))


def live_sightings(leads: DataFrame, key: str = "lp_url", source: str = "source", horizon: str = "30 days") -> DataFrame:
    """(key, seen_count, sources, rank), brought up to date with each batch (update mode). On a stream sightings count within
    a horizon of event time (`window` tells which), and the state of a horizon that the watermark has passed is dropped."""
    timed = _timed(leads).groupBy(F.window("ts", horizon), key) if leads.isStreaming else leads.groupBy(key)
    g = timed.agg(F.count(F.lit(1)).cast("int").alias("seen_count"), F.array_sort(F.collect_set(source)).alias("sources"))
    return g.withColumn("rank", calc_rank(F.col("seen_count"), F.col("sources")))


class _Ordered(StatefulProcessor):
    """Applies a key's rows in order of event time, whatever batches they come in: rows wait until the watermark has passed
    them, when none before them can come any more. Rows of one time go by their tie. A row that comes after the watermark
    has passed it is left out, as Spark's own late rows are. Waiting rows are those of the lateness alone."""

    #: Columns that `apply` is given, as a dictionary.
    columns: tuple[str, ...] = ("ok",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, tie string, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = []
        for b in (b for b in rows if len(b)):
            said = b[list(self.columns)].to_json(orient="records", lines=True).splitlines() if self.columns else ["{}"] * len(b)
            new += [x for x in zip(b["at_us"].astype("int64").tolist(), b["at_tie"].astype(str).tolist(), said, strict=True) if x[0] > passed]
        if new:
            self.waiting.appendList(new)
            self._wake(min(x[0] for x in new))
        yield _alerts([], key)

    def _wake(self, us: int) -> None:
        """Asks for a call when the watermark has passed a time, unless one comes before."""
        at = -(-us // 1000)
        if not any(t <= at for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        self.start()
        out = [x for us, _, said in due for x in self.apply(us, json.loads(said))]
        out += self.end(passed)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self._wake(rest[0][0])
        yield _alerts(out, key)

    def start(self) -> None:
        """Reads the state."""

    def apply(self, us: int, row: dict) -> list[tuple]:
        """Takes in one row; alerts as (us, source or None for the key, problem or None for the key, severity, value)."""
        raise NotImplementedError

    def end(self, passed: int) -> list[tuple]:
        """Writes the state; what follows from the watermark alone."""
        return []

    def close(self) -> None:
        pass


def _alerts(rows: list[tuple], key: tuple) -> pd.DataFrame:
    return pd.DataFrame([(us, key[0] if source is None else source, key[0] if problem is None else problem, severity, value) for us, source, problem, severity, value in rows], columns=["us", "source", "problem", "severity", "value"]).astype({"us": "int64", "value": "float64"})


class LowSuccess(_Ordered):
    """Tells when the success rate of the last n events falls below a share, at least half of n being known."""

    def __init__(self, n: int = 100, share: float = 0.10):
        self.n, self.share = n, share

    def init(self, handle):
        super().init(handle)
        self.last = handle.getListState("last", "ok boolean")
        self.low = handle.getValueState("low", "low boolean")

    def start(self):
        self.own = [bool(r[0]) for r in self.last.get()] if self.last.exists() else []
        self.was = bool(self.low.get()[0]) if self.low.exists() else False

    def apply(self, us, row):
        self.own = [*self.own, bool(row["ok"])][-self.n :]
        rate = sum(self.own) / len(self.own)
        now = len(self.own) >= self.n // 2 and rate < self.share
        told = [(us, None, "low_success", "warning", rate)] if now and not self.was else []
        self.was = now
        return told

    def end(self, passed):
        if self.own:
            self.last.put([(x,) for x in self.own])
        self.low.update((self.was,))
        return []


class FailureStreak(_Ordered):
    """Tells when so many failures follow one another; a success sets the count back."""

    def __init__(self, n: int = 5):
        self.n = n

    def init(self, handle):
        super().init(handle)
        self.run = handle.getValueState("run", "n int")

    def start(self):
        self.count = int(self.run.get()[0]) if self.run.exists() else 0

    def apply(self, us, row):
        self.count = 0 if row["ok"] else self.count + 1
        return [(us, None, "failure_streak", "critical", float(self.count))] if self.count == self.n else []

    def end(self, passed):
        self.run.update((self.count,))
        return []


class Suppress(_Ordered):
    """Lets an alert through unless its problem is quiet: for some hours after a repair, or as long as a failed repair
    says; quiet times are only ever extended. Rows: kind alert or repair, value the hours of a failed repair. A repair at
    an alert's own time comes first."""

    columns = ("kind", "source", "severity", "value")

    def __init__(self, hours: float = 2):
        self.hours = hours

    def init(self, handle):
        super().init(handle)
        self.until = handle.getValueState("until", "us long")

    def start(self):
        self.quiet = int(self.until.get()[0]) if self.until.exists() else 0

    def apply(self, us, row):
        if row["kind"] == "repair":
            hours = self.hours if row["value"] is None else float(row["value"])
            self.quiet = max(self.quiet, us + round(hours * 3_600_000_000))
            return []
        return [(us, row["source"], None, row["severity"], row["value"])] if us >= self.quiet else []

    def end(self, passed):
        self.until.update((self.quiet,))
        return []


class Silence(_Ordered):
    """Tells when no heartbeat came for so many seconds of event time, once a silence."""

    columns = ()

    def __init__(self, seconds: int = 300):
        self.seconds = seconds

    def init(self, handle):
        super().init(handle)
        self.seen = handle.getValueState("seen", "us long, told boolean")

    def start(self):
        self.last, self.told = self.seen.get() if self.seen.exists() else (None, False)

    def _told(self):
        return (self.last + self.seconds * 1_000_000, None, "silence", "critical", float(self.seconds))

    def apply(self, us, row):
        out = [self._told()] if self.last is not None and us - self.last > self.seconds * 1_000_000 and not self.told else []
        self.last, self.told = us, False
        return out

    def end(self, passed):
        out = []
        if self.last is not None and not self.told:
            if passed - self.last >= self.seconds * 1_000_000:
                out, self.told = [self._told()], True
            else:
                self._wake(self.last + self.seconds * 1_000_000)
        if self.last is not None:
            self.seen.update((self.last, self.told))
        return out


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERT = "us long, source string, problem string, severity string, value double"


def needs_rocks(spark) -> None:
    """Stateful processors need the RocksDB state store; it is the session's to set."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")


def _stateful(df: DataFrame, key: str, processor: _Ordered, tie: Column | None = None) -> DataFrame:
    needs_rocks(df.sparkSession)
    timed = _timed(df).withColumn("at_us", F.unix_micros("ts"))
    timed = timed.withColumn("at_tie", tie if tie is not None else F.lpad(F.col("id").cast("string"), 20, "0") if "id" in df.columns else F.lit(""))
    out = timed.groupBy(key).transformWithStateInPandas(processor, ALERT, "append", "EventTime")
    return out.select(F.timestamp_micros("us").alias("ts"), "source", "problem", "severity", "value")


def _in_order(tele: DataFrame) -> list[str]:
    return ["ts", "id"] if "id" in tele.columns else ["ts"]


def _told(rows: DataFrame, problem: str, severity: str, value) -> DataFrame:
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), "source", F.lit(problem).alias("problem"), F.lit(severity).alias("severity"), value.cast("double").alias("value"))


def low_success_alerts(tele: DataFrame, n: int = 100, share: float = 0.10, rows: int = STRETCH) -> DataFrame:
    """On a table windows say the same as the processor on a stream."""
    own = tele.filter("kind = 'extract'")
    if own.isStreaming:
        return _stateful(own, "source", LowSuccess(n, share))
    order = W.partitionBy("source", "_stretch").orderBy(*_in_order(own))
    last = order.rowsBetween(-(n - 1), 0)
    # one row more than a window has: the last carried row's own rate is needed too
    rated = with_rows_before(own, "source", _in_order(own), n, rows).withColumn("_rate", F.avg(F.col("ok").cast("double")).over(last)).withColumn("_low", (F.count(F.lit(1)).over(last) >= n // 2) & (F.col("_rate") < share))
    first = rated.withColumn("_was", F.lag("_low", 1, False).over(order)).filter("_low and not _was and not _carried")
    return _told(first, "low_success", "warning", F.col("_rate"))


def failure_streak_alerts(tele: DataFrame, n: int = 5, rows: int = STRETCH) -> DataFrame:
    own = tele.filter("kind = 'search'")
    if own.isStreaming:
        return _stateful(own, "source", FailureStreak(n))
    return _told(runs(own, ~F.col("ok"), "source", _in_order(own), "_failures", rows).filter(F.col("_failures") == n), "failure_streak", "critical", F.col("_failures"))


def suppress(alerts: DataFrame, repairs: DataFrame, hours: float = 2) -> DataFrame:
    """alerts(ts, source, problem, severity, value) and repairs(ts, problem, hours) in one stream by problem; on tables
    repairs meet the alerts of the hours that they quiet. A repair at an alert's own time quiets it."""
    if not alerts.isStreaming and not repairs.isStreaming:
        hour = lambda c: F.floor(c.cast("double") / 3600)
        begin = F.col("ts").cast("timestamp")
        quiet = repairs.select(F.col("problem").alias("_problem"), begin.alias("_from"), (begin.cast("double") + F.coalesce("hours", F.lit(hours)) * 3600).alias("_until"))
        quiet = quiet.withColumn("_hour", F.explode(F.sequence(hour(F.col("_from")), F.floor(F.col("_until") / 3600))))
        at = F.col("ts").cast("timestamp")
        met = (F.col("problem") == F.col("_problem")) & (hour(at) == F.col("_hour")) & (at >= F.col("_from")) & (at.cast("double") < F.col("_until"))
        return alerts.join(quiet, met, "left_anti").select(at.alias("ts"), "source", "problem", "severity", F.col("value").cast("double").alias("value"))
    a = alerts.select("ts", "source", "problem", "severity", F.col("value").cast("double").alias("value"), F.lit("alert").alias("kind"))
    r = repairs.select("ts", F.lit("").alias("source"), "problem", F.lit("").alias("severity"), F.col("hours").cast("double").alias("value"), F.lit("repair").alias("kind"))
    return _stateful(a.unionByName(r), "problem", Suppress(hours), F.when(F.col("kind") == "repair", "0").otherwise(F.concat(F.lit("1"), F.col("source"))))


def silence_alerts(beats: DataFrame, seconds: int = 300, rows: int = STRETCH) -> DataFrame:
    """On a table: where the next heartbeat of a source comes later, or none comes until the newest one of all sources."""
    if beats.isStreaming:
        return _stateful(beats, "source", Silence(seconds))
    own = beats.select(F.col("ts").cast("timestamp").alias("ts"), "source")
    before = F.lag("ts").over(W.partitionBy("source", "_stretch").orderBy("ts"))
    gaps = with_rows_before(own, "source", ["ts"], 1, rows).withColumn("_last", before).filter("not _carried").select("source", F.col("_last").alias("ts"), F.col("ts").alias("_next"))
    ends = own.groupBy("source").agg(F.max("ts").alias("ts")).join(own.agg(F.max("ts").alias("_next")), how="cross")  # one row
    late = F.col("_next").cast("double") - F.col("ts").cast("double")
    gaps = gaps.filter(late > seconds).unionByName(ends.filter(late >= seconds))
    return _told(gaps.select((F.col("ts").cast("double") + seconds).cast("timestamp").alias("ts"), "source"), "silence", "critical", F.lit(float(seconds)))
