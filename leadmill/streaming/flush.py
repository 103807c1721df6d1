"""Rows gathered and sent on together: so many of them, or what has waited so long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadmill.operators.windows import numbered
from leadmill.streaming.alerts import needs_rocks


class FlushBuffer(StatefulProcessor):
    """A key's rows wait until there are n of them, or until the first has waited so many seconds of processing time. Each
    flush has a number; its rows say whether rows or time caused it. What waits lives in the state store, so nothing is
    lost between runs of the query."""

    def __init__(self, n: int = 50, seconds: float = 300):
        self.n, self.seconds = n, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.count = handle.getValueState("count", "waiting long, flushes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had, flushes = self.count.get() if self.count.exists() else (0, 0)
        new = [(x,) for b in rows if len(b) for x in b["said"].tolist()]
        out = []
        if had + len(new) < self.n:
            self.waiting.appendList(new)
            if not had:
                self._wake(timerValues)
            self.count.update((had + len(new), flushes))
        else:
            all_ = [tuple(r) for r in self.waiting.get()] + new if had else new
            whole = len(all_) // self.n
            out = [(key[0], flushes + 1 + k // self.n, "rows", r[0]) for k, r in enumerate(all_[: whole * self.n])]
            rest = all_[whole * self.n :]
            self._sleep()
            if rest:
                self.waiting.put(rest)
                self._wake(timerValues)
            else:
                self.waiting.clear()
            self.count.update((len(rest), flushes + whole))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        had, flushes = self.count.get() if self.count.exists() else (0, 0)
        out = [(key[0], flushes + 1, "time", r[0]) for r in self.waiting.get()] if had else []
        self.waiting.clear()
        self.count.update((0, flushes + bool(had)))
        yield self._frame(out)

    def _wake(self, timerValues) -> None:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + round(self.seconds * 1000))

    def _sleep(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "flush", "cause", "row"]).astype({"flush": "int64"})

    def close(self) -> None:
        pass


def flushed(rows: DataFrame, key: str, n: int = 50, seconds: float = 300) -> DataFrame:
    """A stream's rows with flush, the number of the key's flush that sends them on, and cause: rows or time."""
    needs_rocks(rows.sparkSession)
    kind = rows.schema
    said = rows.select(F.col(key).cast("string").alias("of"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("said"))
    out = said.groupBy("of").transformWithStateInPandas(FlushBuffer(n, seconds), "key string, flush long, cause string, row string", "append", "ProcessingTime")
    return out.select(F.from_json("row", kind).alias("r"), "flush", "cause").select("r.*", "flush", "cause")


def flush_groups(rows: DataFrame, key: str, order, n: int = 50) -> DataFrame:
    """A table's rows with flush: the number of the key's n rows, in order of arrival, that they go with."""
    return numbered(rows, key, order, "_no").withColumn("flush", F.ceil(F.col("_no") / n).cast("long")).drop("_no")
