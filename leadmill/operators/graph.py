"""Connected components of any number of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadmill.operators.scratch import written

#: So many links at most are joined by one task.
ONE_TASK = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges(a, b), of any orderable type; a component is one of its ids.

    While there are more than ONE_TASK links, each id becomes the one of least hash among itself and its neighbours, and
    links between ids that became the same vanish. This halves the ids of a component about, also along a chain in order,
    so the number of rounds is a logarithm of the input. The rest, of bounded size, is joined by one task. Written within
    the open scope.
    """
    links = written(edges.select("a", "b").filter("a <> b").distinct(), "links")
    named = written(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component", F.col("id")), "named")
    salt = 0
    while links.limit(ONE_TASK + 1).count() > ONE_TASK:
        salt += 1
        both = links.union(links.select("b", "a"))
        ranked = F.struct(F.xxhash64("b", F.lit(salt)).alias("h"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64("a", F.lit(salt)).alias("h"), F.col("a").alias("id"))
        step = written(both.groupBy("a").agg(F.least(F.min(ranked), F.first(own)).alias("to")).select(F.col("a").alias("from"), "to.id"), "step").withColumnRenamed("id", "to")
        named = _renamed(named, "component", step)
        named = written(named, "named")
        links = written(_renamed(_renamed(links, "a", step), "b", step).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    kind = f"from {links.schema['a'].dataType.simpleString()}, to {links.schema['a'].dataType.simpleString()}"
    last = written(links.coalesce(1).mapInArrow(_joined, kind), "step")
    return _renamed(named, "component", last)


def _renamed(rows: DataFrame, column: str, step: DataFrame) -> DataFrame:
    """The rows with a column's ids replaced where the step(from, to) names others."""
    return rows.join(step, F.col(column) == F.col("from"), "left").withColumn(column, F.coalesce("to", column)).drop("from", "to")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict = {}

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = above[x]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
    if above:
        yield pa.record_batch([pa.array(list(above), kind), pa.array([top(x) for x in list(above)], kind)], ["from", "to"])
