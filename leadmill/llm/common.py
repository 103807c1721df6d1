"""What the operators of this subpackage share: table access, the shared scratch folder and small array helpers."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local master, which is one machine, may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="leadmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str, under: str | None = None) -> DataFrame:
    """The frame, written once to the shared folder (or a folder of it) and read again: later passes neither repeat the
    work before it nor depend on executors that hold its blocks."""
    spark = df.sparkSession
    path = f"{under or shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Ids are broadcast up to this number (16 bytes each); beyond, joins shuffle.
BROADCAST_IDS = 1_000_000


#: Tables of so many rows at most are left to Spark's own choice, which goes by the size of compressed files.
OWN_CHOICE = 200_000


def shuffled(df: DataFrame) -> DataFrame:
    """The frame with a hint to join it by a shuffle. Spark takes what was exploded for as large as what it came from, and
    AQE keeps a broadcast that was planned by that even where it has counted more."""
    return df.hint("merge")


def maybe_broadcast(ids: DataFrame, most: int | None = None) -> DataFrame:
    """The frame of ids, with a broadcast hint where it was counted to be small; else it is shuffled."""
    most = BROADCAST_IDS if most is None else most
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else shuffled(ids)


def by_rows(df: DataFrame) -> DataFrame:
    """The frame of a few numbers a row, to be shuffled where it was counted to be large."""
    return df if df.limit(OWN_CHOICE + 1).count() <= OWN_CHOICE else shuffled(df)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(n: Column) -> Column:
    """The array 0 .. n-1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the rows, however many, as one literal of the plan."""
    names = [x.split()[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' string', ': string')}>>")))
