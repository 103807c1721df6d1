"""JSON of any depth as rows: a level of objects and lists a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadmill.operators.scratch import written


def levels(df: DataFrame, keep: list[str], value: str = "v") -> list[DataFrame]:
    """Frames (keep..., path, keys, value), one a level, of the objects and lists in a column of variants: the value itself
    at path [], then what lies in it. path: positions within objects (in order of their keys' names) and lists; keys: keys
    on the way, null for list items. Written within the open scope; a round a level, as deep as the deepest value."""
    level = df.select(*keep, F.array().cast("array<int>").alias("path"), F.array().cast("array<string>").alias("keys"), F.col(value).alias("v"))
    out = [written(level.filter("v is not null"), "level")]
    tvf = df.sparkSession.tvf
    while out[-1].limit(1).count():
        below = out[-1].lateralJoin(tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        kind = F.schema_of_variant("_value")
        below = below.filter(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")))
        out.append(written(below.select(*keep, F.array_append("path", F.col("_pos")).alias("path"), F.array_append("keys", F.col("_key")).alias("keys"), F.col("_value").alias("v")), "level"))
    return out
