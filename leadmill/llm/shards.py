"""Sharding by a hierarchical weighted hash tree.

Each shard draws -ln(u) / weight, u from a hash of key and shard; the draw of a rack is the least of its shards' draws,
that of a region the least of its racks'. A row descends to the region, the rack and the shard of least draw, so each
gets rows in proportion to its weight. A shard's draw depends on key, shard and its own weight alone: where a weight grows
or a shard comes, rows move only into that subtree and there only into that shard; where one falls, only out of it.

The law is `key`: the key and the tree decide alone. A null key is a key like others; rows of one key share a shard.
Slots number a shard's rows without gaps, in an order by hash bucket and key, so that no task holds a whole shard.
Rows that are equal in all columns used here are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadmill.llm.common import table

#: A tree: region -> rack -> shard -> weight.
Tree = dict[str, dict[str, dict[int, float]]]
#: Hash buckets of each shard, numbered independently.
BUCKETS = 4096


def even_tree(shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """Shards of equal weight in order; a region is full with racks * per_rack of them."""
    tree: Tree = {}
    for s in range(shards):
        tree.setdefault(f"region{s // (racks * per_rack)}", {}).setdefault(f"rack{s // per_rack}", {})[s] = 1.0
    return tree


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key."""
    shard = lambda s, w: F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight"))
    rack = lambda shards: F.array(*[shard(s, w) for s, w in shards.items() if w > 0])
    region = lambda racks: F.array(*[rack(shards) for shards in racks.values() if any(w > 0 for w in shards.values())])
    regions = F.array(*[region(racks) for racks in tree.values() if any(w > 0 for shards in racks.values() for w in shards.values())])
    u = lambda s: (F.shiftrightunsigned(F.xxhash64(key, s.shard), 11).cast("double") + 0.5) / float(1 << 53)
    of_shard = lambda s: F.struct((-F.log(u(s)) / s.weight).alias("draw"), s.shard.alias("shard"))
    of_rack = lambda shards: F.array_min(F.transform(shards, of_shard))
    of_region = lambda racks: F.array_min(F.transform(racks, of_rack))
    return F.array_min(F.transform(regions, of_region)).shard.cast("int")


def into_shards(df: DataFrame, tree: Tree, key: str = "doc_id", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds shard and slot. order: further columns that order rows of one key."""
    keep = [c for c in df.columns if c not in ("shard", "slot", "_bucket", "_before")]
    # the further columns too: rows of one key fall into many buckets
    bucket = F.pmod(F.xxhash64(F.col(key), *order, F.lit("slot")), F.lit(BUCKETS)).cast("int")
    rows = df.select(*keep, shard_of(F.col(key), tree).alias("shard"), bucket.alias("_bucket"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # at most BUCKETS rows a shard, whatever the table's size
    rows = rows.join(F.broadcast(before), ["shard", "_bucket"])
    rank = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy(key, *order))
    return rows.select(*keep, "shard", (F.col("_before") + rank - 1).alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = into_shards(docs, even_tree(16), order=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), shard_of(F.col("doc_id"), even_tree(17)).alias("grown_shard"))
