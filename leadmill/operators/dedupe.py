"""Insert-or-ignore on several keys, sightings and rank changes. Each makes a new snapshot from an old one."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leadmill.functions.text import calc_rank
from leadmill.operators.graph import components
from leadmill.operators.match import find_duplicates
from leadmill.operators.scratch import scope, written


#: Rounds before what is left is cut into components.
ROUNDS = 3
#: Rows of a component that one task settles.
COMPONENT_ROWS = 200_000


def insert_or_ignore(new: DataFrame, existing: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) as if the rows came one by one and a row that shares a key with an accepted or existing one
    were ignored. Null keys never collide. order must be unique.

    Rounds: rows that are first in all their keys' groups are accepted, rows that share a key with those are rejected,
    the rest goes on. Most rows, and keys of very many rows, are done after ROUNDS of them. What is left are chains that
    alternate keys: they are cut into components, and each of at most COMPONENT_ROWS is settled by one task in order of
    arrival. Only larger ones go on in rounds.
    """
    with scope(new.sparkSession) as keep:
        open_ = new
        for k in keys:
            open_ = _without(open_, existing, k)
        open_, ids = written(open_.select(order, *keys), "open"), []
        while (n := len(ids)) < ROUNDS and open_.limit(1).count():
            won, open_ = _round(open_, keys, order)
            ids.append(won)
        if n == ROUNDS and open_.limit(1).count():
            small, open_ = _by_component(open_, keys, order)
            ids.append(written(_settled(small, keys, order), "settled"))
            while open_.limit(1).count():
                won, open_ = _round(open_, keys, order)
                ids.append(won)
        accepted = keep(reduce(DataFrame.unionByName, [x.select(F.col(order).alias("_o")) for x in ids] or [open_.select(F.col(order).alias("_o"))]), "accepted")
    return new.join(accepted, F.col(order) == F.col("_o"), "left_semi"), new.join(accepted, F.col(order) == F.col("_o"), "left_anti")


def _without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows that share no value of the key with the others."""
    return rows.join(others.select(F.col(key).alias("_k")).filter("_k is not null").distinct(), F.col(key) == F.col("_k"), "left_anti")


def _round(open_: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, still open)."""
    marked, first = open_, F.lit(True)
    for k in keys:
        least = open_.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min(order).alias(f"_first_{k}"))
        marked = marked.join(least, F.col(k) == F.col("_k"), "left").drop("_k")
        first = first & F.coalesce(F.col(f"_first_{k}") == F.col(order), F.lit(True))
    won = written(marked.filter(first).select(order, *keys), "won")
    rest = open_.join(won.select(F.col(order).alias("_o")), F.col(order) == F.col("_o"), "left_anti")
    for k in keys:
        rest = _without(rest, won, k)
    return won, written(rest, "open")


def _by_component(open_: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(rows of small components, with `_component`; rows of the others)."""
    # the rows of a key's value lie around the first of them
    edges = []
    for k in keys:
        least = open_.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min(order).alias("b"))
        edges.append(open_.join(least, F.col(k) == F.col("_k")).select(F.col(order).alias("a"), "b").filter("a <> b"))
    parts = components(reduce(DataFrame.union, edges)).select(F.col("id").alias("_id"), "component")
    rows = open_.join(parts, F.col(order) == F.col("_id"), "left").withColumn("_component", F.coalesce("component", order)).drop("_id", "component")
    rows = written(rows, "components")
    giant = rows.groupBy(F.col("_component").alias("_c")).count().filter(F.col("count") > COMPONENT_ROWS).select("_c")
    large = F.col("_component") == F.col("_c")
    return rows.join(giant, large, "left_anti"), written(rows.join(giant, large, "left_semi").drop("_component"), "open")


def _settled(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The accepted rows, each component worked off in order of arrival."""

    def settle(own: pd.DataFrame) -> pd.DataFrame:
        taken, won = [set() for _ in keys], []
        own = own.sort_values(order)
        for o, *values in own[[order, *keys]].itertuples(index=False, name=None):
            if not any(v is not None and v == v and v in seen for v, seen in zip(values, taken, strict=True)):
                won.append(o)
                for v, seen in zip(values, taken, strict=True):
                    seen.add(v)
        return pd.DataFrame({order: won})

    return rows.groupBy("_component").applyInPandas(settle, rows.select(order).schema)


def sightings(events: DataFrame, key: str, source: str) -> DataFrame:
    """(key, seen_count, sources, rank) of each key."""
    return events.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("seen_count"), F.array_sort(F.collect_set(source)).alias("sources")).withColumn("rank", calc_rank(F.col("seen_count"), F.col("sources")))


def apply_sightings(companies: DataFrame, duplicates: DataFrame, changed_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """New companies and the rank changes, from rows that met a known phone, else a known URL. duplicates(phone, base_url,
    source). A change is told only where the number of sources grew. changed_only: companies that were met alone."""
    keyed = duplicates.withColumn("_n", F.monotonically_increasing_id())
    phone = companies.filter("coalesce(phone, '') <> ''").groupBy(F.col("phone").alias("_p")).agg(F.min("id").alias("_by_phone"))
    url = companies.filter("coalesce(base_url, '') <> ''").groupBy(F.col("base_url").alias("_u")).agg(F.min("id").alias("_by_url"))
    met = keyed.join(phone, F.col("phone") == F.col("_p"), "left").join(url, F.col("base_url") == F.col("_u"), "left").select(F.coalesce("_by_phone", "_by_url").alias("id"), "source").filter("id is not null")
    delta = met.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("_more"), F.collect_set("source").alias("_sources"))
    both = companies.join(delta, "id", "inner" if changed_only else "left")
    none = F.array().cast("array<string>")
    merged = F.array_sort(F.array_union(F.coalesce("ad_sources", none), F.coalesce("_sources", none)))
    seen = F.coalesce("seen_count", F.lit(1)) + F.coalesce("_more", F.lit(0))
    new = both.withColumns({"_was": F.coalesce(F.size("ad_sources"), F.lit(0)), "_all": merged, "_seen": seen, "_old": F.col("rank")})
    new = new.withColumn("rank", F.when(F.col("_more").isNotNull(), calc_rank(F.col("_seen"), F.col("_all"))).otherwise(F.col("rank"))).withColumn("seen_count", F.col("_seen").cast("int")).withColumn("ad_sources", F.col("_all"))
    changes = new.filter("size(ad_sources) > _was and not (rank <=> _old)").select("id", "normalized_name", F.col("_old").alias("old_rank"), "rank")
    return new.select(companies.columns), changes


def keyword_lists(events: DataFrame, key: str = "company", keyword: str = "keyword", order: str = "ts") -> DataFrame:
    """(key, all_keywords): distinct keywords in the order first seen."""
    first = events.groupBy(key, keyword).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", keyword))), lambda x: x[keyword]).alias("all_keywords"))


__all__ = ["apply_sightings", "find_duplicates", "insert_or_ignore", "keyword_lists", "sightings"]
