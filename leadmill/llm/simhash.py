"""Near duplicates by SimHash with covering locality-sensitive hashing.

A fingerprint has a bit set where more than half of a text's shingle hashes have it. Links join fingerprints that differ
in at most `radius` bits; every one of them is found:

- Each of the 64 places gets a non-zero vector of radius + 1 bits, in turn. For each non-zero vector v there is a table
  that compares only the places whose vector has an odd product with v. The differing places of a pair give at most
  `radius` vectors, to which some v is orthogonal: in that table the pair's keys are equal. Radius 2 takes 7 tables, each
  of 36 or 37 places.
- Equal fingerprints, however many rows have them, are one member of a table's bucket.
- Buckets of at most SMALL members compare their pairs. In a larger one each member names the points of its bucket within
  half the radius, that is itself with up to radius // 2 of the places changed that the table leaves out: two members of a
  bucket are within the (even) radius just if they name a point in common, so members of a point are linked with its least
  one and no pairs arise. For an odd radius a member also names, on one side, the points one step further.
- Links join fingerprints into components; a component's id is the least id of its rows.

A text's shingles are all its runs of `k` words, repeats included; with fewer words the whole text is one; without words,
empty or null, the fingerprint is zero and is linked like any other. A-Z are lower-cased, words are runs without ASCII
white space. Rows are linked by their fingerprints alone, whatever their ids; a component without any id has null.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from leadmill.llm.common import dropped, shared_folder, table, written
from leadmill.llm.neardup import components

BITS = 64
SEED = 42
#: Pairs of buckets of so many different fingerprints at most are compared one by one.
SMALL = 16
#: Shingles of one text that are counted together.
BLOCK = 1 << 15


def text_fingerprint(text: str | None, k: int = 3) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - k + 1)
    size = np.array([len(w) for w in words], np.int64)
    begin = (np.cumsum(size + 1) - size - 1).tolist()
    end = (np.cumsum(size + 1) - 1).tolist()
    digest, view, ones = xxhash.xxh64_intdigest, memoryview(line), np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        h = np.array([digest(view[a:b], SEED) for a, b in zip(begin[at:to], (end[k - 1 :] or end[-1:])[at:to], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, k: int = 3) -> Column:
    """Column: the fingerprint of a text as a long."""
    f = F.arrow_udf(lambda texts: pa.array(np.array([text_fingerprint(t, k) for t in texts.to_pylist()], np.uint64).view(np.int64)), "long")
    return f(text)


def covering_masks(radius: int) -> list[int]:
    """2^(radius + 1) - 1 masks; for any `radius` places one mask has none of them."""
    vectors = 2 ** (radius + 1) - 1
    given = [1 + place % vectors for place in range(BITS)]
    return [sum(1 << place for place, g in enumerate(given) if (g & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _points(mask: int, steps: int) -> list[int]:
    """What changes up to so many of the places that the mask leaves out."""
    free = [1 << p for p in range(BITS) if not mask >> p & 1]
    return [_signed(sum(c)) for s in range(steps + 1) for c in combinations(free, s)]


def links(prints: DataFrame, radius: int = 2, under: str | None = None) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column print) that lead from each to all that can be reached by steps of at
    most radius bits; each link is within the radius."""
    masks = covering_masks(radius)
    of_table = F.array(*[F.lit(_signed(m)) for m in masks])
    keyed = prints.select("print", F.posexplode(of_table).alias("table", "mask")).select("table", F.col("print").bitwiseAND(F.col("mask")).alias("key"), "print")
    keyed = written(keyed, "keyed", under)
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(keyed.join(shared, ["table", "key"]), "members", under)
    few = members.filter(F.col("size") <= SMALL)
    side = lambda s: few.select("table", "key", F.col("print").alias(s))
    pairs = side("a").join(side("b"), ["table", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    many = members.filter(F.col("size") > SMALL)
    near = _named(many, masks, radius // 2)
    if radius % 2:  # a point one step further of one member is a point of the other
        least = near.groupBy("table", "key", "point").agg(F.min("print").alias("b"))
        star = _named(many, masks, radius // 2 + 1).join(least, ["table", "key", "point"]).select(F.col("print").alias("a"), "b")
    else:
        star = near.groupBy("table", "key", "point").agg(F.min("print").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        star = near.join(star, ["table", "key", "point"]).select(F.col("print").alias("a"), "b")
    return pairs.union(star.filter("a <> b")).distinct()


def _named(members: DataFrame, masks: list[int], steps: int) -> DataFrame:
    """(table, key, point, print): the points of each member within its bucket."""
    changes = F.array(*[F.array(*[F.lit(c) for c in _points(m, steps)]) for m in masks])
    return members.select("table", "key", "print", F.explode(F.get(changes, F.col("table"))).alias("change")).select("table", "key", F.col("print").bitwiseXOR(F.col("change")).alias("point"), "print")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of each row of docs."""
    base = f"{shared_folder(docs.sparkSession)}/simhash-{uuid.uuid4().hex}"
    rows = written(docs.select(F.col(id_).alias("id"), fingerprint(F.col(text), k).alias("print")), "prints", base)
    classes = written(rows.groupBy("print").agg(F.min("id").alias("least")), "classes", base)
    found = written(links(classes.select("print"), radius, base), "links", base)
    parts = components(found, base).select(F.col("id").alias("print"), "component")
    whole = classes.join(parts, "print", "left").withColumn("component", F.coalesce("component", "print"))
    ids = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.select("print", "component").join(ids, "component").select("print", "component_id")
    out = rows.join(whole, "print").select(F.col("id").alias(id_), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
    out = written(out, "simhash")
    dropped(docs.sparkSession, base)
    return out


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
