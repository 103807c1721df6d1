"""Near duplicates by MinHash with tensored banding.

A text's set holds its distinct word shingles. COLLECTIONS small groups of ROWS minhashes each are combined in pairs:
every pair of groups is one hash table, so COLLECTIONS * ROWS minhashes serve COLLECTIONS * (COLLECTIONS - 1) / 2 tables
of twice the rows; two sets of similarity 0.8 meet in a table with probability 0.9998. Texts with equal sets are one
class from the start. Candidates are then confirmed on full sets, and links join classes into components:

1. ROUNDS times, every text is compared with one other: the least member of a bucket's least component, of all its
   buckets the least that is of another component, fits in size and wasn't compared yet. Links join components.
2. Buckets whose members are then of one component are done. In others of at most SMALL members, each pair of members
   from different components that fit in size is compared.
3. Members of larger open buckets are joined exactly, whatever their number: two sets of similarity s share one of
   their n - ceil(s * n) + 1 rarest shingles, early enough in both that what follows can make up the similarity. Rows
   that no row of another component under the same shingle could bring there are left out first. ROUNDS times, every text
   left is compared with one of the main component, the member that brings most, while that links any. Then pairs of different
   components that share such a shingle and fit in size are compared; one of the two is outside the component that has
   most of the shingle's rows, so only such rows are copied to the shares of a hot shingle.

Large groups of copies or near copies thus cost a comparison a member, and no bucket is cut off.

A null or empty text, or one without words, has an empty set and is linked with nothing. A text with fewer words than a
shingle has one shingle of all its words. Rows are linked by their texts alone, also rows that share an id; rows without an
id are linked with nothing. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from leadmill.llm.common import OWN_CHOICE, by_rows, dropped, maybe_broadcast, shared_folder, shuffled, table, written

COLLECTIONS = 16
ROWS = 3
#: Pairs across components of so many members at most are listed bucket by bucket.
SMALL = 24
#: Members of one shingle, of those left, that a task pairs with those outside its main component.
SHARE = 500
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Rounds of one comparison a text before the rest is paired.
ROUNDS = 2
MEMO = 400_000
_memo: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: bytes) -> int:
    got = _memo.get(word)
    if got is None:
        got = xxhash.xxh3_64_intdigest(word)
        if len(_memo) >= MEMO:
            _memo.clear()
        _memo[word] = got
    return got


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of k words; A-Z lower-cased, words are runs without ASCII white space."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_word_hash(w) for w in words], np.uint64)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out * _GOLD + h[j : len(h) - k + 1 + j])
    return np.unique(out)


_SEEDS = _mix(np.arange(1, COLLECTIONS * ROWS + 1, dtype=np.uint64) * _GOLD)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit value a collection, of its ROWS minhashes."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):  # bounded memory for very long texts
        part = shingles[at : at + 4096]
        x = (part[None, :] ^ _SEEDS[:, None]) * _GOLD
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=1))
    rows = least.reshape(COLLECTIONS, ROWS)
    out = np.arange(1, COLLECTIONS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = _mix(out * _GOLD + rows[:, j])
    return out.view(np.int64)


def described(docs: DataFrame, k: int, id_: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., id, t, n, key, signature) of each row; t is a hash of the text, key a 128-bit digest of its set."""

    @F.arrow_udf("struct<n: long, key: binary, signature: array<long>>")
    def describe(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            s = shingle_set(t, k)
            out.append({"n": len(s), "key": hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "signature": signature(s).tolist() if len(s) else None})
        return pa.array(out, pa.struct([("n", pa.int64()), ("key", pa.binary()), ("signature", pa.list_(pa.int64()))]))

    own = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.col(id_).alias("id"), F.xxhash64(text).alias("t"), describe(F.col(text)).alias("d"))
    return own.select(*[f"keep_{c}" for c in keep], "id", "t", "d.n", "d.key", "d.signature")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, id, n): a row for each class and pair of collections."""
    keys = F.array(*[F.xxhash64(F.get("signature", F.lit(i)), F.get("signature", F.lit(j)), F.lit(i * COLLECTIONS + j)) for i, j in combinations(range(COLLECTIONS), 2)])
    return classes.select(F.explode(keys).alias("bucket"), "id", F.col("n").cast("int").alias("n"))


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b), which are written, whose full sets are similar enough. Texts are never broadcast: files of alike
    ones are far smaller than they."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last = [], (None, None)
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            x = shingle_set(a, k)
            if last[0] != b:
                last = (b, shingle_set(b, k))
            both = len(np.intersect1d(x, last[1], assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(last[1]) - both))
        return pa.array(out, pa.bool_())

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("left")), texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return maybe_broadcast(pairs, OWN_CHOICE).join(left, "a").join(shuffled(right), "b").filter(similar("left", "right")).select("a", "b")


def components(edges: DataFrame, under: str | None = None) -> DataFrame:
    """(id, component) of every id in edges(a, b): the least id that can be reached. Each round takes the least
    component of all neighbours and then follows components' own components, until nothing changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", under)
    now = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "components", under)
    while True:
        known = by_rows(now)
        near = both.join(known.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = now.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("c", "component")).alias("component"))
        # follow the component's own component of before
        jump = known.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = written(step.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "components", under)
        if not new.filter("component <> was").limit(1).count():
            return new.select("id", "component")
        now = new.select("id", "component")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., id, n_shingles, component_id, component) of each row of docs: the least id of its component, and a name
    that tells components apart whose least ids are the same. keep: columns of docs that go along."""
    base = f"{shared_folder(docs.sparkSession)}/near-{uuid.uuid4().hex}"  # for all that is written on the way
    rows = written(described(docs, k, id_, text, keep), "described", base)
    # equal sets, also thousands of them, become one class by partial minima; `own` is the row that stands for it
    classes = rows.filter("n > 0 and id is not null").groupBy("key").agg(F.min(F.struct("id", "t")).alias("own"), F.max("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(classes, "classes", base)
    # a class goes by its least id; those that share one, as rows repeat it with other texts, by a hash of id and text
    again = written(classes.groupBy(F.col("own.id").alias("again")).count().filter("count > 1").select("again"), "again", base)
    named = classes.join(maybe_broadcast(again), F.col("own.id") == F.col("again"), "left")
    name = F.when(F.col("again").isNull(), F.col("own.id")).otherwise(F.xxhash64("own.id", "own.t"))
    classes = written(named.select("key", name.alias("id"), "own", "n", "signature"), "named", base)
    buckets = _buckets(classes)
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(buckets.join(shuffled(shared), "bucket"), "members", base)
    ids = written(classes.select("id", "own").join(shuffled(members.select("id").distinct()), "id").select("id", "own.t", F.col("own.id").alias("doc")), "ids", base)
    texts = docs.select(F.col(id_).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("t")).join(maybe_broadcast(ids), ["doc", "t"]).select("id", "text")
    texts = written(texts, "texts", base)
    parts = classes.select("id", F.col("id").alias("component")).limit(0)
    links = compared = None
    for _ in range(ROUNDS):
        pairs = written(_one_each(members, parts, compared, percent), "pairs", base)
        compared = pairs if compared is None else compared.union(pairs)
        more = written(_confirmed(pairs, texts, k, percent), "links", base)
        links = more if links is None else links.union(more)
        parts = components(links, base)
    rest, rare = _across(members, parts, texts, k, percent, base)
    if rare is not None:
        for _ in range(ROUNDS):
            left = _candidates(_of_parts(rare, parts), percent, base)
            pairs = written(_best_each(left, percent).join(by_rows(compared), ["a", "b"], "left_anti"), "pairs", base)
            compared = compared.union(pairs)
            more = written(_confirmed(pairs, texts, k, percent), "links", base)
            if not more.limit(1).count():
                break
            links = links.union(more)
            parts = components(links, base)
        else:
            left = _candidates(_of_parts(rare, parts), percent, base)
        rest = rest.union(_rare_pairs(left, percent)).distinct()
    rest = written(rest.join(by_rows(compared), ["a", "b"], "left_anti"), "pairs", base)
    more = written(_confirmed(rest, texts, k, percent), "links", base)
    if more.limit(1).count():
        parts = components(links.union(more), base)
    found = classes.select("key", "id", F.col("own.id").alias("least")).join(by_rows(parts), "id", "left").withColumn("component", F.coalesce("component", "id"))
    found = found.join(found.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("key", "component", "component_id")
    # rows without an id or a set have no component; they don't meet in one task, as they are joined by nothing
    alone = F.col("n").eqNullSafe(0) | F.col("id").isNull()
    carried = [F.col(f"keep_{c}").alias(c) for c in keep]
    linked = rows.filter(~alone).join(found, "key").select(*carried, F.col("id").alias(id_), F.col("n").alias("n_shingles"), "component_id", "component")
    other = rows.filter(alone).select(*carried, F.col("id").alias(id_), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    out = written(linked.unionByName(other), "near-duplicates")
    dropped(docs.sparkSession, base)
    return out


def _fits(a: str, b: str, percent: int):
    """Column: two set sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _follows(both, a: str, b: str, percent: int):
    """Column: sets of these sizes that share so many shingles reach the similarity."""
    return (F.col(both) if isinstance(both, str) else both) * (100 + percent) >= percent * (F.col(a) + F.col(b))


def _of_parts(members: DataFrame, parts: DataFrame) -> DataFrame:
    return members.join(by_rows(parts), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _one_each(members: DataFrame, parts: DataFrame, compared: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): for each text at most one other, the least center of its open buckets. At most a pair a text."""
    known = _of_parts(members, parts)
    centers = known.groupBy("bucket").agg(F.min(F.struct("component", "id", "n")).alias("c"), F.max("component").alias("hi")).filter("c.component < hi").select("bucket", "c")
    pairs = known.join(shuffled(centers), "bucket").filter(F.col("component") != F.col("c.component")).withColumn("nb", F.col("c.n")).filter(_fits("n", "nb", percent)).select(F.col("id").alias("a"), F.col("c.id").alias("b"))
    if compared is not None:
        pairs = pairs.distinct().join(by_rows(compared), ["a", "b"], "left_anti")
    return pairs.groupBy("a").agg(F.min("b").alias("b"))


def _across(members: DataFrame, parts: DataFrame, texts: DataFrame, k: int, percent: int, base: str) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs (a > b) that small open buckets leave to be compared; and, if there are large ones, the shingles of
    their members' prefixes that another member has: (id, n, rest, shingle, uses)."""
    known = _of_parts(members, parts)
    open_ = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    known = written(known.join(open_, "bucket", "left_semi"), "open", base)
    few = known.filter(F.col("size") <= SMALL)
    pairs, rare = _pairs(few, percent), None
    large = known.filter(F.col("size") > SMALL).select("id", "n").distinct()
    if large.limit(1).count():
        large = written(large, "large", base)
        shingles = F.arrow_udf(lambda t: pa.array([shingle_set(x, k).view(np.int64).tolist() for x in t.to_pylist()], pa.list_(pa.int64())), "array<long>")
        own = maybe_broadcast(large, OWN_CHOICE).join(texts.dropDuplicates(["id"]), "id").select("id", "n", F.explode(shingles(F.col("text"))).alias("shingle"))
        own = written(own, "shingles", base)
        uses = own.groupBy("shingle").agg(F.count("*").alias("uses")).filter("uses > 1")
        # shingles of one text can't be shared, but they are its rarest and fill its prefix first
        ranked = own.join(shuffled(uses), "shingle", "left").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("uses", F.lit(1)).alias("uses"), "shingle"))).alias("all"))
        prefix = F.slice("all", F.lit(1), (F.size("all") - F.ceil(F.size("all") * F.lit(percent) / 100) + 1).cast("int"))
        rare = ranked.select("id", "n", F.posexplode(prefix).alias("at", "s")).filter("s.uses > 1")
        # rest: a set's shingles from this one on, the most that it can share with one that shares none before
        rare = rare.select("id", "n", (F.col("n") - F.col("at")).cast("int").alias("rest"), F.col("s.shingle").alias("shingle"), F.col("s.uses").alias("uses"))
        rare = written(rare, "rare", base)
    return pairs, rare


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of different components in one bucket, of at most SMALL members, that fit in size."""
    side = lambda s: rows.select("bucket", F.col("id").alias(s), F.col("component").alias(f"component_{s}"), F.col("n").alias(f"n_{s}"))
    good = (F.col("a") > F.col("b")) & (F.col("component_a") != F.col("component_b")) & _fits("n_a", "n_b", percent)
    return side("a").join(shuffled(side("b")), "bucket").filter(good).select("a", "b").distinct()


def _reaches(most: str, least: str, percent: int):
    """Column: a row may reach the similarity with another, if others have that rest at most and that size at least."""
    return 100 * F.least("rest", most) * (100 + percent) >= percent * (100 * F.col("n") + F.greatest(100 * F.col(least), percent * F.col("n")))


def _told(rows: DataFrame, keys: DataFrame, size: str = "uses") -> DataFrame:
    """The rows of the keys(shingle, size, ...) with what is known of their key; each share of a hot key's rows meets a copy."""
    shares = F.ceil(F.col(size) / SHARE).cast("int")
    copies = keys.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop(size)
    return rows.withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int")).join(shuffled(copies), ["shingle", "share"]).drop("share")


def _candidates(rare: DataFrame, percent: int, base: str) -> DataFrame:
    """The rows that can reach the similarity with a row of another component under their shingle. main: of the component
    that most of the shingle's rows are of; kept: how many rows of the shingle are left."""
    rare = written(rare, "placed", base)
    sizes = rare.groupBy("shingle", "component").agg(F.count("*").alias("size"), F.max("rest").alias("most"), F.min("n").alias("least"), F.max("uses").alias("uses"))
    keys = sizes.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts"), F.max("most").alias("most"), F.min("least").alias("least"), F.max("uses").alias("uses"))
    keys = keys.filter("parts > 1").select("shingle", "uses", "most", "least", F.col("top.component").alias("top"))
    rows = _told(rare, keys).filter(_reaches("most", "least", percent)).withColumn("main", F.col("component") == F.col("top")).drop("most", "least", "top")
    rows = written(rows, "reaching", base)
    # those of the main component reach rows of others alone, and what these can do is known only now
    other = lambda c: F.when(~F.col("main"), F.col(c))
    keys = rows.groupBy("shingle").agg(F.max(other("rest")).alias("most_other"), F.min(other("n")).alias("least_other"), F.max("rest").alias("most"), F.min("n").alias("least"), F.max("uses").alias("uses"))
    rows = _told(rows, keys.filter("most_other is not null")).filter(F.when(F.col("main"), _reaches("most_other", "least_other", percent)).otherwise(_reaches("most", "least", percent)))
    rows = written(rows.select("shingle", "uses", "id", "component", "n", "rest", "main"), "candidates", base)
    kept = rows.groupBy("shingle").agg(F.count("*").alias("kept"), F.max("uses").alias("uses"), F.max(~F.col("main")).alias("mixed"))
    return written(_told(rows, kept.filter("mixed").drop("mixed")).drop("uses"), "dealt", base)


def _best_each(candidates: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each text outside the main components at most one other, of what its shingles' main components have that
    with the greatest rest: the original, rather than a copy with changes of its own. At most a pair a text."""
    tops = candidates.filter("main").groupBy("shingle").agg(F.max(F.struct("rest", F.negative("id").alias("first"), "id", "n")).alias("top"), F.max("kept").alias("kept"))
    met = _told(candidates.filter("not main"), tops, "kept").withColumns({"nb": F.col("top.n"), "both": F.least("rest", "top.rest")})
    met = met.filter(_fits("n", "nb", percent) & _follows("both", "n", "nb", percent))
    best = met.groupBy("id").agg(F.max(F.struct("top.rest", "top.first", "top.id")).alias("top"))
    return best.select(F.greatest("id", "top.id").alias("a"), F.least("id", "top.id").alias("b")).distinct()


def _copied(candidates: DataFrame) -> DataFrame:
    """Rows that go to each share of their shingle's rows: those outside the main component, as each pair has one of them."""
    return candidates.filter(~F.col("main")).withColumn("share", F.explode(F.sequence(F.lit(0), F.ceil(F.col("kept") / SHARE).cast("int") - 1)))


def _rare_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a > b) of candidates of different components that fit in size and in what can still follow."""
    side = lambda df, s: df.select("shingle", "share", F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("component", "n", "rest", "main")])
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("id"), F.ceil(F.col("kept") / SHARE)).cast("int"))
    # of two rows that are both copied, the one of greater id meets the other
    good = (F.col("component_x") != F.col("component_y")) & (F.col("main_y") | (F.col("x") > F.col("y"))) & _fits("n_x", "n_y", percent)
    good = good & _follows(F.least("rest_x", "rest_y"), "n_x", "n_y", percent)
    met = side(_copied(rows), "x").join(shuffled(side(dealt, "y")), ["shingle", "share"]).filter(good)
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, k=2)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
