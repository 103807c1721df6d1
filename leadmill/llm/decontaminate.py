"""Benchmark decontamination by winnowing. DataFrame functions only.

Each text is a list of words. Of every WINDOW consecutive k-gram hashes the least is kept, leftmost on ties, so any two
texts that share K + WINDOW - 1 words in a row keep a common fingerprint within them. Fingerprints of documents and
items are joined, and each hit is extended word by word to both sides as far as the guarantee reaches: where the whole
is SPAN words or more, its words are hit, and the union of all hits is every shared window of SPAN words. Items shorter
than SPAN are one fingerprint of all their words, looked up among the document's word runs of that length.

Items' fingerprints are broadcast up to BROADCAST_FINGERPRINTS; beyond, the join shuffles both sides by hash. A
document's hits stay in its task until they are united, so no key gathers rows of other documents.
A null or empty text has no words and no hits; repeated rows are each judged, also where ids repeat; rows of one
item_id are one item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadmill.llm.common import indices, let, shuffled, table, written

#: Words of a shared span that counts.
SPAN = 13
K = 5
WINDOW = SPAN - K + 1
#: At about 0.5 kB each.
BROADCAST_FINGERPRINTS = 200_000
_REACH = SPAN - K


def words_of(text: Column) -> Column:
    """A-Z lower-cased; runs of digits, letters a-z and characters beyond ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_hashes(words: Column) -> Column:
    """Hash of each K-gram."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(indices(F.size(h) - (K - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)])))


def winnowed(hashes: Column) -> Column:
    """Distinct starts of the K-grams that are least in some window."""
    least = lambda part, j: j + F.array_position(part, F.array_min(part)).cast("int") - 1
    return F.array_distinct(F.transform(indices(F.size(hashes) - (WINDOW - 1)), lambda j: let(F.slice(hashes, j + 1, WINDOW), lambda part: least(part, j))))


def fingerprints(words: Column, short: list[int], row=None) -> Column:
    """Array of (hash, start, n, lead, around, and an empty field of the type row if given): winnowed K-grams (n = 0) with the words that the guarantee reaches, lead
    of them before the gram; and every run of each length n in short. Carrying these few words, not the whole list,
    keeps a row for each hit small, however long the text."""

    def entry(h: Column, i: Column, n: int) -> Column:
        lead = F.least(i, F.lit(_REACH)) if n == 0 else F.lit(0)
        around = F.slice(words, i - lead + 1, lead + K + _REACH if n == 0 else F.lit(n))
        return F.struct(h.alias("hash"), i.cast("int").alias("start"), F.lit(n).alias("n"), lead.cast("int").alias("lead"), around.alias("around"), *empty)

    empty = [F.lit(None).cast(row).alias("row")] if row else []
    out = let(gram_hashes(words), lambda h: F.transform(winnowed(h), lambda i: entry(F.get(h, i), i, 0)))
    runs = lambda n: F.transform(indices(F.size(words) - (n - 1)), lambda i: entry(F.xxhash64(F.slice(words, i + 1, n), F.lit(n)), i, n))
    return F.concat(out, *map(runs, short)) if short else out


def item_index(items: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """Fingerprints of the items with the words around them, and the lengths below SPAN that occur."""
    items = items.select(F.col(item).cast("string").alias("_item"), words_of(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    short = sorted(r.n for r in items.select(F.size("_w").alias("n")).filter(F.col("n") < SPAN).distinct().collect())  # SPAN - 1 rows at most
    long = items.filter(F.size("_w") >= SPAN).select("_item", F.explode(fingerprints(F.col("_w"), [])).alias("f"))
    long = long.select(F.col("f.hash").alias("_hash"), F.col("f.n").alias("_n"), F.col("f.lead").alias("_lead"), F.col("f.around").alias("_around"), "_item")
    small = items.filter(F.size("_w") < SPAN).select(F.xxhash64("_w", F.size("_w")).alias("_hash"), F.size("_w").alias("_n"), F.lit(0).alias("_lead"), F.col("_w").alias("_around"), "_item")
    return long.unionByName(small).groupBy("_hash", "_n", "_lead", "_around").agg(F.collect_set("_item").alias("_items")), short


def _extended(f: Column, lead: Column, around: Column) -> Column:
    """(from, to) of the words that doc and item share at this hit; null if they are fewer than asked for."""
    some = lambda count, same: F.when(count > 0, F.size(F.filter(F.sequence(F.lit(1), count), same))).otherwise(0)
    left = some(F.least(f.lead, lead), lambda e: F.slice(f.around, f.lead - e + 1, e) == F.slice(around, lead - e + 1, e))
    right = some(F.least(F.size(f.around) - f.lead, F.size(around) - lead) - K, lambda e: F.slice(f.around, f.lead + K + 1, e) == F.slice(around, lead + K + 1, e))
    core = F.slice(f.around, f.lead + 1, K) == F.slice(around, lead + 1, K)
    long = F.when(core & (left + K + right >= SPAN), F.struct((f.start - left).alias("a"), (f.start + K + right).alias("b")))
    return F.when(f.n > 0, F.when(f.around == around, F.struct(f.start.alias("a"), (f.start + f.n).alias("b")))).otherwise(long)


def _united(spans: Column) -> Column:
    """Number of words that spans cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, s.reach))).alias("n"), F.greatest(s.reach, x.b).alias("reach"))
    return F.aggregate(F.sort_array(spans), zero, step, lambda s: s.n)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_hit, item_ids (sorted as strings), n_items and contaminated to each row. keep: the columns of docs to
    carry along, all if None; what is carried goes through a shuffle once a row."""
    index, short = item_index(items, item, item_text)
    index = written(index, "fingerprints")
    small = index.count() <= BROADCAST_FINGERPRINTS
    index = F.broadcast(index) if small else shuffled(index)
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "item_ids", "n_items", "contaminated")]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *own, words_of(F.col(text)).alias("_words"))
    rows = rows.withColumn("_n_words", F.size("_words").cast("long"))
    # one more entry for each document carries its columns: fingerprints travel without them, however many a long text has
    row = F.struct(*own, "_n_words")
    rows = rows.withColumn("_prints", fingerprints(F.col("_words"), short, rows.select(row).schema[0].dataType)).drop("_words")
    none = {"hash": "long", "start": "int", "n": "int", "lead": "int", "around": "array<string>"}
    keeper = F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in none.items()], row.alias("row")))
    rows = rows.select("_row", F.explode(F.concat("_prints", keeper)).alias("_f")).withColumn("_own", F.col("_f.row"))
    # the entries of documents have keys of their own, that no item has, so that they don't meet in one task
    key = {"_hash": F.coalesce("_f.hash", F.xxhash64("_row")), "_n": F.coalesce("_f.n", F.lit(-1))}
    rows = rows.withColumns(key).join(index, ["_hash", "_n"], "left").filter("_f.hash is null or _items is not null")
    span = F.when(F.col("_f.hash").isNotNull(), _extended(F.col("_f"), F.col("_lead"), F.col("_around")))
    rows = rows.select("_row", "_own", "_f.hash", "_items", span.alias("_span")).filter("hash is null or _span is not null")
    found = rows.groupBy("_row").agg(F.first("_own", ignorenulls=True).alias("_own"), F.collect_set("_span").alias("_spans"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"))
    found = found.select(*[F.col("_own")[c].alias(c) for c in own], F.col("_own._n_words").alias("n_words"), _united(F.col("_spans")).cast("long").alias("n_hit"), F.array_sort("_items").alias("item_ids"))
    return found.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    got = contamination(docs, items, keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_W} AS w FROM documents),
i AS (SELECT item_id, {_W} AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT k, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT k, p, n, item_id FROM dw JOIN win USING (n, g)),
pos AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM hits) GROUP BY k),
its AS (SELECT k, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM hits GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)"""
