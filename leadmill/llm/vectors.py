"""Vector code compression: product codes of integer vectors, assigned through a trie over distinct parts.

A vector's components become integers, its integers are cut into equal consecutive parts, and each part is named by the
nearest entry of its position's codebook. Codebooks are fitted by rounds of assignment and averaging:

- Parts that occur often are assigned once. All distinct parts are counted, dealt out in lexicographic ranges and sorted,
  so each task holds neighbouring subtrees of the trie over them.
- The trie is walked depth first, a block of leaves at a time. A node's vector holds the distances of its prefix to all
  entries of the codebook; parts that share a prefix share it, within a block and, by the path kept to the last leaf,
  from block to block. Where a path no longer branches, the rest of it is added by one matrix product.
- Leaves take the least entry, ties to the lower index, and add their components, times their uses, to its sums.
- At the end each batch of vectors walks the trie of its own distinct parts, so no vector has to be joined.

Codebooks are of fixed size (parts x entries x components). Sums are exact: numbers are floats only as long as every
distance is an integer that a double holds, and Python's integers beyond.

Vectors that are null or hold null or non-finite components are dropped. The dimension is that of the first kept vector;
vectors of another one are returned with null code and error. Parts are filled up with zeros where the dimension can't be
divided. Components are held within 2^40, a distance beyond the range of long is that range's end. Codebooks start from
the vectors of least id, null ids last, ties by components; fewer vectors than entries make fewer entries. Repeated rows
are rows. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadmill.llm.common import maybe_broadcast, table, written

#: Leaves that are walked together.
BLOCK = 2048
LARGEST = 1 << 40
_LONG = (1 << 63) - 1
_EXACT = 1 << 53


def is_sound(vector: str) -> Column:
    """Column: the vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(lists: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """(vector, part, component) of sound vectors of one dimension."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = np.clip(np.floor(x * scale), -LARGEST, LARGEST).astype(np.int64)
    wide = -(-dim // parts)
    return np.pad(x, ((0, 0), (0, wide * parts - dim))).reshape(len(x), parts, wide)


class PartTrie:
    """Depth-first walk over sorted parts of one position, against that position's codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.path: list[np.ndarray] = []  # of the last leaf: distances of its first 1, 2, ... components
        self.last: np.ndarray | None = None

    def walk(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and distance of each part."""
        got = [self._block(parts[i : i + BLOCK]) for i in range(0, len(parts), BLOCK)]
        return np.concatenate([e for e, _ in got] or [np.zeros(0, int)]), np.concatenate([d for _, d in got] or [np.zeros(0)])

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dim = x.shape
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.book).max(initial=0)))
        kind = np.float64 if dim * (2 * most) ** 2 < _EXACT else object
        x, book = x.astype(kind), self.book.astype(kind)
        # components that each part shares with the one before it
        before = np.vstack([x[:1] if self.last is None else self.last[None].astype(kind), x[:-1]])
        differs = np.hstack([x != before, np.ones((n, 1), bool)])
        shared = differs.argmax(1)
        if self.last is None:
            shared[0] = 0
        # a part's path is its own, without branches, after the components that a neighbour shares, and one more
        branches = np.minimum(np.maximum(shared, np.append(shared[1:], 0)) + 1, dim)
        path, node_of, above = [], np.zeros(n, int), np.zeros((1, len(book)), kind)
        for d in range(int(branches.max(initial=0))):
            live = branches > d
            new = (shared <= d) & live
            carried = shared[0] > d  # the first nodes are the last block's
            rows = np.flatnonzero(new)
            made = above[node_of[rows]] + (x[rows, d, None] - book[:, d]) ** 2
            if carried:
                made = np.vstack([self.path[d][None] if d < len(self.path) else self._prefix(before[0], book, d)[None], made])
            inner = np.maximum(np.cumsum(new) - 1 + carried, 0)
            # parts whose path ended above keep that node
            ended, held = ~live, node_of
            node_of = np.where(live, inner, len(made) + held)
            path.append(made[node_of[-1]] if live[-1] else None)
            above = np.vstack([made, above]) if ended.any() else made
        at = np.arange(dim) >= branches[:, None]
        tail = np.where(at, x, x.dtype.type(0) if kind is not object else 0)
        rest = np.vstack([np.zeros((1, len(book)), kind), np.cumsum(book[:, ::-1].T ** 2, axis=0)])[::-1]  # squares from a component on
        far = above[node_of] + (tail**2).sum(1)[:, None] - 2 * (tail @ book.T) + rest[branches]
        entry = far.argmin(1)
        self.path = path[: next((i for i, v in enumerate(path) if v is None), len(path))]
        self.last = x[-1]
        return entry, far[np.arange(n), entry]

    @staticmethod
    def _prefix(x: np.ndarray, book: np.ndarray, d: int) -> np.ndarray:
        return ((x[: d + 1] - book[:, : d + 1]) ** 2).sum(1)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([min(int(v), _LONG) for v in x], np.int64) if x.dtype == object else x.astype(np.int64)


def distinct_parts(vectors: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """(position, part, uses) of all vectors' distinct parts in lexicographic ranges, written."""

    def cut(batches):
        for b in batches:
            x = integers(b.column(0), dim, parts, scale)
            for p in range(parts):
                own, uses = np.unique(x[:, p], axis=0, return_counts=True)
                ends = pa.array(np.arange(len(own) + 1) * x.shape[2], pa.int32())
                yield pa.record_batch([pa.array(np.full(len(own), p), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(own.reshape(-1), pa.int64())), pa.array(uses, pa.int64())], ["position", "part", "uses"])

    rows = vectors.mapInArrow(cut, "position int, part array<long>, uses long").groupBy("position", "part").agg(F.sum("uses").alias("uses"))
    return written(rows.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")


def refitted(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the mean, rounded down, of the parts nearest to it."""
    n, entries, wide = books.shape

    def sums(batches):
        tries, total, count = [PartTrie(b) for b in books], np.zeros((n, entries, wide), object), np.zeros((n, entries), object)
        for b in batches:
            position, uses = b.column(0).to_numpy(), b.column(2).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, wide)
            for p in np.unique(position):
                own = position == p
                entry, _ = tries[p].walk(x[own])
                order = np.argsort(entry, kind="stable")
                hit, first = np.unique(entry[order], return_index=True)
                small = int(np.abs(x[own]).max(initial=0)) * int(uses[own].sum()) < _LONG
                used = uses[own][order] if small else uses[own][order].astype(object)
                total[p, hit] += np.add.reduceat(x[own][order] * used[:, None], first, axis=0)
                count[p, hit] += np.add.reduceat(used, first)
        at = np.argwhere(count > 0)
        if len(at):
            sums_ = pa.array([[int(v) for v in total[p, e]] for p, e in at], pa.list_(pa.decimal128(38, 0)))
            yield pa.record_batch([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array([int(count[p, e]) for p, e in at], pa.int64()), sums_], ["position", "entry", "uses", "sums"])

    rows = parts.mapInArrow(sums, "position int, entry int, uses long, sums array<decimal(38,0)>").groupBy("position", "entry")
    out = books.copy()
    for r in rows.agg(F.sum("uses").alias("uses"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(wide)]).alias("sums")).collect():  # a row an entry
        out[r.position, r.entry] = [int(s) // r.uses for s in r.sums]
    return out


def fitted(vectors: DataFrame, vector: str, id_: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[np.ndarray, int]:
    """Codebooks (part, entry, component) of the sound vectors, and their dimension."""
    kept = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("vector")).filter(is_sound("vector"))
    head = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(1).collect()
    if not head:
        return np.zeros((parts, 0, 0), np.int64), 0
    dim = len(head[0].vector)
    kept = kept.filter(F.size("vector") == dim)
    head = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    books = integers(pa.array([r.vector for r in head], pa.list_(pa.float64())), dim, parts, scale).transpose(1, 0, 2)
    if dim:
        counted = distinct_parts(kept.select("vector"), dim, parts, scale)
        for _ in range(rounds):
            books = refitted(counted, books)
    return books, dim


def coded(vectors: DataFrame, books: np.ndarray, dim: int, vector: str, scale: int = 1024) -> DataFrame:
    """The sound vectors' rows with code (two hex digits a part) and error in place of the vector."""
    rest = [c for c in vectors.columns if c != vector]
    parts = len(books)
    schema = vectors.select(*rest).schema.add("code", "string").add("error", "long")

    def encode(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index(vector))
            fits = np.array([len(v) == dim if v is not None else False for v in lists], bool)
            x = integers(lists.filter(pa.array(fits)), dim, parts, scale) if dim else np.zeros((int(fits.sum()), parts, 0), np.int64)
            entry, error = np.zeros(x.shape[:2], np.uint8), np.zeros(len(x), object)
            for p in range(parts if dim else 0):
                own, at = np.unique(x[:, p], axis=0, return_inverse=True)
                e, far = PartTrie(books[p]).walk(own)
                entry[:, p] = e[at.reshape(-1)]
                error += _whole(far)[at.reshape(-1)].astype(object)
            codes = iter(zip([r.tobytes().hex() for r in entry], [min(int(v), _LONG) for v in error], strict=True))
            both = [next(codes) if f else (None, None) for f in fits]
            yield pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in rest], pa.array([c for c, _ in both], pa.string()), pa.array([e for _, e in both], pa.int64())], [*rest, "code", "error"])

    return vectors.filter(is_sound(vector)).mapInArrow(encode, schema)


def decoded(code: str, books: np.ndarray) -> Column:
    """Column: the integers that a code stands for."""

    @F.arrow_udf("array<long>")
    def decode(codes: pa.Array) -> pa.Array:
        return pa.array([None if c is None else np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(c))]).tolist() for c in codes.to_pylist()], pa.list_(pa.int64()))

    return decode(F.col(code))


def codebooks_sha256(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books, dim = fitted(vectors, "embedding", "vec_id")
    rows = written(coded(vectors, books, dim, "embedding"), "codes")
    labels = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    labels = maybe_broadcast(labels.withColumnRenamed("label", "_label"))
    out = rows.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one assignment to the codebooks k and, from it, of codebooks k + 1."""
    return f"""
a{k} AS (SELECT p, part, any_value(uses) AS uses, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
  SELECT a.p, a.part, a.uses, b.e, CAST(list_dot_product(a.x, a.x) - 2 * list_dot_product(a.x, b.x) + list_dot_product(b.x, b.x) AS BIGINT) AS d
  FROM parts a JOIN b{k} b ON a.p = b.p) GROUP BY p, part),
s{k} AS (SELECT p, e, i, CAST(sum(uses * part[i]) AS BIGINT) AS s, CAST(sum(uses) AS BIGINT) AS n FROM a{k}, range(1, 17) t(i) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM s{k} GROUP BY p, e),
b{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)"""


#: For vectors of 64 components.
OP11_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT p, part, count(*) AS uses, CAST(part AS DOUBLE[]) AS x FROM (SELECT p, v[p * 16 + 1 : p * 16 + 16] AS part FROM kept, range(4) t(p)) GROUP BY p, part),
b0 AS (SELECT p, e, CAST(v[p * 16 + 1 : p * 16 + 16] AS DOUBLE[]) AS x FROM (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept), range(4) t(p) WHERE e < 256),
{",".join(_round(k) for k in range(5))},
coded AS (SELECT k.vec_id, any_value(k.label) AS label, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, CAST(sum(a.d) AS BIGINT) AS error
  FROM (SELECT vec_id, label, v, p FROM kept, range(4) t(p)) k JOIN a4 a ON a.p = k.p AND a.part = k.v[k.p * 16 + 1 : k.p * 16 + 16] GROUP BY k.vec_id),
books AS (SELECT sha256(string_agg(array_to_string(CAST(CAST(x AS BIGINT[]) AS VARCHAR[]), ','), ',' ORDER BY p, e)) AS h FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, books"""
