"""Token ids in binary files: canonical length-limited Huffman coding of ids from global counts.

Files are Parquet tables of independent blocks. A block holds whole documents in ascending id order: their ids, token
counts and texts' order, the bits of all their tokens, and a bit offset every STRIDE tokens. Code lengths come from
package merging with at most MAX_BITS bits, codes are canonical, so the lengths alone rebuild them; lengths are a second
small table. Decoding peeks MAX_BITS bits at each checkpoint of a block, looks symbol and length up in one table and
steps all checkpoints on side by side.

Tables under a path: `lengths` (id, bits), `blocks` (part, block, first token, documents, bits, offsets); while they are
made also `tokens` (the documents' ids as they come, and each task's counts). Parts are ranges of document ids; a part's
place among all tokens is the sum of those before it, found from one row a part.

Null and empty texts have the end id alone. A null doc_id comes before all others. Rows that repeat a doc_id are kept, in order of their tokens' checksum.
Texts are encoded whole. Empty tables give empty files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadmill.llm.bpe import codec
from leadmill.llm.common import dropped, shared_folder, table

MAX_BITS = 20
#: Tokens between two checkpoints.
STRIDE = 256
#: A block ends with the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 19
#: Tokens whose bits are packed at once.
PACKED = 1 << 17
END_ID = 1


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Bits of each id with a count, at most limit, of least total length (package merging)."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    coins = sorted((n, i) for i, n in counts.items())
    weight = np.array([n for n, _ in coins], np.int64)
    # rows of merged packages by level; each package is two neighbours of the level below
    levels = [weight]
    for _ in range(limit - 1):
        below = levels[-1]
        packages = below[0 : len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        levels.append(np.sort(np.concatenate((weight, packages)), kind="stable"))
    lengths = np.zeros(len(coins), np.int64)
    take = 2 * len(coins) - 2
    for level in range(limit - 1, -1, -1):
        if level == 0:
            lengths[:take] += 1
            break
        packages = levels[level - 1][0 : len(levels[level - 1]) // 2 * 2].reshape(-1, 2).sum(axis=1)
        # of the first `take` of this level, how many are coins: merge order puts coins first on ties
        order = np.argsort(np.concatenate((weight, packages)), kind="stable")[:take]
        own = int((order < len(weight)).sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    return {i: int(b) for (_, i), b in zip(coins, lengths, strict=True)}


class Code:
    """Canonical code of given lengths, with tables to encode and decode."""

    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        size = 1 + max(order, default=0)
        self.bits, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint32)
        self.symbol, self.length = np.zeros(1 << MAX_BITS, np.int32), np.ones(1 << MAX_BITS, np.int8)
        code = last = 0
        for i in order:
            n = lengths[i]
            code <<= n - last
            last = n
            self.bits[i], self.code[i] = n, code
            at, span = code << (MAX_BITS - n), 1 << (MAX_BITS - n)
            self.symbol[at : at + span], self.length[at : at + span] = i, n
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ids, and the bit offset of every STRIDE-th."""
        n = self.bits[ids]
        ends = np.cumsum(n)
        at = ends - n
        bits = int(ends[-1]) if len(ends) else 0
        out = np.zeros((bits >> 5) + 2, np.uint64)
        for k in range(0, len(ids), PACKED):  # each code lies in two neighbouring 32-bit words, and shares no bit
            p, m = at[k : k + PACKED], n[k : k + PACKED]
            both = self.code[ids[k : k + PACKED]].astype(np.uint64) << (64 - (p & 31) - m).astype(np.uint64)
            first = int(p[0]) >> 5
            word = (p >> 5) - first
            size = int(word[-1]) + 2
            sums = np.bincount(word, both >> np.uint64(32), size) + np.bincount(word + 1, both & np.uint64(0xFFFFFFFF), size)
            out[first : first + size] += sums.astype(np.uint64)
        return out.astype(">u4").tobytes()[: (bits + 7) // 8], at[::STRIDE]

    def decode(self, packed: bytes, offsets: np.ndarray, count: int) -> np.ndarray:
        """The ids again, all checkpoints side by side."""
        data = packed + bytes(8)
        windows = np.ndarray((len(packed) + 4,), ">u4", data, strides=(1,))  # 32 bits from each byte on
        at = offsets.astype(np.int64).copy()
        out = np.zeros((len(at), STRIDE), np.int32)
        for step in range(STRIDE):
            live = len(at) if step < count - (len(at) - 1) * STRIDE else len(at) - 1
            p = at[:live]
            peek = (windows[p >> 3].astype(np.int64) >> (32 - MAX_BITS - (p & 7))) & ((1 << MAX_BITS) - 1)
            out[:live, step] = self.symbol[peek]
            at[:live] += self.length[peek]
        return out.reshape(-1)[:count]


TOKENS = "doc_id long, sum long, ids binary, id int, uses long"


def _encoded(vocabulary: str | None, end_id: int | None):
    """Rows of TOKENS: of each document its ids and their checksum; at the task's end, of each id its uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        uses = np.zeros(max(len(c.token_bytes), (end_id or 0) + 1), np.int64)
        kind = f"<u{_width(len(uses))}"

        def rows(doc_ids, sums, ids, of, n):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((doc_ids, pa.int64()), (sums, pa.int64()), (ids, pa.binary()), (of, pa.int32()), (n, pa.int64()))], names=["doc_id", "sum", "ids", "id", "uses"])

        for batch in batches:
            ends, ids = c.encode_array(batch.column("text"))
            if end_id is not None:
                ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
            uses += np.bincount(ids, minlength=len(uses))
            raw, at = ids.astype(kind).tobytes(), (ends * int(kind[-1])).tolist()
            own, none = [raw[a:b] for a, b in pairwise(at)], [None] * batch.num_rows
            yield rows(batch.column("doc_id"), [zlib.crc32(b) for b in own], own, none, none)
        there = np.flatnonzero(uses)
        none = [None] * len(there)
        yield rows(none, none, none, there, uses[there])

    return run


def _width(ids: int) -> int:
    """Bytes of an id of so many."""
    return 2 if ids <= 1 << 16 else 4


def _blocked(code, width: int):
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple] = []
        size = 0

        def out():
            nonlocal docs, size, number, first
            ids = np.frombuffer(b"".join(d[2] for d in docs), f"<u{width}").astype(np.int64)
            packed, offsets = code.value.encode(ids)
            row = [[part], [number], [first], [len(ids)], [[d[0] for d in docs]], [[d[1] for d in docs]], [packed], [offsets.tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            number, first, docs, size = number + 1, first + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "first", "n_tokens", "doc_ids", "doc_tokens", "packed", "offsets"])

        for batch in batches:
            for doc_id, b in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                b = b.as_py()
                docs.append((doc_id, len(b) // width, b))
                size += len(b) // width
                if size >= BLOCK_TOKENS:
                    yield out()
        if docs:
            yield out()

    return block


BLOCKS = "part int, block int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, packed binary, offsets array<long>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = END_ID) -> None:
    """Encodes docs(doc_id, text) and writes the three tables under path."""
    spark = docs.sparkSession
    width = _width(max(len(codec(vocabulary or public_tokenizers.path("word_bpe_49k.json")).token_bytes), (end_id or 0) + 1))
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(vocabulary, end_id), TOKENS).write.parquet(f"{path}/tokens")
    tokens = spark.read.schema(TOKENS).parquet(f"{path}/tokens")
    counts = tokens.filter("id is not null").groupBy("id").agg(F.sum("uses").alias("uses"))
    lengths = code_lengths({r.id: r.uses for r in counts.collect()})  # a row for each id of the vocabulary at most
    spark.createDataFrame([*lengths.items()], "id long, bits int").coalesce(1).write.parquet(f"{path}/lengths")
    code = spark.sparkContext.broadcast(Code(lengths))
    # ranges of ids; rows of one id are told apart by their tokens
    ordered = tokens.filter("ids is not null").select("doc_id", "sum", "ids").repartitionByRange("doc_id", "sum").sortWithinPartitions("doc_id", "sum").select("doc_id", "ids")
    ordered.mapInArrow(_blocked(code, width), BLOCKS).write.parquet(f"{path}/blocks")
    dropped(spark, f"{path}/tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids: array<int>) of each document, in blocks of the files."""
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: (pa.array(ids, pa.list_(pa.int32())), "ids"))


def _decoded(spark: SparkSession, path: str, schema: str, last) -> DataFrame:
    lengths = {r.id: r.bits for r in spark.read.schema("id long, bits int").parquet(f"{path}/lengths").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row a part
    before = dict(zip((p for p, _ in parts), np.cumsum([0, *(n for _, n in parts)]).tolist(), strict=False))
    code = spark.sparkContext.broadcast((Code(lengths), before))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, starts = code.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = table_.decode(row["packed"], np.array(row["offsets"], np.int64), row["n_tokens"])
                n = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                column, name = last([ids[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts[row["part"]] + row["first"] + ends - n, pa.int64()), pa.array(n, pa.int64()), column], names=["doc_id", "start", "n_tokens", name])

    return blocks.mapInArrow(decode, schema)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum of each document's ids as little-endian 32-bit integers."""
    sums = lambda ids: (pa.array([zlib.crc32(i.astype("<u4", copy=False)) for i in ids], pa.int64()), "ids_crc32")
    return _decoded(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", sums)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_checksums(spark, path)
