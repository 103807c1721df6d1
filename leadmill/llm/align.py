"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both sides tile the bytes of space + text. In batches of documents, pandas.merge_asof, keyed by document, finds for each
token's start the other side's token that covers it; the union of both directions holds every overlap. Overlapping tokens
with equal ends close a group, and all A-B pairs of a group are links.

How many documents hold a pair of ids linked is counted in two steps, so that no row a document and pair is shuffled:
documents are packed into chunks of some megabytes of text, each chunk lists its distinct pairs with the number of its
documents, and pairs are summed over chunks. The counts then go back to the chunks that asked, where each document's
links are looked up. The largest count of each A id is a table of at most a row an id and is broadcast.

A is a byte-level BPE file, B a sentencepiece model; special tokens' strings in texts are plain text. Null and empty texts,
and texts whose bytes either side doesn't give back (B may normalize), have no tokens: zeros and an empty groups_sha256.
Texts are aligned whole, whatever their length; a group of very many tokens is reduced to its distinct ids first. Rows
that repeat an id are documents of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from leadmill.llm.bpe import codec
from leadmill.llm.common import dropped, shared_folder, table, written

#: Bytes of text that are aligned at once, and that share a list of pairs.
PART_BYTES = 2_000_000
CHUNK_BYTES = 8_000_000
#: Groups of more links are reduced to distinct ids.
WIDE = 4096


def _table(strings: list[bytes]) -> pa.Array:
    return pa.array(strings, pa.large_binary())


def joined(strings: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Ends, from 0 on, of the chosen strings, and all of them one after the other."""
    got = strings.take(pa.array(chosen))
    ends = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1] if len(got) else np.zeros(1, np.int64)
    return ends, got.buffers()[2].to_pybytes() if got.buffers()[2] else b""


class TokenizerPair:
    """Both tokenizers, the bytes of their tokens and their decimal ids with what may follow."""

    def __init__(self, a: str, b: str):
        self.a, self.b = codec(a, special=False), sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = [_table(self.a.token_bytes), _table(b_bytes)]
        self.sizes = [np.array([len(x) for x in own], np.int64) for own in (self.a.token_bytes, b_bytes)]
        self.ids_b = len(b_bytes)
        self.decimal = _table([b"%d%s" % (i, tail) for n, tails in ((len(self.a.token_bytes), (b",", b"|")), (len(b_bytes), (b",", b";", b""))) for tail in tails for i in range(n)])

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers of tokens of each text, all ids) of A and of B."""
        ends, ids = self.a.encode_array(pa.array([" " + t for t in texts], pa.large_string()))
        own = self.b.encode(texts, num_threads=1)
        return [(np.diff(ends), ids.astype(np.int64)), (np.fromiter(map(len, own), np.int64, len(own)), np.fromiter(chain.from_iterable(own), np.int64))]

    def gives_back(self, side: int, counts: np.ndarray, ids: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Whether each text's tokens are its bytes."""
        at, data = joined(self.bytes[side], ids)
        at = at[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return np.array([data[i:j] == w for i, j, w in zip(at[:-1], at[1:], want, strict=True)], bool)


@lru_cache(1)
def tokenizers(a: str, b: str) -> TokenizerPair:
    return TokenizerPair(a, b)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(a, b): numbers of all overlapping tokens, of frames with doc, start and no, sorted by start."""
    left, right = a.rename(columns={"no": "a"}), b.rename(columns={"no": "b"})
    of_a = pd.merge_asof(left, right, on="start", by="doc")
    of_b = pd.merge_asof(right.rename(columns={"start": "at"}), left, left_on="at", right_on="start", by="doc")
    of_b = of_b[of_b["at"] != of_b["start"]]  # equal starts are found from both sides
    return pd.concat([of_a[["a", "b"]], of_b[["a", "b"]]], ignore_index=True)


@dataclass
class Aligned:
    """Tokens of some documents in groups; groups are numbered through."""

    counts: list[np.ndarray]  # of tokens by document, A and B
    ids: list[np.ndarray]
    group: list[np.ndarray]  # of each token
    group_doc: np.ndarray

    @property
    def sizes(self) -> list[np.ndarray]:
        """Numbers of tokens of each group."""
        return [np.bincount(g, minlength=len(self.group_doc)) for g in self.group]

    def links(self, ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times), distinct by document and pair and sorted by them."""
        n_a, n_b = self.sizes
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        many = n_a * n_b
        wide = np.flatnonzero(many > WIDE)
        many[wide] = 0
        of = np.repeat(np.arange(len(many)), many)
        k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        pair = self.ids[0][first_a[of] + k // n_b[of]] * ids_b + self.ids[1][first_b[of] + k % n_b[of]]
        doc, times = self.group_doc[of], np.ones(len(of), np.int64)
        for g in wide:
            x, u = np.unique(self.ids[0][first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            y, v = np.unique(self.ids[1][first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            pair = np.concatenate([pair, (x[:, None] * ids_b + y).reshape(-1)])
            times = np.concatenate([times, (u[:, None] * v).reshape(-1)])
            doc = np.concatenate([doc, np.full(len(x) * len(y), self.group_doc[g])])
        if not len(pair):
            return doc, pair, times
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))))
        return doc[first], pair[first], np.add.reduceat(times, first)

    def digests(self, both: TokenizerPair) -> list[str]:
        """SHA-256 of each document's groups as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        n_a, n_b = self.sizes
        through_a, through_b = np.cumsum(n_a), np.cumsum(n_b)
        a, b = len(self.ids[0]), len(self.ids[1])
        code = np.zeros(a + b, np.int64)
        place = np.arange(a) + (through_b - n_b)[self.group[0]]
        code[place] = self.ids[0] + len(both.sizes[0]) * (np.arange(a) + 1 == through_a[self.group[0]])
        last = np.arange(b) + 1 == through_b[self.group[1]]
        last_doc = np.concatenate((self.group_doc[1:] != self.group_doc[:-1], [True]))[self.group[1]] if b else last
        code[np.arange(b) + through_a[self.group[1]]] = 2 * len(both.sizes[0]) + self.ids[1] + both.ids_b * (last.astype(np.int64) + (last & last_doc))
        at, raw = joined(both.decimal, code)
        ends = at[np.concatenate(([0], np.cumsum(self.counts[0] + self.counts[1])))].tolist()
        return [hashlib.sha256(raw[i:j]).hexdigest() if j > i else "" for i, j in zip(ends[:-1], ends[1:], strict=True)]


def aligned(texts: list[str | None], both: TokenizerPair) -> Aligned:
    """The texts' tokens in groups."""
    given = [t or "" for t in texts]
    coded = both.encoded(given)
    want = [b" " + t.encode() for t in given]
    good = np.array([bool(t) for t in given], bool)
    for side, (counts, ids) in enumerate(coded):
        good &= both.gives_back(side, counts, ids, want)
    counts, ids, frames, ends = [], [], [], []
    for side, (n, tokens) in enumerate(coded):
        tokens = tokens[np.repeat(good, n)]
        n = np.where(good, n, 0)
        size = both.sizes[side][tokens]
        end = np.cumsum(size)  # documents lie one after the other, each side of a document has as many bytes
        counts.append(n)
        ids.append(tokens)
        ends.append(end)
        frames.append(pd.DataFrame({"doc": np.repeat(np.arange(len(n)), n), "start": end - size, "no": np.arange(len(tokens))}))
    met = overlaps(*frames)
    a, b = met["a"].to_numpy(), met["b"].to_numpy()
    cuts = np.sort(ends[0][a[ends[0][a] == ends[1][b]]])  # equal ends close a group
    doc_ends = np.cumsum(np.bincount(frames[0]["doc"], both.sizes[0][ids[0]], len(given)).astype(np.int64))
    return Aligned(counts, ids, [np.searchsorted(cuts, e) for e in ends], np.searchsorted(doc_ends, cuts))


_CHUNKS = "chunk string, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<long>, pairs array<long>, docs array<int>"
_OWN = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


@dataclass
class Chunk:
    """Documents that share a list of distinct pairs."""

    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    size: int = 0
    rows: list[tuple] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)

    def add(self, ids: list, texts: list, size: int, both: TokenizerPair) -> None:
        got = aligned(texts, both)
        doc, pair, times = got.links(both.ids_b)
        n_a, n_b = got.sizes
        groups = np.bincount(got.group_doc, minlength=len(ids))
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, got.group_doc, n_a * n_b)
        base = len(self.rows)
        self.rows += zip(ids, got.counts[0].tolist(), got.counts[1].tolist(), groups.tolist(), links.tolist(), got.digests(both), strict=True)
        self.links.append(np.stack([doc + base, pair, times]))
        self.size += size

    def batch(self) -> pa.RecordBatch:
        doc, pair, times = np.concatenate(self.links, axis=1)
        pairs, at, docs = np.unique(pair, return_inverse=True, return_counts=True)
        ends = np.append(np.searchsorted(doc, np.arange(len(self.rows))), len(doc))
        schema = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([*own, None], t) for own, t in zip([[self.name] * len(self.rows), *map(list, zip(*self.rows, strict=True))], schema, strict=True)]
        columns[0] = pa.array([self.name] * (len(self.rows) + 1))
        ends = pa.array(np.append(ends, ends[-1]), pa.int32())
        columns += [pa.ListArray.from_arrays(ends, pa.array(at.reshape(-1), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
        only = pa.array([None] * len(self.rows) + [0, len(pairs)], pa.int32())
        columns += [pa.ListArray.from_arrays(only, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(only, pa.array(docs, pa.int32()))]
        return pa.record_batch(columns, [c.split()[0] for c in _CHUNKS.split(", ")])


def chunks(docs: DataFrame, a: str | None, b: str | None) -> DataFrame:
    """A row a document with its links, and one a chunk with the chunk's pairs, of docs(id, text)."""

    def pack(batches):
        both = tokenizers(a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model"))
        chunk, ids, texts, size = Chunk(), [], [], 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(id_)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= PART_BYTES or len(ids) >= 10_000:
                    chunk.add(ids, texts, size, both)
                    ids, texts, size = [], [], 0
                if chunk.size >= CHUNK_BYTES:
                    yield chunk.batch()
                    chunk = Chunk()
        if ids:
            chunk.add(ids, texts, size, both)
        if chunk.rows:
            yield chunk.batch()

    return docs.mapInArrow(pack, _CHUNKS)


def pair_counts(chunked: DataFrame) -> DataFrame:
    """(chunk, at, pair, n): each pair of a chunk with the number of documents corpus-wide that hold it linked."""
    asked = chunked.filter("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p")).select("chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    return asked.select("chunk", "at", "pair").join(asked.groupBy("pair").agg(F.sum("docs").alias("n")), "pair")


def alignment(docs: DataFrame, id_: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """Of each row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. a, b: vocabulary files that every
    executor has; the public ones if None."""
    spark = docs.sparkSession
    base = f"{shared_folder(spark)}/align-{uuid.uuid4().hex}"
    chunked = written(chunks(docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")), a, b), "chunks", base)
    ids_b = sentencepiece.SentencePieceProcessor(model_file=b or public_tokenizers.path("piece_bpe_32k.model")).vocab_size()
    counts = written(pair_counts(chunked), "counts", base).withColumn("a", F.floor(F.col("pair") / ids_b))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most a row an id of A's vocabulary
    answers = counts.join(F.broadcast(best), "a").select("chunk", "at", "n", (F.col("n") == F.col("most")).alias("best"))
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def look_up(own: pa.Table, got: pa.Table) -> pa.Table:
        at = got.column("at").to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = got.column("n").to_numpy(), got.column("best").to_numpy(zero_copy_only=False)
        own = own.combine_chunks()
        size = pa.compute.list_value_length(own.column("at")).to_numpy()
        where, times = own.column("at").combine_chunks().flatten().to_numpy(), own.column("times").combine_chunks().flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(size)))
        sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (best[where] * times, n[where] * times)]
        columns = {c: own.column(c) for c in _OWN} | {"n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())}
        return pa.table({c.split()[0]: columns[c.split()[0]] for c in schema.split(", ")})

    rows = chunked.filter("pairs is null").select("chunk", *_OWN, "at", "times")
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(look_up, schema)
    out = written(out.withColumnRenamed("id", id_), "alignment")
    dropped(spark, base)
    return out


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))
