"""Language-model scoring by cross-entropy difference.

Two bigram models of one vocabulary and one smoothing, matched but for their texts: the target's are the labelled rows
of good quality, the background's all documents. A document's score is the mean over its tokens of the target model's
loss less the background model's: the lower, the more it is like the target. A document's own counts are taken off the
models that counted it, so none is scored by what it taught.

Every word is a word of the vocabulary, and words, contexts and bigrams are counted exactly, under 64-bit hashes, over all
documents; of a hash, what is beyond BITS within its bucket is left out, so a key is mistaken for another of its bucket
with a chance of 3 in 10 million, however large the input. Tasks cut their documents into chunks of CHUNK tokens or one
document more. A chunk's distinct keys go, each once with its uses, to buckets that add them up and answer; its documents
are then scored with the answers. Buckets are ranges of hashes, as many as the input's size asks for; keys are sent in order,
as differences.

A sender cuts its keys into at most FAN ranges. Where there are more buckets than that, keys go there in several steps: a
relay takes one range from a FAN of senders, adds up what they have in common and cuts it into FAN narrower ranges; answers
come back the same way. A relay holds as many keys as a chunk, so messages of a step number chunks and buckets together times FAN at
most, and each holds a FANth of a chunk or so: they grow with the input, but for the logarithm that the steps are. No task or driver holds
the model, and a common bigram is one key a chunk. Probabilities are absolutely discounted and interpolated with unigrams,
those with a uniform law.

A null or empty text has no tokens and null losses and score. Repeated rows count and are scored as often as they
occur; texts are used whole. An empty target gives every document the uniform law's loss as the target's.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import count, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from leadmill.llm.common import dropped, maybe_broadcast, shared_folder, table, written

DISCOUNT = 0.75
#: Tokens of a chunk, and characters of input a bucket.
CHUNK = 1_000_000
BUCKET_CHARS = 24_000_000
#: Most ranges that a sender cuts its keys into.
FAN = 256
BITS = 44
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = re.compile(r"\w+|[^\w\s]")
_LM = StructType([StructField("n_tokens", LongType()), *(StructField(k, DoubleType()) for k in ("target_loss", "background_loss", "score"))])


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes; none as no bytes."""
    raw = np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b""


def unpacked(body: bytes, kind) -> np.ndarray:
    if not body:
        return np.empty(0, kind)
    raw = pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tree(NamedTuple):
    """Steps from chunks to buckets, and ranges that each step cuts a range into."""

    fan: int
    depth: int

    @staticmethod
    def over(buckets: int) -> Tree:
        depth = next(d for d in count(1) if FAN**d >= buckets)
        return Tree(next(f for f in count(1) if f**depth >= buckets), depth)

    @property
    def left_out(self) -> np.uint64:
        """Low bits that hashes go without."""
        return np.uint64(max(0, 64 - BITS - (self.fan**self.depth - 1).bit_length()))


class Keys(NamedTuple):
    """A chunk's bigrams and words in order of their hashes."""

    pairs: np.ndarray  # hashes, and the place of each in the order of the chunk's ids
    pair_order: np.ndarray
    words: np.ndarray
    word_order: np.ndarray


class Chunk(NamedTuple):
    """Documents of a chunk: the columns but the text, whether of the target, numbers of tokens, ids (places among the
    chunk's words by use) of each text that has tokens, its beginning included, and a hash of each word."""

    rows: pa.Table
    target: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    words: np.ndarray

    def columns(self) -> list[bytes]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(self.rows)
        return [sink.getvalue().to_pybytes(), *map(packed, self[1:])]

    @staticmethod
    def read(row: dict) -> Chunk:
        rows = pa.ipc.open_stream(row["rows"]).read_all()
        return Chunk(rows, *(unpacked(row[name], kind) for name, kind in zip(Chunk._fields[1:], ("?", "i8", "i4", "u8"), strict=True)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the word before each token and of the token."""
        there = self.sizes[self.sizes > 0]
        ids = self.ids.astype(np.int64)
        first = np.zeros(len(ids) + 1, bool)
        first[np.concatenate([[0], np.cumsum(there + 1)])] = True
        at = np.flatnonzero(~first[:-1])
        return ids[at - 1], ids[at]

    def keys(self, distinct: np.ndarray, tree: Tree) -> Keys:
        pairs = _mixed(self.words[distinct >> 32] * _GOLD + self.words[distinct & 0xFFFFFFFF])
        pairs = pairs >> tree.left_out << tree.left_out
        a, b = np.argsort(pairs), np.argsort(self.words)
        return Keys(pairs[a], a, self.words[b], b)


_CHUNK = "chunk long, rows binary, target binary, sizes binary, ids binary, words binary"
_BODY = ["pairs", "pair_uses", "words", "word_uses"]
#: A message goes to the relay or bucket of a range and a group of senders.
_MESSAGE = "range long, group long, sender long, pairs binary, pair_uses binary, words binary, word_uses binary"
#: What messages are for: to be counted and answered, or one of both.
_BOTH, _TEACHES, _ASKS = range(3)
_ANSWER = "range long, group long, part long, pair_uses binary, word_uses binary"


class Tallies(NamedTuple):
    """Hashes in order and uses (of all texts, of the target's) of bigrams; of words, as contexts and as tokens."""

    pairs: np.ndarray
    pair_uses: np.ndarray
    words: np.ndarray
    word_uses: np.ndarray

    def cut(self, inside: int, step: int, tree: Tree) -> Iterator[tuple[int, list[bytes]]]:
        """The ranges of a step that a range of the step before is made of, as far as keys fall into them."""
        first = inside * tree.fan
        bounds = np.array([(k << 64) // tree.fan**step for k in range(first, first + tree.fan)], np.uint64)
        p, w = (np.append(np.searchsorted(x, bounds), len(x)) for x in (self.pairs, self.words))
        part = lambda hashes, uses, a, b: [packed(np.diff(hashes[a:b] >> tree.left_out, prepend=np.uint64(0))), packed(uses[:, a:b].ravel())]
        for k in range(tree.fan):
            if p[k] < p[k + 1] or w[k] < w[k + 1]:
                yield first + k, part(self.pairs, self.pair_uses, p[k], p[k + 1]) + part(self.words, self.word_uses, w[k], w[k + 1])

    @staticmethod
    def read(group: pa.Table, tree: Tree) -> list[Tallies]:
        hashes = lambda x: np.cumsum(unpacked(x, "u8"), dtype=np.uint64) << tree.left_out
        return [Tallies(hashes(p), unpacked(m, "i8").reshape(2, -1), hashes(w), unpacked(n, "i8").reshape(4, -1)) for p, m, w, n in zip(*(group.column(c).to_pylist() for c in _BODY), strict=True)]


def _tallied(chunk: Chunk, tree: Tree) -> Tallies:
    left, right = chunk.pairs()
    distinct, which = np.unique(left << 32 | right, return_inverse=True)
    taught = np.repeat(chunk.target, chunk.sizes)
    uses = lambda at, size: [np.bincount(at, minlength=size), np.bincount(at[taught], minlength=size)]
    keys = chunk.keys(distinct, tree)
    size = len(keys.words)
    return Tallies(keys.pairs, np.stack(uses(which, len(distinct)))[:, keys.pair_order], keys.words, np.stack([*uses(left, size), *uses(right, size)])[:, keys.word_order])


def _table(rows: list[list], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.Table.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=list(names))


def _first_sent(tree: Tree, chunks: int):
    """Messages of chunks to the first step; chunks: their number, which says how many groups they make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = int(_mixed(np.array([row["chunk"]], np.uint64) * _GOLD)[0]) % chunks
                group = place // tree.fan if tree.depth > 1 else 0
                for k, body in _tallied(Chunk.read(row), tree).cut(0, 1, tree):
                    yield from _table([[k, group, row["chunk"], *body]], _MESSAGE).to_batches()

    return run


def _relayed(tree: Tree, step: int):
    """Adds up what the senders of a relay after a step sent, and sends it on to the next."""

    def run(group: pa.Table) -> pa.Table:
        parts, inside, own = Tallies.read(group, tree), group.column("range")[0].as_py(), group.column("group")[0].as_py()
        pairs, pair_uses, _ = _added([(t.pairs, t.pair_uses) for t in parts])
        words, word_uses, _ = _added([(t.words, t.word_uses) for t in parts])
        a, b = np.argsort(pairs), np.argsort(words)
        sums = Tallies(pairs[a], pair_uses[:, a], words[b], word_uses[:, b])
        to = own // tree.fan if step + 1 < tree.depth else 0
        return _table([[k, to, own, *body] for k, body in sums.cut(inside, step + 1, tree)], _MESSAGE)

    return run


def _passed_back(tree: Tree):
    """A relay's answers to each of its senders."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        inside = group.column("range")[0].as_py()
        pairs, words = _joined(answers)
        rows, parts = [], Tallies.read(group, tree)
        all_pairs, all_words = (np.unique(np.concatenate(x)) for x in ([t.pairs for t in parts], [t.words for t in parts]))
        for sender, t in zip(group.column("sender").to_pylist(), parts, strict=True):
            a, b = np.searchsorted(all_pairs, t.pairs), np.searchsorted(all_words, t.words)
            rows.append([inside // tree.fan, sender, inside, packed(pairs[:, a].ravel()), packed(words[:, b].ravel())])
        return _table(rows, _ANSWER)

    return run


def _joined(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all keys of a sender, from the answers of the ranges that it cut them into."""
    parts = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "pair_uses", "word_uses")), strict=True))
    both = [[unpacked(x[k], "i8").reshape(rows, -1) for x in parts] for k, rows in ((1, 2), (2, 4))]
    return tuple(np.concatenate([np.empty((rows, 0), np.int64), *x], 1) for rows, x in zip((2, 4), both, strict=True))


def _chunked(kept: list[str], tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        of, rows, texts, target, size = {"": 0}, [], [], [], 0

        def out():
            nonlocal number, of, rows, texts, target, size
            words = list(of)
            sizes = np.array([len(t) for t in texts], np.int64)
            ids = np.concatenate([np.concatenate([[0], t]) for t in texts if len(t)] or [np.empty(0)]).astype(np.int64)
            order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words))
            words = [words[k] for k in order]
            hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64) >> tree.left_out << tree.left_out
            chunk = Chunk(pa.Table.from_batches(rows).combine_chunks(), np.array(target, bool), sizes, place[ids], hashes)
            yield from _table([[number, *chunk.columns()]], _CHUNK).to_batches()
            number += 1
            of, rows, texts, target, size = {"": 0}, [], [], [], 0

        for batch in batches:
            begun = 0
            for k, (t, good) in enumerate(zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True)):
                texts.append(np.array([of.setdefault(w, len(of)) for w in tokens(t)], np.int32))
                target.append(good)
                size += len(texts[-1])
                if size >= CHUNK:
                    rows.append(batch.select(kept).slice(begun, k + 1 - begun))
                    begun = k + 1
                    yield from out()
            if begun < batch.num_rows:
                rows.append(batch.select(kept).slice(begun))
        if texts:
            yield from out()

    return run


class Counts(NamedTuple):
    """Chunks of documents, written; how their keys reach buckets; the documents' columns but the text."""

    rows: DataFrame
    tree: Tree
    kept: StructType


def counted(docs: DataFrame, tree: Tree | None = None) -> Counts:
    """Chunks of docs(text, target, others)."""
    if tree is None:
        tree = Tree.over(1 + (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_CHARS)
    kept = docs.drop("text", "lm").schema
    return Counts(written(docs.mapInArrow(_chunked(kept.names, tree), _CHUNK), "chunks"), tree, kept)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct hashes, their sums, and for each part (hashes and uses) the places of its keys among them."""
    coded = pa.array(np.concatenate([h for h, _ in parts])).dictionary_encode()
    at = coded.indices.to_numpy()
    sums = np.stack([np.bincount(at, c, len(coded.dictionary)) for c in np.concatenate([c for _, c in parts], 1)]).astype(np.int64)
    return coded.dictionary.to_numpy(), sums, [at[a:b] for a, b in pairwise(np.cumsum([0, *(len(h) for h, _ in parts)]))]


def _summed(tree: Tree):
    """Adds up a bucket's keys and answers its senders; a row without a group has the bucket's share of the model's sizes."""

    def run(group: pa.Table) -> pa.Table:
        sides = group.column("side").to_pylist()
        parts = [t if side < _ASKS else t._replace(pair_uses=0 * t.pair_uses, word_uses=0 * t.word_uses) for t, side in zip(Tallies.read(group, tree), sides, strict=True)]
        _, pairs, pair_at = _added([(t.pairs, t.pair_uses) for t in parts])
        _, words, word_at = _added([(t.words, t.word_uses) for t in parts])
        bucket = group.column("range")[0].as_py()
        sizes = [*words[2:].sum(1).tolist(), *(words[2:] > 0).sum(1).tolist()]
        rows = [[None, None, bucket, None, None, sizes]]
        for sender, side, a, b in zip(group.column("sender").to_pylist(), sides, pair_at, word_at, strict=True):
            if side != _TEACHES:
                rows.append([bucket // tree.fan, sender, bucket, packed(pairs[:, a].ravel()), packed(words[:, b].ravel()), None])
        return _table(rows, _ANSWER + ", sizes array<long>")

    return run


class Sizes(NamedTuple):
    """Tokens and distinct words of a model, and words of the vocabulary that both models share."""

    total: int
    seen: int
    words: int


def losses(pair, before, word, own, spans: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Nats of each token, from the uses of its bigram, its context and itself in a model. own: the same uses in its text,
    0 where the model didn't count the text; spans: numbers of tokens of the texts."""
    pair, before, word = pair - own[0], before - own[1], word - own[2]
    starts = np.cumsum(spans) - spans
    counted = np.add.reduceat((own[2] > 0).astype(np.int64), starts)
    # words that no other text holds
    gone = np.add.reduceat(np.where((word == 0) & (own[2] > 0), 1 / np.maximum(own[2], 1), 0.0), starts)
    total, seen = np.repeat(sizes.total - counted, spans), np.repeat(np.maximum(sizes.seen - np.rint(gone), 0), spans)
    uniform = 1 / max(sizes.words, 1)
    unigram = np.where(total > 0, (np.maximum(word - DISCOUNT, 0) + DISCOUNT * seen * uniform) / np.maximum(total, 1), uniform)
    uses = np.maximum(before, 1)
    # what a context leaves to words not seen after it: less, the more it was used
    back = np.where(before > 0, DISCOUNT * np.minimum(1.0, 8 / np.sqrt(uses)), 1.0)
    return -np.log((1 - back) * np.maximum(pair - DISCOUNT, 0) / uses + back * unigram)


def _uses(x: np.ndarray) -> np.ndarray:
    """How often each value occurs."""
    _, which, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[which]


def _scores(chunk: Chunk, answers: pa.Table, tree: Tree, target: Sizes, background: Sizes) -> pa.Array:
    empty = pa.nulls(len(chunk.sizes), pa.float64())
    spans = chunk.sizes[chunk.sizes > 0]
    columns = [empty, empty, empty]
    if len(spans):
        left, right = chunk.pairs()
        distinct, which = np.unique(left << 32 | right, return_inverse=True)
        keys = chunk.keys(distinct, tree)
        pairs, words = np.empty((2, len(distinct)), np.int64), np.empty((4, len(keys.words)), np.int64)
        pairs[:, keys.pair_order], words[:, keys.word_order] = _joined(answers)
        ends = np.cumsum(spans)
        own = [np.concatenate([_uses(x[b - a : b]) for a, b in zip(spans, ends, strict=True)]) for x in (which, left, right)]
        taught = np.repeat(chunk.target[chunk.sizes > 0], spans)
        uses = lambda k: (pairs[k][which], words[k][left], words[2 + k][right])
        a = losses(*uses(1), [np.where(taught, x, 0) for x in own], spans, target)
        b = losses(*uses(0), own, spans, background)
        means = [np.add.reduceat(x, ends - spans) / spans for x in (a, b, a - b)]
        where = pa.array(np.where(chunk.sizes > 0, np.cumsum(chunk.sizes > 0) - 1, 0), mask=chunk.sizes == 0)
        columns = [pa.array(m).take(where) for m in means]
    return pa.StructArray.from_arrays([pa.array(chunk.sizes), *columns], names=["n_tokens", "target_loss", "background_loss", "score"])


def with_target(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Adds whether a row is of the target, in place of a column of that name."""
    known, own = "_t" + uuid.uuid4().hex, [c for c in docs.columns if c != "target"]
    ids = written(target.filter("doc_id is not null").select("doc_id").distinct().withColumn(known, F.lit(True)), "target")
    return docs.join(maybe_broadcast(ids), "doc_id", "left").select(*own, F.coalesce(known, F.lit(False)).alias("target"))


def trained(docs: DataFrame, target: DataFrame) -> Counts:
    """Counts of both models from docs(doc_id, text) and the target's doc_ids."""
    return counted(with_target(docs.select("doc_id", "text"), target))


def scored(docs: DataFrame, models: Counts) -> DataFrame:
    """The columns of docs but the text, and in place of a column of that name a struct `lm` of n_tokens, target_loss, background_loss and score, for each
    row of docs, which the background model counted; `target` says whether the target model did."""
    return answered(counted(docs, models.tree), models)


def answered(asked: Counts, models: Counts) -> DataFrame:
    """scored() for documents in chunks, which may be those that the models counted."""
    tree = models.tree

    def sent(chunks: DataFrame, side: int) -> DataFrame:
        number = max(chunks.count(), 1) if tree.depth > 1 else 1
        return chunks.mapInArrow(_first_sent(tree, number), _MESSAGE).withColumn("side", F.lit(side))

    messages = sent(asked.rows, _BOTH) if asked is models else sent(asked.rows, _ASKS).unionByName(sent(models.rows, _TEACHES))
    spark, steps, places = asked.rows.sparkSession, [], ["range", "group"]
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}" if tree.depth > 1 else None
    for step in range(1, tree.depth):
        steps.append(written(messages, "messages", folder))
        relayed = lambda side: steps[-1].filter(F.col("side") == side).groupBy(*places).applyInArrow(_relayed(tree, step), _MESSAGE).withColumn("side", F.lit(side))
        messages = relayed(_BOTH) if asked is models else relayed(_ASKS).unionByName(relayed(_TEACHES))
    sums = written(messages.groupBy("range").applyInArrow(_summed(tree), _ANSWER + ", sizes array<long>"), "sums", folder)
    total = sums.filter("sizes IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("sizes")[k]), F.lit(0)) for k in range(4)]).first()
    background, target = Sizes(total[0], total[2], total[2]), Sizes(total[1], total[3], total[2])
    answers = sums.filter("sizes IS NULL").drop("sizes")
    for step, messages in reversed(list(enumerate(steps))):
        asking = messages.filter(F.col("side") != _TEACHES).groupBy(*places)
        answers = written(asking.cogroup(answers.groupBy(*places)).applyInArrow(_passed_back(tree), _ANSWER), "answers", folder if step else None)
    if folder:  # the last answers are all that is left to read
        dropped(spark, folder)
    schema = StructType(asked.kept.fields).add("lm", _LM)
    names = asked.kept.names

    def score(documents: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk.read(documents.to_pylist()[0])
        lm = _scores(chunk, answers, tree, target, background)
        return pa.Table.from_arrays([*(chunk.rows.column(c) for c in names), lm], names=[*names, "lm"])

    return asked.rows.groupBy("chunk").cogroup(answers.groupBy("group")).applyInArrow(score, schema)


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = trained(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))
    return answered(models, models).select("doc_id", "lm.n_tokens", "lm.target_loss", "lm.background_loss", "lm.score")
