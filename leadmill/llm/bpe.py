"""Byte-level BPE encoding and decoding by forced boundaries.

A pair of bytes that is adjacent in no vocabulary token can never be joined by a merge, so every such pair marks a
certain cut. After the vocabulary's own pre-split, each piece is cut at those pairs, the fragments are encoded
independently and their ids are concatenated: the result is that of encoding the whole. Texts of a batch are cut at
white space and their words dictionary-encoded by Arrow, so only distinct words reach the encoder; their fragments are
merged side by side, a bounded memo answers words that were seen before, and long runs without a cut are merged by a
heap in n log n. Ids and texts of a batch are gathered from the dictionary at once.

Nulls and empty texts give no ids and decode to the empty text. Texts are encoded whole, whatever their length.
The special token's string in a text is that token, as in the tokenizers library's default.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, functions as F

#: White space as the vocabularies' pre-splits know it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: White space beyond ASCII, in UTF-8. Where it stands beside other white space, words don't split independently.
_WIDE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_WIDE_BEGINS = sorted({w[:2] for w in _WIDE})
_WIDE_RUN = re.compile(rb"(?=[\t-\r ](?:%(w)s)|(?:%(w)s)(?:[\t-\r ]|%(w)s))" % {b"w": b"|".join(_WIDE)})  # overlapping, as one may cross a text's end
_ASCII_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
#: Words of a worker's memo; it is emptied when full, which bounds its memory.
MEMO = 1_000_000
#: Longer words are not remembered.
MEMO_BYTES = 48
#: Texts are encoded together until they have so many bytes.
PART_BYTES = 6_000_000
#: Longer fragments are merged by a heap, one by one.
LONG = 64
_NEVER = 1 << 60
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: The pairs' hash table has so many slots.
SLOTS = 1 << 18


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def _kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 else, of each code point, as the pre-split's expressions have it."""
    out = np.full(0x110000, 3, np.uint8)
    text = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for kind, expression in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, f"[{_SPACE}]+")):
        for m in regex.finditer(expression, text):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def _binary(ends: np.ndarray, data) -> pa.Array:
    """Strings of bytes that lie one after the other, by their ends from 0 on."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data)])


def _parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of each string, from 0 on, and the bytes of all."""
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return ends - ends[0], np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level vocabulary file, with or without word ends. special: whether the special token's
    string in a text is that token; else it is plain text."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word_ends = bool(end)
        self.first_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.last_ids = np.array([vocab[c + end] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        #: Rank of a pair of ids, and by rank the id of both together.
        self.rank, joined = {}, []
        for k, (x, y) in enumerate(spec["model"]["merges"]):
            self.rank.setdefault(vocab[x] << 32 | vocab[y], k)
            joined.append(vocab[x + y])
        self.joined = np.array(joined, np.int64)
        self.slot_pair, self.slot_rank = np.full(SLOTS, -1, np.int64), np.full(SLOTS, _NEVER, np.int64)
        for pair, slot in zip(self.rank, self._slots(np.array([*self.rank], np.int64)).tolist(), strict=True):
            while self.slot_pair[slot] >= 0:
                slot = (slot + 1) % SLOTS
            self.slot_pair[slot], self.slot_rank[slot] = pair, self.rank[pair]
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        together = np.zeros(1 << 16, bool)
        for token, i in vocab.items():
            if end and token.endswith(end):
                token, tail = token[: -len(end)], b" "
            else:
                tail = b""
            raw = bytes(letters[c] for c in token)
            self.token_bytes[i] = raw + tail
            for x, y in pairwise(raw):
                together[x << 8 | y] = True
        for token in spec["added_tokens"]:
            self.token_bytes[token["id"]] = token["content"].encode()
        #: Whether the vocabulary has the two bytes side by side.
        self.together = together
        self.memo = (pa.array([], pa.large_binary()), pa.array([], pa.large_binary()))  # words and their ids
        self.tokens = pa.array(self.token_bytes, pa.large_binary())

    def certain_cuts(self, flat: np.ndarray) -> np.ndarray:
        """For each byte but the last, whether it and the next are side by side in no token."""
        return ~self.together[flat[:-1].astype(np.int64) << 8 | flat[1:]]

    @staticmethod
    def _slots(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * _GOLD) >> np.uint64(64 - 18)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, from the hash table with linear probing."""
        key = left << 32 | right
        slot = self._slots(key)
        found = self.slot_pair[slot]
        out = np.where(found == key, self.slot_rank[slot], _NEVER)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot = (slot[open_] + 1) % SLOTS if len(slot) != len(open_) else (slot + 1) % SLOTS
            key = key[open_] if len(key) != len(open_) else key
            found = self.slot_pair[slot]
            same = found == key
            out[open_[same]] = self.slot_rank[slot[same]]
            further = np.flatnonzero(~same & (found >= 0))
            open_, slot, key = open_[further], slot[further], key[further]
        return out

    def encode_pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of each piece of the pre-split, as 32-bit integers. All fragments of all pieces are merged side by side:
        each round joins every fragment's pair of least rank, leftmost on ties."""
        ends, flat = _parts(pieces)
        if not len(flat):
            return pa.array([b""] * len(pieces), pa.large_binary())
        size, ends = np.diff(ends), ends[1:]
        ids = self.first_ids[flat]
        last = ends[size > 0] - 1
        ids[last] = self.last_ids[flat[last]]
        cut = np.ones(len(flat), bool)  # after each byte
        cut[:-1] = self.certain_cuts(flat)
        cut[last] = True
        starts = np.concatenate(([0], np.flatnonzero(cut)[:-1] + 1))
        length = np.diff(np.concatenate((starts, [len(flat)])))
        piece_of = np.searchsorted(ends, starts, side="right")
        done_ids, done_fragment = [], []
        names = np.arange(len(starts))
        for k in np.flatnonzero(length > LONG):
            got = self._merged_long(ids[starts[k] : starts[k] + length[k]].tolist())
            done_ids.append(np.array(got, np.int64))
            done_fragment.append(np.full(len(got), k))
        fragment = np.repeat(names, length)
        keep = (length <= LONG)[fragment]
        ids, fragment, cut = ids[keep], fragment[keep], cut[keep]
        names, length = names[length <= LONG], length[length <= LONG]
        rank = np.full(len(ids), _NEVER, np.int64)
        inner = np.flatnonzero(~cut)
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(names):
            starts = np.cumsum(length) - length
            least = np.minimum.reduceat(rank, starts)
            open_ = least < _NEVER
            if not open_.all():
                live = np.repeat(open_, length)
                done_ids.append(ids[~live])
                done_fragment.append(fragment[~live])
                ids, fragment, rank, names, length, least = ids[live], fragment[live], rank[live], names[open_], length[open_], least[open_]
                if not len(names):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            of = fragment[hit]
            first = hit[np.concatenate(([True], of[1:] != of[:-1]))]
            ids[first] = self.joined[least]
            rank[first] = rank[first + 1]  # for now: whether something follows
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            ids, fragment, rank = ids[keep], fragment[keep], rank[keep]
            length = length - 1
            at = first - np.arange(len(first))
            starts = np.cumsum(length) - length
            before, after = at[at > starts] - 1, at[at < starts + length - 1]
            rank[before] = self._ranks(ids[before], ids[before + 1])
            rank[at] = _NEVER
            rank[after] = self._ranks(ids[after], ids[after + 1])
        ids, fragment = np.concatenate(done_ids), np.concatenate(done_fragment)
        counts = np.bincount(piece_of[fragment], minlength=len(pieces))
        return _binary(np.concatenate(([0], np.cumsum(counts))) * 4, ids[np.argsort(fragment, kind="stable")].astype(np.int32))

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap, in n log n."""
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, x, y) for i, (x, y) in enumerate(pairwise(ids)) if (r := rank(x << 32 | y)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = int(self.joined[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (r := rank(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def _normal(self, text: str) -> str:
        # Python lower-cases a capital sigma by its place in the word, the vocabulary doesn't
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower() if self.word_ends else text

    def _split(self, text: str) -> list[str]:
        """The pre-split of any run of text that splits independently."""
        return (_WORD_PIECES if self.word_ends else _PIECES).findall(self._normal(text))

    def _learned(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words. Pieces end where the kind of character changes; words with an apostrophe and white space
        other than a word's go through the expressions."""
        hard = pc.match_substring(words, b"'").to_numpy(zero_copy_only=False)
        if not self.word_ends:
            ends, data = _parts(words)
            hard |= _ASCII_SPACE[data[ends[1:] - 1]]
        easy = self._pieced(words.filter(pa.array(~hard)))
        split = [self._split(w.decode()) for w in words.filter(pa.array(hard)).to_pylist()]
        pieces = pa.array([p.encode() for own in split for p in own], pa.large_binary())
        at = np.cumsum([0, *map(len, split)])
        ends, ids = _parts(self.encode_pieces(pieces))
        place = np.where(hard, np.cumsum(hard) - 1 + len(easy), np.cumsum(~hard) - 1)
        return pa.concat_arrays([easy, _binary(ends[at], ids)]).take(pa.array(place))

    def _pieced(self, words: pa.Array) -> pa.Array:
        if not len(words):
            return words
        lines = pc.binary_join_element_wise(words, *(pa.scalar(x, pa.large_binary()) for x in (b"", b"\n")))  # no word holds a line feed here
        text = self._normal(_parts(lines)[1].tobytes().decode())
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind, line_end, inner = _kinds()[points], points == 10, points == 32
        start = np.concatenate(([True], (kind[1:] != kind[:-1]) | line_end[1:] | line_end[:-1]))
        if self.word_ends:
            start |= kind == 2
        else:
            start[1:][inner[:-1]] = False  # the space before a word is its own
        starts = np.flatnonzero(start)
        data = np.frombuffer(text.encode(), np.uint8)
        byte = np.concatenate(([0], np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))))
        coded = _binary(np.append(byte[starts], len(data)), data).dictionary_encode()
        ends, ids = _parts(self.encode_pieces(coded.dictionary))
        empty = np.zeros(len(coded.dictionary), bool)
        empty[coded.indices.to_numpy()[(kind[starts] == 0) if self.word_ends else line_end[starts]]] = True
        pieces = pc.if_else(pa.array(empty), pa.scalar(b"", pa.large_binary()), _binary(ends, ids))
        ends, ids = _parts(pieces.take(coded.indices))
        return _binary(np.concatenate(([0], ends[np.flatnonzero(line_end[starts]) + 1])), ids)

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, from the memo where it knows them."""
        known, ids = self.memo
        at = pc.index_in(words, value_set=known)
        if at.null_count:
            new = words.filter(at.is_null())
            got = self._learned(new)
            place = at.to_numpy(zero_copy_only=False).copy()
            place[np.isnan(place)] = len(known) + np.arange(len(new))
            out = pa.concat_arrays([ids, got]).take(pa.array(place.astype(np.int64)))
            short = pc.less_equal(pc.binary_length(new), MEMO_BYTES)
            new, got = new.filter(short), got.filter(short)
            self.memo = (new, got) if len(known) + len(new) > MEMO else (pa.concat_arrays([known, new]), pa.concat_arrays([ids, got]))
            return out
        return ids.take(at)

    def _whole(self, text: str) -> bytes:
        """Ids of a text that holds special tokens or runs of wide white space."""
        out = []
        for i, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if i % 2:
                out.append(np.array([self.special[part]], np.int32).tobytes())
            elif part:
                coded = pa.array([p.encode() for p in self._split(part)], pa.large_binary()).dictionary_encode()
                out.append(_parts(self.encode_pieces(coded.dictionary).take(coded.indices))[1].tobytes())
        return b"".join(out)

    def _starts(self, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where runs begin that split and encode independently: with word ends, words with the white space after them;
        else words with one space before them, and other white space."""
        space = _ASCII_SPACE[data]
        before = np.concatenate(([False], space[:-1]))
        if self.word_ends:
            start = before & ~space
        else:
            after = np.concatenate((space[1:], [True]))
            after[ends[1:][ends[1:] > 0] - 1] = True  # a text that ends in white space ends in one run
            start = space & ~(before & after)
            beside = np.flatnonzero(before & ~space)
            start[beside] = data[beside - 1] != 32
        start[ends[:-1][ends[:-1] < len(data)]] = True
        return np.flatnonzero(start)

    def _odd(self, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Which texts have to be split as a whole."""
        raw, at = data.tobytes(), []
        if any(t.encode() in raw for t in self.special):
            at += [m.start() for m in re.finditer(b"|".join(re.escape(t.encode()) for t in self.special), raw)]
        if not self.word_ends and any(w in raw for w in _WIDE_BEGINS) and any(w in raw for w in _WIDE):
            at += [m.start() for m in _WIDE_RUN.finditer(raw)]
        return np.unique(np.searchsorted(ends, at, side="right") - 1)

    def _encode_part(self, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Numbers of ids of each text, and all ids; all texts split independently."""
        if not len(data):
            return np.zeros(len(ends) - 1, np.int64), b""
        starts = self._starts(ends, data)
        if self.word_ends:
            data = np.where(_ASCII_SPACE[data], np.uint8(32), data)  # white space is dropped, whatever its kind
        coded = _binary(np.append(starts, len(data)), data).dictionary_encode()
        at, ids = _parts(self._word_ids(coded.dictionary).take(coded.indices))
        return np.diff(at[np.searchsorted(starts, ends)]) // 4, ids.tobytes()

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ends of each text's ids, from 0 on, and the ids of all texts, whole; null: none."""
        ends, data = _parts(pc.fill_null(texts.cast(pa.large_string()), ""))
        counts, out, a = [], [], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + PART_BYTES, side="right")) - 1)
            own, part = ends[a : b + 1] - ends[a], data[ends[a] : ends[b]]
            odd = self._odd(own, part).tolist()
            for i, j in pairwise([-1, *odd, b - a]):  # texts between odd ones, then an odd one
                n, ids = self._encode_part(own[i + 1 : j + 1] - own[i + 1], part[own[i + 1] : own[j]])
                counts.append(n)
                out.append(ids)
                if j < b - a:
                    ids = self._whole(part[own[j] : own[j + 1]].tobytes().decode())
                    counts.append([len(ids) // 4])
                    out.append(ids)
            a = b
        return np.cumsum(np.concatenate(([0], *counts))).astype(np.int64), np.frombuffer(b"".join(out), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()))[1].tolist()

    def decode_array(self, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of ids; bytes that are no UTF-8 become U+FFFD."""
        got = self.tokens.take(pa.array(ids))
        at, data = _parts(got)
        out = _binary(at[ends], data).view(pa.large_string())
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([b.as_py().decode("utf-8", "replace") for b in out.view(pa.large_binary())], pa.large_string())
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_array(np.array([0, len(ids)]), np.array(ids, np.int64))[0].as_py()


@lru_cache(2)
def codec(path: str, special: bool = True) -> ForcedBoundaryBPE:
    """One codec a worker and vocabulary."""
    return ForcedBoundaryBPE(path, special)


def encoder(path: str | None = None):
    """Column function: text -> array of ids. path: a vocabulary file that every executor has; the public one if None."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ends, ids = codec(path or public_tokenizers.path("byte_bpe_50k.json")).encode_array(texts)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))

    return encode


def decoder(path: str | None = None):
    """Column function: array of ids -> text; a null array gives the empty text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        return codec(path or public_tokenizers.path("byte_bpe_50k.json")).decode_array(np.concatenate(([0], np.cumsum(n))).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False)).cast(pa.string())

    return decode


def with_ids(df, text: str = "text", ids: str = "ids", path: str | None = None):
    """Adds the column of ids; a column of that name is replaced."""
    return df.withColumn(ids, encoder(path)(F.col(text)))


def with_text(df, ids: str = "ids", text: str = "decoded", path: str | None = None):
    """Adds the column of decoded texts."""
    return df.withColumn(text, decoder(path)(F.col(ids)))


def digest(ids: Column) -> Column:
    """SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def op1_bpe(spark, sf_dir: str):
    from leadmill.llm.common import table

    docs = with_text(with_ids(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
