"""Cross-tokenizer alignment against the libraries and a walk over bytes."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import sentencepiece
from test_llm_operators import odd_texts
from tokenizers import Tokenizer

from leadmill.llm import align, queries

SF = "/root/testdata/sf0.001"


def _plain(docs):
    """Rows of the alignment of (id, text), one byte offset after the other."""
    a_side, b_side = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    names = {i: t for t, i in a_side.get_vocab().items()}
    held, rows = Counter(), []
    for d, t in docs:
        a, b, groups, want = [], [], [], (" " + (t or "")).encode()
        if t:
            a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
            sides = [[bytes(letters[c] for c in names[i]) for i in a], [bytes([int(b_side.id_to_piece(i)[3:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]]
            if any(b"".join(s) != want for s in sides):
                a, b = [], []
            else:
                ends = [{sum(map(len, s[: k + 1])) for k in range(len(s))} if len(s) < 400 else set(_sums(s)) for s in sides]
                for k, ids in enumerate((a, b)):
                    g = 0
                    for i, n in zip(ids, _sums(sides[k]), strict=True):
                        if len(groups) <= g:
                            groups.append(([], []))
                        groups[g][k].append(i)
                        g += n in ends[0] and n in ends[1]
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        rows.append((d, a, b, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    text = lambda gs: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
    return [(d, len(a), len(b), len(g), len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), hashlib.sha256(text(g).encode()).hexdigest() if a else "") for d, a, b, g, ls in rows]


def _sums(tokens):
    n, out = 0, []
    for x in tokens:
        n += len(x)
        out.append(n)
    return out


def test_op13(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_alignment"](spark, SF)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(_plain(docs))


def test_odd_texts_in_small_chunks(spark):
    texts = [*odd_texts(300), "a" * 20_000, "Hello <s> </s> <unk> <|endoftext|> there", "x", "x", "x y  z", " lead", "trail ", "漢" * 2000]
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], "doc_id long, text string, pairs string, n_a int").repartition(3)
    limits = align.CHUNK_BYTES, align.PART_BYTES, align.WIDE
    want = sorted(_plain(docs), key=str)
    try:
        for align.CHUNK_BYTES, align.PART_BYTES, align.WIDE in (limits, (20_000, 3_000, 20), (1, 1, 1)):
            assert sorted(map(tuple, align.alignment(df).collect()), key=str) == want
    finally:
        align.CHUNK_BYTES, align.PART_BYTES, align.WIDE = limits
    assert align.alignment(df.limit(0)).count() == 0
    assert [r.n_links for r in align.alignment(df.filter("text is null")).collect()] == [0] * sum(t is None for _, t in docs)
