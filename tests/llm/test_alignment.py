from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carelens.llm.alignment import align, alignment_counts

from .util import documents, some_texts

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(n)], n = b, n + 1
    return out


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(LEFT)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=RIGHT), letters()


def tokens(libraries, text):
    a, b, letter = libraries
    if not text:
        return [], []
    left = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = b" " + text.encode()
    return (left, right) if b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else ([], [])


def placed(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(libraries, texts):
    docs, count = [], Counter()
    for t in texts:
        a, b = map(placed, tokens(libraries, t))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links = [(i, j) for i, _, e in a for j, _, f in b if e == f]
        groups, last = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, s, e in a if last <= s and e <= end) + "|" + ",".join(str(i) for i, s, e in b if last <= s and e <= end))
            last = end
        overlaps = [(x, y) for x, (_, s, e) in enumerate(a) for y, (_, u, v) in enumerate(b) if s < v and u < e]
        docs.append((len(a), len(b), len(ends), links, ";".join(groups), overlaps))
        count.update(links)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(a, b, n, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             sha256(g.encode()).hexdigest() if links else "", g, o) for a, b, n, links, g, o in docs]


TEXTS = some_texts(24, longest=90) + [
    "a <|endoftext|> b</s> <s>", "  two  spaces ", "▁ piece mark", "ﬁ ligature ① full Ｗidth", "日本語 テキスト 🙂🙂🏽", "new\nline\r\n\ttab",
    "\x00 nul ​ zero", "x", " ", "é é", "unhappily antidisestablishmentarianism 1234567 3.14"]


@pytest.mark.parametrize("size,rows", [(1 << 20, 10 ** 6), (40, 0)])
def test_against_brute_force(spark, libraries, size, rows):
    ids = [None, 7, 7, *range(10, 7 + len(TEXTS))]
    want = brute(libraries, TEXTS)
    docs = documents(spark, TEXTS, ids)
    out = alignment_counts(docs, LEFT, RIGHT, size=size, broadcast_rows=rows).collect()
    got = sorted((tuple(r) for r in out), key=str)
    assert got == sorted(((i, *w[:7]) for i, w in zip(ids, want, strict=True)), key=str)
    assert sum(w[2] > 0 for w in want) > 25 and sum(w[2] == 0 for w in want) >= 3
    seen = sorted(((r.doc_id, r.groups, [tuple(o) for o in r.overlaps]) for r in align(docs, LEFT, RIGHT, size=size).collect()), key=str)
    assert seen == sorted(((i, w[7], w[8]) for i, w in zip(ids, want, strict=True)), key=str)


def test_long_text(spark, libraries):
    text = "A longer text, über Wörter: " * 6000
    row = alignment_counts(documents(spark, [text, "short"]), LEFT, RIGHT).filter(F.col("doc_id") == 0).first()
    a, b = map(placed, tokens(libraries, text))
    assert (row.n_a, row.n_b, row.n_links) == (len(a), len(b), len({e for *_, e in a} & {e for *_, e in b}))


def test_empty(spark):
    assert alignment_counts(documents(spark, []), LEFT, RIGHT).collect() == []
    rows = alignment_counts(documents(spark, [None, ""]), LEFT, RIGHT).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 2
