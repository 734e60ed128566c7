import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from carelens.llm.tokens import count_tokens, counter

from .util import documents, some_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


ODD = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "it's  we'll\n\n\n  x\t\ty ", " " * 3000, " 　x\x85 \x1c y",
       "१२३ ٣٤ Ⅷ ²", "é ñ 👍🏽👩‍👩‍👧 東京都", "'s's'S", "-" * 999 + "x", "\r\n\r\n a"]


def test_equals_the_library(spark, library):
    texts = some_texts() + ODD
    rows = {r.doc_id: r for r in count_tokens(documents(spark, texts), PATH, limit=20).collect()}
    for i, t in enumerate(texts):
        n = library(t or "")
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 20)


def test_chunks_resynchronise(library):
    r, c = random.Random(5), counter(PATH)
    texts = [t for t in some_texts(longest=2000) if t] + ODD
    for text in texts + ["".join(r.choice(["a", " ", "  ", "\n", "'ll", "7", "é", "東", "<|endoftext|>", "?!"]) for _ in range(3000)) for _ in range(10)]:
        n = library(text)
        for chunk, overlap in ((50, 8), (97, 30), (1000, 64)):
            assert c.count(text, chunk, overlap) == n


def test_sample_of_documents(library):
    c = counter(PATH)
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        assert c.count(text, 400, 40) == library(text)


def test_other_kinds(spark):
    texts = ["Hello there world", "", None]
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        got = sorted((r.doc_id, r.n_tokens) for r in count_tokens(documents(spark, texts), public_tokenizers.path(name)).collect())
        assert got[0][1] >= 3 and got[1:] == [(1, 0), (2, 0)]
    assert count_tokens(documents(spark, []), PATH).collect() == []
