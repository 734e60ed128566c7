import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelens.llm import suffixes
from carelens.llm.suffixes import common_prefixes, remove_byte_repeats, repeated_windows, slices, stretches

from .util import documents, some_texts


def brute(ids, texts, size):
    data = [(t or "").encode() for t in texts]
    order = [float("inf") if i is None else i for i in ids]
    first = {}
    for o, x in zip(order, data, strict=True):
        for i in range(len(x) - size + 1):
            first[x[i:i + size]] = min(first.get(x[i:i + size], o), o)
    out = []
    for i, o, x in zip(ids, order, data, strict=True):
        gone = bytearray(len(x))
        for k in range(len(x) - size + 1):
            if first[x[k:k + size]] < o:
                gone[k:k + size] = b"\1" * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_common_prefixes(seed):
    r = random.Random(seed)
    strings = ["".join(r.choice("ab" if seed % 2 else "abcdefgh") for _ in range(r.randrange(0, 60))) for _ in range(40)]
    strings += [s[:30] + "x" for s in strings[:10]] + ["a" * 50, "a" * 40]
    symbols = np.array([c for s in strings for c in [*(ord(c) + 1 for c in s), 0]], np.uint16)
    length = r.choice([3, 10, 17])
    order, prefix = common_prefixes(symbols, length)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    whole = [symbols[i:i + length].tolist() for i in order]
    clean = [len(w) == length and 0 not in w for w in whole]
    for k in range(1, len(order)):
        if clean[k - 1] and clean[k]:
            same = next((j for j in range(length) if whole[k][j] != whole[k - 1][j]), length)
            assert prefix[k] == same


@pytest.mark.parametrize("seed", range(4))
def test_repeated_windows(seed):
    r = random.Random(seed)
    base = bytes(r.randrange(256) for _ in range(200))
    strings = [base[a:a + r.randrange(5, 90)] for a in (r.randrange(150) for _ in range(60))] + [b"z" * 70, b"z" * 64, b"short"]
    ords = [r.randrange(8) for _ in strings]
    got = repeated_windows(ords, strings, 12)
    for j, (o, s) in enumerate(zip(ords, strings, strict=True)):
        flags = [any(p < o and s[k:k + 12] in t for p, t in zip(ords, strings, strict=True)) for k in range(len(s) - 11)]
        runs = got.get(j, [])
        assert flags == [any(a <= k < b for a, b in zip(runs[::2], runs[1::2], strict=True)) for k in range(len(flags))]
        assert all(b < a for b, a in zip(runs[1::2], runs[2::2], strict=False))


def test_slices_hold_every_window_once(monkeypatch):
    texts = [b"", b"abc", bytes(range(256)) * 3, b"x" * 10, b"q" * 701]
    seen = []
    for data, ends, owners, offsets in slices(list(enumerate(texts)), 10, 64):
        part, first, size, _ = stretches(data, ends, 10, 4)
        begin = first - (ends - np.diff(ends, prepend=0))[part] + offsets[part]
        seen += [(o, w) for o, b, n in zip(owners[part].tolist(), begin.tolist(), size.tolist(), strict=True) for w in range(b, b + n)]
    assert sorted(seen) == [(k, w) for k, t in enumerate(texts) for w in range(len(t) - 9)]


def corpus():
    r = random.Random(11)
    texts = some_texts(n=24, longest=120)
    passage = " ".join(f"p{r.randrange(900)}é" for _ in range(30))
    for k in range(25):      # one passage in many contexts, and its parts
        texts.append(" ".join(f"q{r.randrange(40)}" for _ in range(r.randrange(40))) + " " + passage[k:] + f"\n z{k}")
    return texts + [passage] * 4 + ["again " * 300, "x " + "again  " * 100, "a b " * 100, "b a " * 90, "w" * 49, "w" * 50, "w" * 700, "日本語テキスト" * 30]


@pytest.mark.parametrize("size,core,bucket", [(50, 20, 2000), (50, 20, 1), (7, 3, 4)])
def test_against_brute_force(spark, size, core, bucket):
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    ids[9] = ids[20] = None
    ids[12] = ids[13]
    ids[-3] = ids[-4]
    rows = remove_byte_repeats(documents(spark, texts, ids), length=size, core=core, bucket=bucket).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=str)
    assert got == brute(ids, texts, size)


def test_small_slices(spark, monkeypatch):
    texts, ids = corpus(), None
    monkeypatch.setattr(suffixes, "SLOTS", 3)
    rows = remove_byte_repeats(documents(spark, texts, ids), with_text=False).collect()
    want = {r[0]: r[1:4] for r in brute(list(range(len(texts))), texts, 50)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in rows} == want


def test_many_equal_rows(spark):
    text = "one passage that is long enough to be compared with others, and more of it"
    texts = [text] * 3000 + ["before " + text + " after"] + [text + " 2"] * 3
    ids = [5] * 3000 + [7] + [1, 8, 9]
    rows = remove_byte_repeats(documents(spark, texts, ids)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=str)
    assert got == brute(ids, texts, 50)


def test_texts_stay_in_their_buckets(spark):
    table = suffixes._bucketed(documents(spark, corpus()).selectExpr("doc_id AS row", "text"), "row", 4)
    side = spark.range(30).groupBy((F.col("id") % 10).alias("row")).agg(F.count("id").alias("n"))
    joined = suffixes._beside(table, side)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    assert joined.count() == 10


def test_empty(spark):
    assert remove_byte_repeats(documents(spark, [])).collect() == []
    rows = remove_byte_repeats(documents(spark, [None, "", "short"]), with_text=False).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(0, 0, 0), (0, 0, 0), (5, 0, 0)]
