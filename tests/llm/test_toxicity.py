import itertools
import random
import zlib

import numpy as np
import pytest

from carelens.llm.toxicity import drop_toxic, fit_toxicity, marginals, score_toxicity, tokens_of

from .util import documents, some_texts


def brute_marginals(e, a):
    total, out = 0.0, np.zeros(len(e))
    for y in itertools.product((0, 1), repeat=len(e)):
        w, before = 1.0, 0
        for t, s in enumerate(y):
            w *= a[before, s] * (np.exp(e[t]) if s else 1.0)
            before = s
        total += w
        out += w * np.array(y)
    return out / total


def test_marginals_against_enumeration():
    r = np.random.default_rng(4)
    a = np.exp(r.normal(size=(2, 2)))
    lengths = np.array([3, 0, 9, 1, 11])
    e = r.normal(size=lengths.sum()) * 2
    at = np.concatenate(([0], np.cumsum(lengths)))
    want = np.concatenate([brute_marginals(e[x:y], a) for x, y in zip(at[:-1], at[1:], strict=True) if y > x])
    assert np.allclose(marginals(e, lengths, a), want)


def test_long_texts_join_rows_exactly():
    r = np.random.default_rng(5)
    a = np.exp(r.normal(size=(2, 2)))
    lengths = np.array([1000, 64, 65, 0, 200])
    e = r.normal(size=lengths.sum())
    got = marginals(e, lengths, a)
    f = np.zeros((1000, 2))
    v = np.array([1.0, 0.0])
    for t in range(1000):
        v = (v @ a) * np.array([1.0, np.exp(e[t])])
        f[t] = v = v / v.sum()
    b, want = np.array([0.5, 0.5]), np.zeros(1000)
    for t in range(999, -1, -1):
        j = f[t] * b
        want[t] = j[1] / j.sum()
        b = a @ (np.array([1.0, np.exp(e[t])]) * b)
        b = b / b.sum()
    assert np.allclose(got[:1000], want)


def planted(n=500, seed=6):
    r = random.Random(seed)
    clean = [f"{a}{b}" for a in "bar tel mon rus vel dor kan".split() for b in "la ne ri so tu mi".split()]
    bad = ["zworst", "vileful", "Grotts"]
    texts, toxic = [], []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randrange(20, 400))]
        y = i % 5 == 0
        if y:
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", ".", ","]))
        texts.append(" ".join(words))
        toxic.append(int(y))
    return texts, toxic


@pytest.fixture(scope="module")
def fitted(spark):
    texts, toxic = planted()
    labels = [(i, y, 1) for i, y in enumerate(toxic)] + [(None, 1, 0), (3, None, 0), (9999, 1, 1), (4, 7, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    return texts, toxic, fit_toxicity(documents(spark, texts), labels)


def test_held_out_accuracy_and_offsets(spark, fitted):
    texts, toxic, model = fitted
    rows = score_toxicity(documents(spark, texts), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) == toxic[r.doc_id]
        words = [texts[r.doc_id][int(a):int(b)] for a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert all(w in ("zworst", "vileful", "Grotts") or " " in w for w in words)
        assert bool(words) == bool(toxic[r.doc_id])


def test_odd_texts_and_stage(spark, fitted):
    model = fitted[2]
    texts = some_texts() + ["İÇ zworst ünd vileful grotts", "x" * 100_000]
    rows = {r.doc_id: r for r in score_toxicity(documents(spark, texts), model).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[0].score == rows[1].score < 0.5
    a, b = map(int, rows[len(texts) - 2].spans.split(",")[0].split(":"))
    assert texts[-2][a:b].startswith("zworst")
    docs = documents(spark, texts)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}
    assert drop_toxic(documents(spark, []), model).collect() == []
    assert score_toxicity(documents(spark, []), model).collect() == []


def test_without_labels(spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    docs = documents(spark, ["a b", "c d"], ids=[1, None])
    model = fit_toxicity(docs, labels)
    assert model is None
    assert [(r.score, r.predicted, r.spans) for r in score_toxicity(docs, model).collect()] == [(0.0, 0, "")] * 2
    assert drop_toxic(docs, model).count() == 2


def test_tokens():
    raw, starts, ends, f = tokens_of("Ab, ÉTÉ-x 99 ab")
    assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "été", "x", "ab"]
    assert (f[0] == f[3]).all()
