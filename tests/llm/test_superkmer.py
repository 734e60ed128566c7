import random
import re

import pytest

from carelens.llm.superkmer import remove_repeats

from .util import documents, some_texts


def brute(ids, texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    order = [float("inf") if i is None else i for i in ids]
    first = {}
    for o, w in zip(order, words, strict=True):
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            first[key] = min(first.get(key, o), o)
    out = []
    for i, o, w in zip(ids, order, words, strict=True):
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k:k + size])] < o for j in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def corpus():
    r = random.Random(11)
    texts = some_texts(n=30)
    passage = " ".join(f"p{r.randrange(90)}" for _ in range(75))
    for k in range(25):      # one passage in many contexts, and its parts
        texts.append(" ".join(f"q{r.randrange(40)}" for _ in range(r.randrange(60))) + " " + passage + f"\n z{k}")
    texts += [passage] * 4 + ["again " * 700, "x " + "again  " * 300, "a b " * 200, "b a " * 90, " ".join(["w"] * 49)]
    return texts


@pytest.mark.parametrize("size,bucket", [(50, 2000), (50, 1), (5, 3)])
def test_against_brute_force(spark, size, bucket):
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    ids[9] = ids[20] = None
    ids[12] = ids[13]
    ids[-3] = ids[-4]
    rows = remove_repeats(documents(spark, texts, ids), window=size, core=min(8, size - 1), bucket=bucket).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    assert got == brute(ids, texts, size)


def test_empty(spark):
    assert remove_repeats(documents(spark, [])).collect() == []
    assert [(r.n_words, r.n_removed, r.kept) for r in remove_repeats(documents(spark, [None, ""])).collect()] == [(0, 0, "")] * 2


def test_many_equal_rows(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    texts = [passage + " end"] * 10_000 + ["start " + passage] * 2 + [passage + " x " + passage] + ["again " * 120] * 300
    ids = [5] * 10_000 + [7, 8] + [2] + [4] * 150 + [6] * 150
    rows = remove_repeats(documents(spark, texts, ids)).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    want = {}
    for r in brute(*zip(*dict.fromkeys(zip(ids, texts, strict=True)), strict=True), 50):
        want[r] = sum(i == r[0] for i in ids)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept): r["count"] for r in rows} == want
