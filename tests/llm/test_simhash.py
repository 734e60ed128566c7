import re

import numpy as np
import xxhash

from carelens.llm.components import connected_components
from carelens.llm.simhash import drop_near_duplicates, fingerprint, forest_of, near_edges, simhash_groups

from .util import documents, some_texts


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if bin(prints[i] ^ prints[j]).count("1") <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_components(spark):
    texts = some_texts(n=20)
    base = some_texts(n=3, seed=9, longest=900)[9] or ""
    for k in range(12):      # near copies: a few words changed in a long text
        w = base.split()
        w[(37 * k) % len(w)] = f"changed{k}"
        texts.append(" ".join(w))
    texts += ["", "the", "THE", "\t"]
    rows = simhash_groups(documents(spark, texts)).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    want = components(list(prints), prints)
    assert len(rows) == len(texts)
    for r in rows:
        assert fingerprint(texts[r.doc_id]) == prints[r.doc_id]
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]
    kept = drop_near_duplicates(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def clustered(n, seed):
    """Values with clusters: flips of up to 3 bits along chains."""
    r = np.random.default_rng(seed)
    out = [int(x) for x in r.integers(0, 1 << 63, 5)]
    while len(out) < n:
        v = out[r.integers(0, len(out))] if r.random() < .8 else int(r.integers(0, 1 << 63))
        for b in r.integers(0, 64, r.integers(0, 7)):
            v ^= 1 << int(b)
        out.append(v)
    return np.unique(np.array(out, np.uint64))


def same_partition(n, edges, values):
    index = {int(v): i for i, v in enumerate(values)}
    label = list(range(n))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i
    for a, b in edges:
        label[find(index[a])] = find(index[b])
    return [find(i) for i in range(n)]


def partition_of(labels):
    groups = {}
    for i, l in enumerate(labels):
        groups.setdefault(l, set()).add(i)
    return sorted(map(sorted, groups.values()))


def near_pairs(values):
    d = np.bitwise_count(values[:, None] ^ values[None, :])
    return [(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(d <= 4), strict=True) if i < j]


def test_bit_sliced_forest():
    for n, seed in ((30, 1), (200, 2), (700, 3)):
        v = clustered(n, seed)
        groups = np.sort(np.random.default_rng(seed).integers(0, 9, len(v)))
        want = []
        for g in range(9):
            want += near_pairs(v[groups == g])
        a, b = forest_of(v, groups, 4)
        assert len(a) < len(v)
        got = partition_of(same_partition(len(v), zip(a.tolist(), b.tolist(), strict=True), v))
        assert got == partition_of(same_partition(len(v), want, v))


def test_buckets_lose_no_link(spark):
    v = clustered(900, 4)
    table = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    want = partition_of(same_partition(len(v), near_pairs(v), v))
    for bucket in (4096, 20):       # 20: nearly all buckets are hot and cut into chunks
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_edges(table, bucket=bucket).collect()]
        assert partition_of(same_partition(len(v), edges, v)) == want
        assert all(bin(a ^ b).count("1") < 64 for a, b in edges)


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (-5, 200), (200, 201)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150))
    assert got[201] == -5 and 7 in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_null_ids_and_empty(spark):
    docs = documents(spark, ["same text of words", "same text of words", "other words stand here", "other words stand here", None],
                     ids=[None, 4, None, None, 9])
    got = sorted(((r.doc_id or -1), r.component_id or -1) for r in simhash_groups(docs).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 4), (4, 4), (9, 9)]
    assert sorted((r.doc_id or -1, r.text or "") for r in drop_near_duplicates(docs).collect()) == [
        (-1, "other words stand here"), (4, "same text of words"), (9, "")]
    assert simhash_groups(documents(spark, [])).collect() == []
    assert drop_near_duplicates(documents(spark, [])).collect() == []
