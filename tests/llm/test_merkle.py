import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelens.llm import merkle
from carelens.llm.merkle import address, block_nodes, block_steps, fold, manifest_proofs, nodes_in

from .util import documents, some_texts

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1:a + 8])))
        i //= 8
    return out


def brute(rows, tampered):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        other = r["text"] if r["text"] is None or not tampered(r["doc_id"]) else r["text"].translate(low)
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf(r, r["text"]), leaf(r, other)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees.append(tree([x[1] for x in groups[g]]))
    crown = tree([t[-1][0] for t in trees])
    root, out = crown[-1][0], []
    for k, g in enumerate(names):
        for i, (doc_id, own, other) in enumerate(groups[g]):
            path = steps(trees[k], i) + steps(crown, k)
            folded = other
            for before, after in path:
                folded = h(before, folded, after)
            out.append((doc_id, own, trees[k][-1][0], root, h(*(b + a for b, a in path)), folded, folded == root))
    return sorted(out, key=str)


def got(df, third=True):
    out = manifest_proofs(df, tampered=F.col("doc_id") % 3 == 0 if third else None)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.siblings, r.folded_root, r.verified) for r in out.collect()), key=str)


def every_third(i):
    return i is not None and i % 3 == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses(levels):
    places = [address(levels, d, np.arange(8 ** d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(nodes_in(levels)))
    if levels == 4:      # two levels above, then 64 subtrees of two levels, each in one stretch
        assert places[0][0] == 0 and max(places[1]) == 8
        assert places[2][:2].tolist() == [9, 18] and places[3][:8].tolist() == list(range(10, 18))


@pytest.mark.parametrize("count", [1, 2, 7, 8, 9, 64, 65, 511, 512])
def test_block(count):
    leaves = [h(str(k)) for k in range(count)]
    nodes = block_nodes(leaves, 3)
    levels = block_steps(nodes, 3, count)
    for i in (0, count // 2, count - 1):
        path = [level[i // 8 ** k] for k, level in enumerate(levels)]
        assert fold(leaves[i], path) == nodes[0]


def test_against_brute_force(spark):
    r = random.Random(5)
    texts = some_texts(60) + [f"Text {k}" for k in range(900)] + ["Same Row"] * 700 + ["Long TEXT " * 50_000]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    ids[2], ids[3], ids[5] = None, None, ids[6]
    df = documents(spark, texts, ids).withColumn("lang", F.when(F.col("text") == "Same Row", "en").otherwise(F.col("lang")))
    df = df.withColumn("doc_id", F.when(F.col("text") == "Same Row", 3).otherwise(F.col("doc_id")))
    df = df.withColumn("source", F.when(F.col("text") == "Same Row", "s").otherwise(F.col("source")))
    df = df.withColumn("lang", F.when(F.col("doc_id") == 11, "é").otherwise(F.col("lang")))
    rows = df.select(*FIELDS).collect()
    assert got(df) == brute(rows, every_third)
    assert got(df.limit(1)) == brute(df.limit(1).collect(), every_third)


def test_many_groups(spark):
    df = documents(spark, [f"T{k}" for k in range(650)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 600))
    assert got(df) == brute(df.collect(), every_third)


def test_untampered_and_paths(spark):
    df = documents(spark, some_texts(20))
    assert all(r[-1] for r in got(df, third=False))
    row = manifest_proofs(df, with_path=True).first()
    assert len(row.siblings) % 64 == 0 and not [c for c in merkle.PROOF.split(", ") if c.split()[0] not in row.asDict()]


def test_empty(spark):
    assert got(documents(spark, [])) == []
    assert len(got(documents(spark, [None, ""]))) == 2
