import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from carelens.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, lang string, source string, domain string, place string, w int"


def corpus(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        domain = r.choice(["web", "web", "web", "book", None])
        lang = r.choice(["en", "en", "de", None])
        source = "hot" if r.random() < .4 else f"s{r.randrange(4)}"
        rows.append((i, None if i % 50 == 0 else " ".join("w" for _ in range(r.randrange(0, 60))), lang, source, domain, "clash", 3))
    return rows


def fill(children, given):
    """children: {key: (cap, weight)}; whole-token water filling, ends rounded as documented."""
    order = sorted((k for k in children if children[k][1] > 0), key=lambda k: (children[k][0] / children[k][1], k))
    out, left = {}, given
    while order:
        k = order[0]
        cap, w = children[k]
        if cap * sum(children[j][1] for j in order) <= left * w:
            out[k] = cap
            left -= cap
            order.pop(0)
        else:
            break
    total, upto = sum(children[k][1] for k in order), 0
    for k in order:
        upto += children[k][1]
        out[k] = left * upto // total - left * (upto - children[k][1]) // total
    return out


def key(v):
    return "n" if v is None else f"v{v}"


def brute(rows, weights, budget, max_epochs, seed):
    tokens = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    leaf = defaultdict(list)
    for r in rows:
        leaf[tuple(key(r[k]) for k in (4, 2, 3))].append(r[0])
    have = {p: sum(tokens[i] for i in ids) for p, ids in leaf.items()}
    w = {tuple(key(x) for x in p): v for p, v in weights.items()}
    grants = {(): min(budget, sum(have.values()) * max_epochs)}
    have = {p: n for p, n in have.items() if all(w.get(p[:d], 1) for d in (1, 2, 3))}      # nothing below a weight of 0 counts
    for depth in (1, 2, 3):
        nodes = {p[:depth] for p in have}
        for parent in {p[:-1] for p in nodes}:
            if parent in grants:
                kids = {p: (sum(have[q] for q in have if q[:depth] == p) * max_epochs, w.get(p, 1)) for p in nodes if p[:-1] == parent}
                grants |= fill(kids, grants[parent])
    out = {}
    for p, ids in leaf.items():
        if p not in grants or p not in have:
            continue
        epochs = grants[p] // have[p] if have[p] else 0
        rest, upto = grants[p] - epochs * have[p], 0
        for i in sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{epochs}|{i}".encode()).hexdigest(), str(i))):
            upto += tokens[i]
            if epochs + (upto <= rest) > 0:
                out[i] = epochs + (upto <= rest)
    return out


LEVELS = {"domain": F.col, "lang": F.col, "source": F.col}


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    return mix_sources(docs, {k: F.col(k) for k in LEVELS}, **options)


@pytest.mark.parametrize("budget,epochs", [(2000, 1), (9000, 3), (10 ** 9, 2), (0, 2)])
def test_against_brute_force(spark, budget, epochs):
    rows = corpus()
    weights = {("web",): 1, ("book",): 6, (None,): 2, ("web", "en"): 3, ("book", "de"): 0, ("web", "en", "hot"): 2}
    got = run(spark, rows, weights=weights, budget=budget, max_epochs=epochs, seed="s").select("row.doc_id", "copies").collect()
    assert {r.doc_id: r.copies for r in got} == brute(rows, weights, budget, epochs, "s")
    assert len(got) == len({r.doc_id for r in got})


def test_what_a_closed_branch_could_take_goes_to_its_siblings(spark):
    rows = [(i, "w " * 100, "l", s, d, "x", 1) for i, (d, s) in enumerate([("x", "p")] * 5 + [("x", "q")] * 5 + [("y", "r")] * 10)]
    out = run(spark, rows, weights={("x", "l", "q"): 0}, budget=1500, max_epochs=1).select("row.domain", "row.source", "tokens", "copies").collect()
    got = {}
    for r in out:
        got[r.domain, r.source] = got.get((r.domain, r.source), 0) + r.tokens * r.copies
    assert got == {("x", "p"): 500, ("y", "r"): 1000}
    assert run(spark, rows, weights={("x",): 0, ("y",): 0}, budget=1500).collect() == []


def test_budget_is_met(spark):
    rows = corpus(600, 2)
    out = run(spark, rows, weights={}, budget_share=0.5, max_epochs=2)
    total = sum(len((r[1] or "").split()) for r in rows)
    taken = out.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert total * 0.5 - 60 * 60 <= taken <= total * 0.5      # each leaf stops before the row that would go over
    assert run(spark, rows, weights={}, budget_share=0.5, max_epochs=2, seed="other").select("row.doc_id").exceptAll(
        out.select("row.doc_id")).count() > 0


def test_odd_rows(spark):
    assert run(spark, [], weights={}).collect() == []
    rows = [(None, "a b c", None, None, None, "x", 1), (None, "d e", None, None, None, "x", 1), (5, "a", "en", "s", "d", "x", 1),
            (5, "a", "en", "s", "d", "x", 1), (6, None, "en", "s", "d", "x", 1), (7, "", "de", "t", "e", "x", 1)]
    out = run(spark, rows, weights={}, max_epochs=2, budget_share=1.0).collect()
    assert sum(r.tokens * r.copies for r in out) <= 7
    every = run(spark, rows, weights={}, max_epochs=2, budget_share=2.0).collect()
    assert sum(r.tokens * r.copies for r in every) == 14 and {r.row.doc_id for r in every} >= {None, 5}
