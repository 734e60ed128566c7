"""run() against the stages done by brute force, on a small corpus of its own."""

import random
import zlib

import corpus_pipeline as P
from carelens.llm.surrogates import mentions, rendered
from carelens.llm.toxicity import fit_toxicity, score_toxicity

from .test_decontaminate import brute as contaminated
from .test_mixing import brute as mixed
from .test_simhash import brute_print, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, copies int"


def corpus():
    r = random.Random(12)
    stems = [f"{a}{b}{c}" for a in "bar tel mon rus".split() for b in "la ne ri".split() for c in "so tu mi ka".split()]
    passage = " ".join(f"exam{i}" for i in range(16))
    rows, labels = [], []
    for i in range(260):
        words = [r.choice(stems) for _ in range(r.randrange(30, 160))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["vileful", "zworst"]))
        text = " ".join(words)
        if i % 13 == 1:
            text += f" mail me.{i}@host.example.com or +1 (017) 555-{1000 + i} "
        if i % 17 == 2:
            text += " " + passage + " end"
        if i % 10 == 9:
            text = rows[i - 2][1]                        # an exact copy
        rows.append((i, text, r.choice(["en", "de", None]), f"src{r.randrange(5)}", len(text), "clash", i, 9))
        labels.append((i, 1, int(toxic and i % 10 != 9)))
    rows += [(260, None, None, None, 0, None, 0, 0), (261, "", "en", "src1", 0, None, 0, 0), (262, "x " * 4000, "en", None, 8000, None, 0, 0)]
    return rows, labels, [(1, passage), (2, None)]


def test_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("documents", rows, SCHEMA)
    write("labels", labels, "doc_id long, quality int, toxic int")
    write("benchmark", items, "item_id long, text string")
    out = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    bad = {r.doc_id for r in score_toxicity(docs, model).collect() if r.predicted}
    assert {i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 5} <= bad
    kept = {r[0]: r for r in rows if r[0] not in bad}
    prints = {i: brute_print(r[1]) for i, r in kept.items()}
    root = components(list(prints), prints)
    kept = {i: r for i, r in kept.items() if root[i] == i}
    kept = {i: r for i, r in kept.items() if not contaminated(r[1], items)[4]}
    assert 0 < len(kept) < 200
    texts = {}
    for i, r in kept.items():
        texts[i] = r[1]
        for a, b, kind, canon in reversed(mentions(r[1])):
            from carelens.llm.surrogates import surrogate
            texts[i] = texts[i][:a] + rendered(kind, texts[i][a:b], canon, surrogate(kind, canon, P.SURROGATE_KEY)) + texts[i][b:]
    domain = lambda s: s and f"d{int(s[3:]) % 4}"
    total = sum(len((t or "").split()) for t in texts.values())
    chosen = mixed([(i, texts[i], r[2], r[3], domain(r[3])) for i, r in kept.items()], P.WEIGHTS,
                   int(total * P.BUDGET_SHARE), P.MAX_EPOCHS, P.SEED)
    assert {i: r.mix_copies for i, r in out.items()} == chosen
    for i, r in out.items():
        assert (r.text, r.lang, r.source, r.row, r.key, r.copies) == (texts[i], *kept[i][2:4], *kept[i][5:])
        assert r.n_chars == (len(texts[i]) if texts[i] is not None else None)


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
