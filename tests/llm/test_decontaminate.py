import hashlib
import random
import re

from carelens.llm.decontaminate import contamination_digest, decontaminate, find_contamination

from .util import documents, some_texts

ITEM_SCHEMA = "item_id long, text string, w string, phrase string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        iw = words(t)
        k = min(10, len(iw))
        for p in {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if k else ():
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) == p:
                    hit |= set(range(i, i + k))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark):
    texts = some_texts(n=25)
    r = random.Random(8)
    items = [(1, None), (2, ""), (3, "Stone"), (4, "the of"), (5, "ÜBER über Über"), (6, " ".join(words(texts[8])[3:30])),
             (7, " ".join(words(texts[8])[3:30])), (12, " ".join(words(texts[14])[:11]).upper()), (100, "nothing has these words " * 4),
             (13, "a a a a a a a a a a a a"), (None, "run_on don't")]
    texts += ["a " * 30 + "b " + "a " * 11, "x " + " ".join(words(texts[8])[5:15]) + " y", " ".join(words(texts[8])[5:14]), "ÜBER Über!!über"]
    texts += [" ".join(r.choice(["a", "the", "of"]) for _ in range(200))]
    items = [(i, t) for i, t in items if i is not None]
    table = spark.createDataFrame([(i, t, "w", "p") for i, t in items], ITEM_SCHEMA)
    for rows in (500_000, 0):
        got = {x.doc_id: x for x in contamination_digest(
            find_contamination(documents(spark, texts), table, broadcast_rows=rows)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            x = got[i]
            assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == brute(t, items), (i, t)


def test_stage_keeps_clean_rows_and_columns(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    texts = ["clean text", f"before {passage} after", None, "", "clean text"]
    docs = documents(spark, texts, ids=[None, 1, 2, None, None])
    items = spark.createDataFrame([(1, passage, "", "")], ITEM_SCHEMA)
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.text or "") for r in kept.collect()) == [(False, ""), (True, ""), (True, "clean text"), (True, "clean text")]
    empty = spark.createDataFrame([], ITEM_SCHEMA)
    assert decontaminate(docs, empty).count() == 5
    assert decontaminate(documents(spark, []), items).count() == 0
