import re
from collections import Counter

from carelens.llm.repetition import measure, repetition_quality

from .util import documents, some_texts

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(SPACE, text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(n - 4)]
    count = Counter(grams)
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n)


def test_against_brute_force(spark):
    texts = some_texts() + ["line one\nline one\n \n \nline two\nline one ", "# * $ % & | < >"]
    got = {r.doc_id: r for r in repetition_quality(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def test_verdict():
    clean = " ".join(f"w{i}" for i in range(400))
    assert measure(clean)[6]
    lines = "\n".join([f"a{i} b{i}" for i in range(20)] + ["same line of four words"] * 5)
    assert not measure(lines)[6]
    copied = " ".join(f"w{i}" for i in range(100)) + " " + " ".join(f"w{i}" for i in range(8)) * 1
    assert measure(copied)[6]
    assert not measure(clean + " " + clean)[6]


def test_ids_and_empty(spark):
    assert repetition_quality(documents(spark, [])).collect() == []
    rows = repetition_quality(documents(spark, ["a b", "a b"], ids=[None, None])).collect()
    assert [r.doc_id for r in rows] == [None, None] and rows[0] == rows[1]
