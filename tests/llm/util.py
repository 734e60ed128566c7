"""Documents that every operator must survive: nulls, empty, long, repeated rows."""

import random

WORDS = "the of and river stone table window Über ñandú 東京 run_on don't x1 %% ### a b c d".split()


def some_texts(n=40, seed=3, longest=300):
    r = random.Random(seed)
    out = [None, "", "   \n\t ", "one", "a b", "ab ab " * 40, "x" * 5000, "\x1c\x85   end\x0bv"]
    shared = " ".join(r.choice(WORDS) for _ in range(70))
    for i in range(n):
        words = [r.choice(WORDS) + (str(r.randrange(50)) if r.random() < .6 else "") for _ in range(r.randrange(1, longest))]
        text = "".join(w + r.choice([" ", " ", " ", "\n", "\t", "  "]) for w in words)
        out.append(text + shared + " " + text if i % 5 == 0 else text)
    return out + out[8:14]


def documents(spark, texts, ids=None):
    """The documents table with extra columns whose names operators might use."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(
        [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else "src0", len(t or ""), "clash", k, 1.5)
         for k, (i, t) in enumerate(zip(ids, texts, strict=True))],
        "doc_id long, text string, lang string, source string, n_chars long, words string, n_words int, score double")
