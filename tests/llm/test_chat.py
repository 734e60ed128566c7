import hashlib

from carelens.llm.chat import conversation_digest, format_conversations, loss_mask, read_back

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, rows int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


ROWS = [
    (1, 0, "user", "a </turn>\n<turn assistant>\\l"), (1, 1, "assistant", "\\### Assistant: </turn> ok"),
    (1, 2, "assistant", "<next>\\b\\g"), (1, 3, None, None), (1, 4, "as<s>\\", ""), (1, 5, "assistant", "zü\n\n"),
    (2, 0, "user", ""), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, None, "system", "first"),
    (None, 0, "assistant", "no id"),
]


def test_round_trip_and_mask(spark):
    f = format_conversations(_frame(spark, ROWS))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_back(f).collect()}
    assert back[1] == [(r[2] or "", r[3] or "") for r in ROWS[:6]]
    assert back[2] == [("user", "")]
    assert back[3] == [("system", "first"), ("user", "x"), ("user", "x")]
    assert back[None] == [("assistant", "no id")]
    for r in loss_mask(f).collect():
        assert "".join(s.piece for s in r.mask) == r.formatted
        assert sum(s.loss for s in r.mask) == sum(role == "assistant" for role, _ in back[r.conv_id])
    text = {r.conv_id: r.formatted for r in f.collect()}
    assert text[1].count("<turn ") == 5 and text[1].count("<next>") == 1   # the assistant's turns are one block
    assert text[3].count("<turn ") == 2


def test_digest(spark):
    got = {r.conv_id: r for r in conversation_digest(format_conversations(_frame(spark, ROWS))).collect()}
    said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in ROWS[:6])
    loss = "".join(r[3] for r in ROWS[:6] if r[2] == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars) == (6, len(loss))


def test_empty_and_long(spark):
    assert format_conversations(_frame(spark, [])).collect() == []
    long = [(5, i, ("user", "assistant")[i % 2], "word " * 200) for i in range(3000)]
    got = conversation_digest(format_conversations(_frame(spark, long))).first()
    assert (got.n_turns, got.loss_chars) == (3000, 1500 * 1000)
