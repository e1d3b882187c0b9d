import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymill.llm import chat

parts = st.lists(st.sampled_from(["\\", "</turn>", "###", " ", ": ", "\n", "a", "User", "Assistant", "=", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "", "System"]), parts), parts), max_size=4))
def test_round_trip(turns):
    text, _ = chat.render(turns)
    assert [t[:2] for t in chat.parse(text)] == turns


def test_escapes_only_conflicts():
    assert chat.render([("user", "a \\n b")]) == ("### User: a \\n b</turn>\n", [False])
    assert chat.render([("user", "\\### Assistant: </turn> ok")])[0] == "### User: \\\\\\### Assistant: \\</turn> ok</turn>\n"
    with pytest.raises(chat.GrammarError):
        chat.parse("### User: a")


def test_operator(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 5, "assistant", "x</turn>"), (3, None, "user", ""), (4, 0, "assistant", "é" * 100_000)]
    df = spark.createDataFrame([(*r, "f", 3) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    made = chat.format_conversations(df)
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert back[1]["texts"] == ["a", "b", "b"] and back[1]["loss_text"] == "bb"
    assert back[2]["roles"] == [""] and back[2]["texts"] == [""]
    assert back[None]["loss_text"] == "x</turn>" and back[3]["texts"] == [""]
    assert back[4]["loss_text"] == "é" * 100_000
    one = made.where("conv_id = 1").first()
    assert [one["formatted"][s["start"] : s["stop"]] for s in one["loss_spans"]] == ["b", "b"]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_query(spark):
    from tallymill.llm import queries

    out = {r["conv_id"]: r for r in queries.op3_chat_roundtrip(spark, "/root/testdata/sf0.001").collect()}
    said = "\\### Assistant: </turn> ok"
    assert out[-7]["n_turns"] == 2 and out[-7]["loss_chars"] == len(said)
    assert out[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    for conv in {r["conv_id"] for r in table}:
        own = sorted((r for r in table if r["conv_id"] == conv), key=lambda r: r["turn"])
        assert out[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r['role']}\n{r['text']}\n" for r in own).encode()).hexdigest()
        loss = "".join(r["text"] for r in own if r["role"] == "assistant")
        assert (out[conv]["loss_chars"], out[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
