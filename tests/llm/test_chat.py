import hashlib

from hypothesis import given
from hypothesis import strategies as st

from rowloom.llm import chat


@given(st.text(alphabet="<|\\ab\n>"), st.text(alphabet="<|\\ab\n>"))
def test_reads_back(role, text):
    parts = chat.segments(role, text, chat.CHATML)
    assert chat.read_back(parts, chat.CHATML)[:2] == (role, text)
    assert "<|" not in parts[1][0]


def test_rows(spark):
    rows = [
        (1, 0, "user", "a", "x"), (1, 1, "assistant", "b|<|im_end|>", "x"), (2, 5, "assistant", "c", "x"), (3, 0, None, None, "x"),
        (None, 1, "user", "q", "x"), (1, 1, "assistant", "b|<|im_end|>", "x"), (4, 0, "system", "s", "x"), (4, 1, "user", "", "x"), (4, 2, "assistant", "é", "x"),
    ]
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string"))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == h("user\na\n" + "assistant\nb|<|im_end|>\n" * 2) and got[1].n_turns == 3 and not got[1].valid
    assert got[1].loss_sha256 == h("b|<|im_end|>" * 2) and got[1].loss_chars == 24
    assert got[4].valid and not got[2].valid and not got[3].valid and got[3].turns_sha256 == h("\n\n")
    assert got[4].loss_chars == 1 and got[3].loss_sha256 == h("")


def test_long_conversation_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(7, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(20)]
        got = chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got.n_turns == 20 and got.valid
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


def test_empty(spark):
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_large_ids_stay_whole_beside_a_null(spark):
    big = 2**53
    rows = [(i, t, r, "x") for i in (big, big + 1, big + 3, None) for t, r in enumerate(("user", "assistant"))]
    got = {r.conv_id: r.n_turns for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {big: 2, big + 1: 2, big + 3: 2, None: 2}


def test_text_ids_and_the_word_null(spark):
    rows = [("null", 0, "user", "a"), (None, 0, "user", "b"), ("n", 0, "user", "c"), ("null", 1, "assistant", "d")]
    got = {r.conv_id: (r.n_turns, r.valid) for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))).collect()}
    assert got == {"null": (2, True), None: (1, False), "n": (1, False)}
