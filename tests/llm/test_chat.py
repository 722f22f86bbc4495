import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from furlong.llm import chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role:", "<|end|>", "<|image:", "\\", " ", "|", "a", "\n", "<", ">"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(text=TEXT)
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


@settings(max_examples=500, deadline=None)
@given(role=st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), text=TEXT)
def test_pieces_read_back(role, text):
    assert chat.read_piece(chat.mark(role, chat.escape(text))) == (role, text, role == "assistant")


def test_parts(spark):
    turns = spark.createDataFrame(
        [
            (1, 0, "user", [("text", "look <s>", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), None]),
            (1, 1, "assistant", [("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2)]),
            (1, 2, "user", []),
        ],
        f"conv_id long, turn long, role string, parts array<{chat.PART}>",
    )
    rows = chat.format_turns(turns).orderBy("turn").collect()
    assert rows[0]["piece"] == "<s>[INST] look \\<s><|image:0|> [/INST]"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in rows[1]["attachments"]] == [("audio", "b.wav", 38), ("document", "c.pdf", 1024)]
    assert [row["expanded_tokens"] for row in rows] == [4, 1062, 0]
    assert [row["loss"] for row in rows] == [False, True, False]


def test_conversations(spark):
    said = [(1, 1, "assistant", "b\\"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "user", ""), (None, 0, "tool|x", "q"), (1, 1, "assistant", "b\\")]
    rows = chat.read_back(chat.format_turns(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))).collect()
    found = {row["conv_id"]: row for row in rows}
    whole = "user\na\nassistant\nb\\\nassistant\nb\\\n\n\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert (found[1]["n_turns"], found[1]["loss_chars"], found[2]["loss_chars"]) == (4, 4, 0)
    assert found[1]["loss_sha256"] == hashlib.sha256(b"b\\b\\").hexdigest()
    assert found[None]["turns_sha256"] == hashlib.sha256(b"tool|x\nq\n").hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(empty)).count() == 0


def test_one_long_conversation(spark):
    turns = spark.range(5000).selectExpr("7L as conv_id", "id as turn", "'user' as role", "concat('t', id) as text")
    row = chat.read_back(chat.format_turns(turns)).first()
    assert row["n_turns"] == 5000
    assert row["turns_sha256"] == hashlib.sha256("".join(f"user\nt{i}\n" for i in range(5000)).encode()).hexdigest()
