from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerpitch.llm import chat_format as cf
from ledgerpitch.llm.queries import PROBE

PARTS = ["[INST]", "[/INST]", " [/INST]", "<s>", " </s>", "</s>", "<<SYS>>", " <</SYS>>", " <</ROLE>>", "<<ROLE>> ",
         "\\", "[\\INST]", "<\\/s>", "|", "\\|", "<", "[", " ", "\n", "é", "🙂", "ok"]
texts = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), texts)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.builds(cf.Turn, roles, texts), max_size=5))
def test_every_conversation_comes_back(turns):
    text = "".join(cf.render_turn(turn)[0] for turn in turns)
    at, back = 0, []
    while at < len(text):
        turn, _, _, at = cf.parse_turn(text, at)
        back.append(turn)
    assert back == turns


@given(texts)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    assert cf.unescape(cf.escape(text)) == text
    assert not any(c in cf.escape(text) for c in ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"))


def test_only_conflicting_content_is_escaped():
    assert cf.render_turn(cf.Turn("user", "plain <s> text"))[3] is False
    assert cf.render_turn(cf.Turn("user", PROBE))[3] is True


def digests(turns):
    joined = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_digests_against_brute_force(spark):
    rows = [
        (1, 1, "assistant", PROBE, "x"), (1, 0, "user", PROBE, "x"), (2, 0, "system", None, "x"),
        (2, 1, "assistant", "é" * 9, "x"), (2, 1, "assistant", "é" * 9, "x"), (2, 1, "assistant", "a", "x"),
        (None, 0, "user", "lost", "x"), (None, None, None, "", "x"), (3, 0, "assistant", "long </s> " * 50_000, "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got = {r[0]: tuple(r)[1:5] for r in cf.read_back(cf.format_turns(turns)).collect()}
    assert got == {
        1: digests([("user", PROBE), ("assistant", PROBE)]),
        2: digests([("system", ""), ("assistant", "a"), ("assistant", "é" * 9), ("assistant", "é" * 9)]),
        None: digests([("", ""), ("user", "lost")]),
        3: digests([("assistant", "long </s> " * 50_000)]),
    }
    assert cf.read_back(cf.format_turns(turns.limit(0))).count() == 0


def test_formatted_rows_can_be_stored(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{PROBE} {t}") for c in range(20) for t in range(6)]
    formatted = cf.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    direct = {tuple(r) for r in cf.read_back(formatted).collect()}
    formatted.write.parquet(str(tmp_path / "chat"))
    again = cf.read_back(cf.stored_order(spark.read.parquet(str(tmp_path / "chat"))))
    assert {tuple(r) for r in again.collect()} == direct
