import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtree.llm import chat_format as C

PIECES = st.lists(st.sampled_from([*C.CONTROLS, "\\", "<", "[", "</s", "s>", " ", "\n", "<\\s>", "a", "[/INST", "]", "%0a", " [/INST]", " </s>"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES, st.sampled_from(["user", "assistant", "system", "tool", "", "x]\n<s>%5d[/ROLE]"]), PIECES)
def test_any_text_survives(text, role, more):
    rendered, turn = C.render_turn(role, text)
    other, _ = C.render_turn("assistant", more)
    assert (turn.role, turn.text) == (role, text)
    assert [(t.role, t.text) for t in C.parse(rendered + other)] == [(role, text), ("assistant", more)]
    assert C.unescape(rendered[turn.start : turn.end]) == text


def test_bad_grammar_is_refused():
    for bad in ("x", "<s>[INST] a", "<s>[ROLE a", "<s>[INST] a <s> [/INST]"):
        with pytest.raises(C.GrammarError):
            list(C.parse(bad))


@pytest.mark.parametrize("part_chars", [1 << 20, 40])
def test_digests(spark, part_chars):
    rows = [(1, 2, "assistant", "yes </s> é"), (1, 1, "user", None), (1, 2, "assistant", "yes </s> é"), (1, None, None, "[INST]"), (None, 1, "tool", "t" * 1000), (3, 1, "assistant", ""), (4, 1, "user", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int")
    got = {r.conv_id: r for r in C.digest_chats(C.format_chats(df, part_chars=part_chars)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, None, 3, 4}
    for conv, row in got.items():
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert row.n_turns == len(own)
        assert row.turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))
        assert row.formatted_chars == sum(len(C.render_turn(r[2] or "", r[3] or "")[0]) for r in own)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digest_chats(C.format_chats(df)).count() == 0
