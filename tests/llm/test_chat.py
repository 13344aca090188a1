import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|", "é", "a b", "\n", " ", "</", "s>", "<\\s>"]), max_size=8).map("".join)


@settings(deadline=None)
@given(PIECES)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|text|>"]), PIECES), max_size=5))
def test_render_and_mask_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    code = chat.json_tokenizer().encode(text, add_special_tokens=False)
    loss, under = chat.mask(code.offsets, spans)
    assert "".join(chat.unescape(text[a:b]) for a, b in under) == "".join(x for r, x in turns if r == "assistant")
    assert len(loss) == len(code.ids)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes</s>", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "yes</s>", 0), (2, None, None, "x" * 50_000, 0), (None, 0, "assistant", "", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 14
    assert out[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nyes</s>\nassistant\nyes</s>\n").hexdigest()
    assert out[1].loss_sha256 == hashlib.sha256(b"yes</s>yes</s>").hexdigest()
    assert out[2].turns_sha256 == hashlib.sha256(b"\n" + b"x" * 50_000 + b"\n").hexdigest() and out[2].loss_chars == 0
    assert out[None].n_turns == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["conversations"])
def test_query_reads_every_conversation(spark, sf, name):
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    out = chat.op3_chat_format(spark, sf)
    assert out.count() == table.select("conv_id").distinct().count() + 1
    told = out.agg({"loss_chars": "sum"}).first()[0]
    assert told == table.where("role = 'assistant'").selectExpr("sum(length(text))").first()[0] + len("</s>[INST] ok [/INST]")
