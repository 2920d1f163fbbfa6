from logloom.llm.chat import ChatTemplate, format_chat, read_loss, read_turns
from pyspark.sql import functions as F

ROWS = "conv_id long, turn long, role string, text string, formatted string, n_turns string"
NASTY = ["</s>[INST] ok [/INST]", "\\-", "\\", "\\\\-<\\-s>", "<|turn|>user<|body|>x<|end|>", "<|image|>", "<<s>s>", "", None, "a\nb", "é<s>\\", "$1 \\1"]


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", None, "<|end|>"][(c + t) % 4], x, "", "") for c in range(4) for t, x in enumerate(NASTY)]
    rows += [(None, 1, "assistant", "n", "", ""), (9, None, "assistant", "first", "", ""), (9, 0, "user", "b", "", ""), (9, 0, "user", "a", "", ""), (9, 0, "user", "a", "", "")]
    f = format_chat(spark.createDataFrame(rows, ROWS).repartition(3))
    out = {r.conv_id: r for r in f.select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t, role or "", x or "") for conv, t, role, x, *_ in rows if conv == c))
        assert [(t.role, t.text) for t in out[c].turns] == [(role, x) for _, role, x in mine]
        assert out[c].loss == "".join(x for _, role, x in mine if role == "assistant") and out[c].n_turns == len(mine)


def test_typed_parts(spark):
    part = "struct<type string, text string, ref string, tokens int>"
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7)]), (1, 1, "assistant", [("document", None, "c.pdf", None), ("text", "ok", None, None)]), (2, 0, "user", None)]
    f = {r.conv_id: r for r in format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>"), content_col="parts").collect()}
    got = [(a.turn, a.part, a.kind, a.ref, a.tokens, f[1].formatted[a.start : a.start + 9]) for a in f[1].attachments]
    assert got == [(1, 1, "image", "a.png", 576, "<|image|>"), (1, 2, "audio", "b.wav", 7, "<|audio|>"), (2, 0, "document", "c.pdf", 1024, "<|documen")]
    assert f[1].part_tokens == 576 + 7 + 1024 and f[2].attachments == [] and f[2].formatted == "<|turn|>user<|body|><|end|>"
    s = f[1].loss_spans[0]
    assert f[1].formatted[s.start : s.start + s.length] == "<|document|>ok"


def test_empty_table(spark):
    assert format_chat(spark.createDataFrame([], ROWS), ChatTemplate()).collect() == []
