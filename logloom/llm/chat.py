"""Chat formatting with typed content parts, in DataFrame operations only.

A turn is `<|turn|>role<|body|>content<|end|>`. Control strings inside roles and texts are broken
by `\\-` after their first character, with backslashes doubled before, so that reading left to
right restores every text. Image, audio and document parts become placeholders in their place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"


@dataclass(frozen=True)
class ChatTemplate:
    #: Tokens that a placeholder of each kind stands for; a part may name its own number.
    part_tokens: dict[str, int] = field(default_factory=lambda: {"image": 576, "audio": 250, "document": 1024})
    #: Roles whose content carries the loss.
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Control strings of this and other templates.
    control: tuple[str, ...] = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>")

    def placeholder(self, kind: str) -> str:
        return f"<|{kind}|>"


def escape(c: Column, template: ChatTemplate) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in (*template.control, *map(template.placeholder, template.part_tokens)):
        out = F.replace(out, F.lit(s), F.lit(f"{s[0]}\\-{s[1:]}"))
    return out


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(?:(\\)|-)", "$1")


#: What a typed part may hold.
PART = T.StructType().add("type", "string").add("text", "string").add("ref", "string").add("tokens", "integer")


def parts_of(content: Column, kind: T.DataType) -> Column:
    """Content as array<PART>: a string is one text part; null is none."""
    if isinstance(kind, T.StringType):
        return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(content, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))
    have = {f.name for f in kind.elementType.fields}
    pick = lambda p, f: (p[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
    return F.coalesce(F.transform(F.filter(content, lambda p: p.isNotNull()), lambda p: F.struct(*[pick(p, f) for f in PART.fields])), F.array().cast(T.ArrayType(PART)))


def format_chat(rows: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """One row a conversation from one row a turn.

    content_col is text or array<struct<type, text, ref, tokens>>. Returns <conv_col>, n_turns long,
    formatted string, loss_spans array<struct<start, length>> (code points of formatted, counted
    from 0), attachments array<struct<turn, part, kind, ref, tokens, start>> in order, and
    part_tokens long (tokens that the placeholders expand to). Turns go by turn_col, nulls first;
    ties by role, then by content; repeated rows stay. Null roles and texts are empty. Parts of an
    unknown kind are text. A null conversation id is one conversation. Other columns are ignored.
    """
    template = template or ChatTemplate()
    kinds = list(template.part_tokens)
    parts = parts_of(F.col(content_col), rows.schema[content_col].dataType)
    shown = lambda p: F.when(p["type"].isin(kinds), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit("")), template))
    cost = lambda p: F.coalesce(p["tokens"], F.element_at(F.create_map(*[F.lit(x) for kv in template.part_tokens.items() for x in kv]), p["type"]))
    t = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), parts.alias("parts"))
    t = t.withColumn("shown", F.transform("parts", lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.when(p["type"].isin(kinds), cost(p)).alias("tokens"), shown(p).alias("s"))))
    t = t.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role"), template), F.lit(BODY))).withColumn("body", F.array_join(F.transform("shown", lambda p: p["s"]), ""))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("chars", F.length("piece").cast("long"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body", F.to_json("parts"))
    t = t.withColumn("at", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    before = F.transform("shown", lambda p, i: F.length(F.array_join(F.transform(F.slice("shown", 1, i), lambda x: x["s"]), "")))
    attached = F.filter(
        F.transform(F.arrays_zip("shown", before.alias("before")), lambda z, i: F.struct(F.col("at").alias("turn"), i.alias("part"), z["shown"]["type"].alias("kind"), z["shown"]["ref"].alias("ref"), z["shown"]["tokens"].alias("tokens"), (F.col("start") + z["before"]).alias("start"))),
        lambda a: a["tokens"].isNotNull(),
    )
    loss = F.when(F.col("role").isin(*template.loss_roles), F.struct("start", F.length("body").cast("long").alias("length")))
    t = t.select("conv", F.struct("at", "piece", loss.alias("loss"), attached.alias("attached")).alias("turn"))
    g = t.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    g = g.select(
        F.col("conv").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.loss"), lambda s: s.isNotNull()).alias("loss_spans"), F.flatten(F.col("turns.attached")).alias("attachments"),
    )
    return g.withColumn("part_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay in the text."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    cut = lambda x: F.split(F.replace(x, F.lit(END), F.lit("")), r"<\|body\|>", 2)
    return F.transform(F.transform(turns, cut), lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
