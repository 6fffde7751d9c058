"""Operator 6: chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := "<s>" ["[ESC]"] turn*
    turn         := "[INST] " text " [/INST]" | "[ANS] " text " </s>" | "[ROLE " role "] " text " [/ROLE]"

A conversation is first written as it is. The text is parsed again by a deterministic parser (the leftmost, shortest turns) and the
recovered turns are compared with the source; where they differ, the texts hold control strings, and the conversation is written
again under "[ESC]" with backslash and the characters that control strings begin and end with escaped, which no text can upset.
A second parse must give the source back, or the query fails. Role names are always escaped.

Null role or text is empty. Turns are in order of (turn, role, text), a null turn first; repeated rows are repeated turns. Rows with
a null conv_id are one conversation. An empty table gives no conversations. Extra columns are ignored. A conversation is one row of
the result, so its turns meet in one task; conversations are as long as people make them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (character, escape); the escape character goes first when escaping and last when reading.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"), ("[", "\\b"), ("]", "\\d"))
BEGIN, ESCAPED = "<s>", "<s>[ESC]"
USER, ASSISTANT = ("[INST] ", " [/INST]"), ("[ANS] ", " </s>")
OTHER = ("[ROLE ", "] ", " [/ROLE]")
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[ANS\] .*? </s>|\[ROLE [^\]]*\] .*? \[/ROLE\]"


def escape(c: Column) -> Column:
    for char, code in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for char, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def _write_turn(role: Column, text: Column) -> Column:
    marked = F.when(role == "user", F.concat(F.lit(USER[0]), text, F.lit(USER[1]))).when(role == "assistant", F.concat(F.lit(ASSISTANT[0]), text, F.lit(ASSISTANT[1])))
    return marked.otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), text, F.lit(OTHER[2])))


def write(turns: Column, escaped: bool) -> Column:
    """A conversation from an array of (role, text)."""
    texts = F.transform(turns, lambda t: _write_turn(t["role"], escape(t["text"]) if escaped else t["text"]))
    return F.concat(F.lit(ESCAPED if escaped else BEGIN), F.array_join(texts, ""))


def _between(c: Column, before: Column | int, after: int) -> Column:
    before = F.lit(before) if isinstance(before, int) else before
    return F.substring(c, before + 1, F.length(c) - before - after)


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    plain = ~F.startswith(formatted, F.lit(ESCAPED))
    body = F.when(plain, F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted))).otherwise(F.substring(formatted, F.lit(len(ESCAPED) + 1), F.length(formatted)))

    def turn(c: Column) -> Column:
        role = F.regexp_extract(c, r"^\[ROLE ([^\]]*)\]", 1)
        user, assistant = F.startswith(c, F.lit(USER[0])), F.startswith(c, F.lit(ASSISTANT[0]))
        text = F.when(user, _between(c, len(USER[0]), len(USER[1]))).when(assistant, _between(c, len(ASSISTANT[0]), len(ASSISTANT[1])))
        text = text.otherwise(_between(c, F.length(role) + len(OTHER[0]) + len(OTHER[1]), len(OTHER[2])))
        return F.struct(F.when(user, "user").when(assistant, "assistant").otherwise(unescape(role)).alias("role"), F.when(plain, text).otherwise(unescape(text)).alias("text"))

    return F.transform(F.regexp_extract_all(body, F.lit(TURN), 0), turn)


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, turns): turns is what the parser reads from formatted, equal to the source."""
    c = lambda name, kind: F.col(f"`{name}`").cast(kind)
    rows = df.select(c(id_col, "long").alias("conv_id"), c(turn_col, "long").alias("turn"), F.coalesce(c(role_col, "string"), F.lit("")).alias("role"), F.coalesce(c(text_col, "string"), F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    source = whole.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", write(F.col("source"), escaped=False))
    chosen = plain.select("conv_id", "source", F.when(parse(F.col("plain")) == F.col("source"), F.col("plain")).otherwise(write(F.col("source"), escaped=True)).alias("formatted"))
    read = chosen.withColumn("turns", parse(F.col("formatted")))
    return read.select("conv_id", "formatted", F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error("a conversation was not recovered")).alias("turns"))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: what the assistant says."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def loss_spans(turns: Column, formatted: Column) -> Column:
    """The loss mask as (begin, length) in code points of formatted, one span for each assistant turn."""
    escaped = F.startswith(formatted, F.lit(ESCAPED))
    shown = lambda t: F.when(escaped, escape(t["text"])).otherwise(t["text"])

    def step(acc, t):
        is_loss = t["role"] == "assistant"
        span = F.array(F.struct((acc["at"] + len(ASSISTANT[0])).cast("int").alias("begin"), F.length(shown(t)).alias("length")))
        return F.struct((acc["at"] + F.length(_write_turn(t["role"], shown(t)))).cast("int").alias("at"), F.when(is_loss, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    empty = F.struct(F.when(escaped, len(ESCAPED)).otherwise(len(BEGIN)).cast("int").alias("at"), F.array().cast("array<struct<begin:int,length:int>>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda acc: acc["spans"])
