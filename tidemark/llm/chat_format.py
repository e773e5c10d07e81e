"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation becomes one text: a header with its escape level, then for each
turn ``[INST]role<newline>text[/INST]``, or ``<s>text</s>`` for the assistant. It is
rendered at level 0, where nothing is escaped, and parsed again by the grammar.
If the turns that come back are not the source, or the turns do not cover the
whole text, level 1 escapes the control strings inside the texts, and level 2
every character that could begin one, the escape character included. Level 2
comes back identical for every text, and the level taken is the first that does.

Defined results: turns are in order of turn, role and text, nulls first; null
roles and texts count as empty, repeated turns are kept, and a null conv_id is a
conversation. A conversation is one output row, as its text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>")
HEADER = "<chat {}>\n"
_TURN = r"(?s)\[INST\]([^\n]*)\n(.*?)\[/INST\]|<s>(.*?)</s>"
#: Character and escape, the escape character first.
_ESCAPES = (("~", "~0"), ("[", "~1"), ("<", "~2"))


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, level: int) -> Column:
    if level == 1:
        for control in CONTROLS:
            text = _replace(text, control, dict(_ESCAPES)[control[0]] + control[1:])
    if level == 2:
        for old, new in _ESCAPES:
            text = _replace(text, old, new)
    return text


def unescape(text: Column, level: Column) -> Column:
    plain = text
    for old, new in reversed(_ESCAPES):
        plain = F.when((level == 2) | (F.lit(old) != "~"), _replace(plain, new, old)).otherwise(plain)
    return F.when(level == 0, text).otherwise(plain)


def _role(role: Column, level: int) -> Column:
    return _replace(escape(role, level), "\n", "~3") if level == 2 else escape(role, level)


def render(turns: Column, level: int) -> Column:
    """The text of an array of struct<role,text>."""

    def one(turn: Column) -> Column:
        said = escape(turn["text"], level)
        return F.when(turn["role"] == ASSISTANT, F.concat(F.lit("<s>"), said, F.lit("</s>"))).otherwise(
            F.concat(F.lit("[INST]"), _role(turn["role"], level), F.lit("\n"), said, F.lit("[/INST]"))
        )

    return F.concat(F.lit(HEADER.format(level)), F.array_join(F.transform(turns, one), ""))


def level_of(formatted: Column) -> Column:
    return F.regexp_extract(formatted, r"^<chat (\d)>\n", 1).cast("int")


def parse(formatted: Column) -> Column:
    """Turns as array of struct<role,text>; null where the text is no sentence of the grammar."""
    level = level_of(formatted)
    body = F.substring(formatted, len(HEADER.format(0)) + 1, F.length(formatted))
    whole, role, said, answer = (F.regexp_extract_all(body, F.lit(_TURN), F.lit(i)) for i in range(4))

    def one(turn: Column) -> Column:
        theirs = F.startswith(turn["whole"], F.lit("<s>"))
        name = F.when(level == 2, _replace(turn["role"], "~3", "\n")).otherwise(turn["role"])
        return F.struct(
            F.when(theirs, F.lit(ASSISTANT)).otherwise(unescape(name, level)).alias("role"),
            unescape(F.when(theirs, turn["answer"]).otherwise(turn["said"]), level).alias("text"),
        )

    turns = F.transform(F.arrays_zip(whole.alias("whole"), role.alias("role"), said.alias("said"), answer.alias("answer")), one)
    covered = F.aggregate(F.transform(whole, F.length), F.lit(0).cast("long"), lambda a, n: a + n)
    return F.when(level.isNotNull() & (covered == F.length(body)), turns)


def loss_spans(turns: Column, formatted: Column) -> Column:
    """Places of the assistant's texts, as they stand in the formatted text: array of struct<start,length> in code points."""
    level = level_of(formatted)
    state = F.struct(F.lit(len(HEADER.format(0))).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def size(turn: Column) -> tuple[Column, Column]:
        said, role = (F.when(level == 0, F.length(c)).when(level == 1, F.length(e1)).otherwise(F.length(e2)) for c, e1, e2 in (
            (turn["text"], escape(turn["text"], 1), escape(turn["text"], 2)), (turn["role"], _role(turn["role"], 1), _role(turn["role"], 2))))
        return said, F.when(turn["role"] == ASSISTANT, said + 7).otherwise(said + role + 14)

    def step(held: Column, turn: Column) -> Column:
        said, all_of_it = size(turn)
        span = F.array(F.struct((held["at"] + 3).alias("start"), said.alias("length")))
        return F.struct((held["at"] + all_of_it).alias("at"), F.when(turn["role"] == ASSISTANT, F.concat(held["spans"], span)).otherwise(held["spans"]).alias("spans"))

    return F.aggregate(turns, state, step)["spans"]


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, level, formatted, loss_spans for each conversation of ``rows(conv_id, turn, role, text)``."""
    said = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("ordered"))
    turns = grouped.select("conv_id", F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    texts = [render(F.col("turns"), level) for level in range(3)]
    fits = [parse(text).eqNullSafe(F.col("turns")) for text in texts[:2]]
    formatted = turns.withColumn("formatted", F.when(fits[0], texts[0]).when(fits[1], texts[1]).otherwise(texts[2]))
    return formatted.select("conv_id", level_of(F.col("formatted")).alias("level"), "formatted", loss_spans(F.col("turns"), F.col("formatted")).alias("loss_spans"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted texts."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
