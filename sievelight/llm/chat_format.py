r"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn := "[INST] " text " [/INST]"            role "user"
          | "<s> " text "</s>"                   role "assistant"
          | "[ROLE " role "] " text " [/ROLE]"   any other role

A text holds no control string (``[INST]``, ``[/INST]``, ``<s>``, ``</s>``, ``[ROLE``, ``[/ROLE]``). The parser cuts before
every opening mark, strips the marks of each turn and undoes the escapes ``\b`` (backslash), ``\o`` ([), ``\l`` (<) and
``\c`` (]). Each turn is first rendered as it is and parsed again; where the parser does not give back the same role and
text, the text is escaped: every backslash, ``[`` and ``<`` of it is replaced, so that no control string can be left.
The second rendering is parsed and compared too, and so is the whole conversation; a difference would end the job.

Defined results: turns are ordered by (turn, role, text), a null turn number first; repeated rows are turns of their
own. A null text or role is empty. A null conv_id is one conversation. A conversation has one output row, which holds
its whole text: that is the size of a task's largest record. An empty table gives an empty result; other columns of the
input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
BOT_OPEN, BOT_CLOSE = "<s> ", "</s>"
ROLE_OPEN, ROLE_CLOSE = "[ROLE ", " [/ROLE]"
CONTROL = r"\[/?INST\]|</?s>|\[/?ROLE"
TURN_START = r"(?=\[INST\] |<s> |\[ROLE )"


def escape(text: Column) -> Column:
    for raw, kept in (("\\", "\\b"), ("[", "\\o"), ("<", "\\l"), ("]", "\\c")):
        text = F.replace(text, F.lit(raw), F.lit(kept))
    return text


def unescape(text: Column) -> Column:
    for raw, kept in (("]", "\\c"), ("<", "\\l"), ("[", "\\o"), ("\\", "\\b")):
        text = F.replace(text, F.lit(kept), F.lit(raw))
    return text


def opening(role: Column) -> Column:
    return F.when(role == "user", USER_OPEN).when(role == "assistant", BOT_OPEN).otherwise(F.concat(F.lit(ROLE_OPEN), escape(role), F.lit("] ")))


def closing(role: Column) -> Column:
    return F.when(role == "user", USER_CLOSE).when(role == "assistant", BOT_CLOSE).otherwise(ROLE_CLOSE)


def _parse_turn(part: Column) -> Column:
    """(role, text) of one rendered turn; the text is null where the grammar does not hold."""

    def inner(begin: Column, close: str) -> Column:
        body = F.substring(part, begin + 1, F.length(part) - begin - len(close))
        whole = F.endswith(part, F.lit(close)) & (F.length(part) >= begin + len(close)) & ~body.rlike(CONTROL)
        return F.when(whole, unescape(body))

    head = F.regexp_extract(part, r"^\[ROLE ([^\[\]<]*)\] ", 0)
    named = F.struct(
        unescape(F.substring(head, F.lit(len(ROLE_OPEN) + 1), F.length(head) - len(ROLE_OPEN) - 2)).alias("role"),
        F.when(head != "", inner(F.length(head), ROLE_CLOSE)).alias("text"),
    )
    return (
        F.when(F.startswith(part, F.lit(USER_OPEN)), F.struct(F.lit("user").alias("role"), inner(F.lit(len(USER_OPEN)), USER_CLOSE).alias("text")))
        .when(F.startswith(part, F.lit(BOT_OPEN)), F.struct(F.lit("assistant").alias("role"), inner(F.lit(len(BOT_OPEN)), BOT_CLOSE).alias("text")))
        .otherwise(named)
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role,text>>."""
    return F.transform(F.filter(F.split(formatted, TURN_START), lambda p: p != ""), _parse_turn)


def _same(rendered: Column, role: Column, text: Column) -> Column:
    """Whether one rendered turn parses to exactly that turn."""
    turns = parse(rendered)
    first = F.get(turns, F.lit(0))
    return F.coalesce((F.size(turns) == 1) & (first["role"] == role) & (first["text"] == text), F.lit(False))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, ``loss_spans`` (array<struct<start,length>>, code points from 0,
    around each assistant text as it stands in ``formatted``), ``n_turns`` and ``n_escaped``."""
    source = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    r, t = F.col("role"), F.col("text")
    first = source.withColumn("_plain", F.concat(opening(r), t, closing(r))).withColumn("_ok", _same(F.col("_plain"), r, t))
    second = first.withColumn("_body", F.when(F.col("_ok"), t).otherwise(escape(t))).withColumn("_piece", F.concat(opening(r), F.col("_body"), closing(r)))
    checked = second.withColumn("_piece", F.when(F.col("_ok") | _same(F.col("_piece"), r, t), F.col("_piece")).otherwise(F.raise_error(F.lit("a turn does not survive its round trip"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = checked.withColumn("_start", F.coalesce(F.sum(F.length("_piece").cast("long")).over(order), F.lit(0)))
    one = F.struct(
        F.col("_start").alias("start"), "turn", "role", "text", F.col("_piece").alias("piece"),
        (F.col("_start") + F.length(opening(r))).alias("at"), F.length("_body").cast("long").alias("len"), "_ok",
    )
    # Order by the text's place. Rows that tie on it would need an empty piece, and no piece is empty.
    together = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    whole = together.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("_turns", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["at"].alias("start"), x["len"].alias("length"))).alias("loss_spans"),
        F.transform("_turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("_source"),
        F.size(F.filter("_turns", lambda x: ~x["_ok"])).cast("long").alias("n_escaped"),
    )
    return whole.select(
        "conv_id",
        F.when(parse(F.col("formatted")) == F.col("_source"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))).alias("formatted"),
        "loss_spans",
        F.size("_source").cast("long").alias("n_turns"),
        "n_escaped",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader recovers from formatted conversations alone: turns by parsing, loss text by its spans."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    back = formatted.select(
        "conv_id", parse(F.col("formatted")).alias("_turns"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"), "n_escaped",
    )
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_escaped",
    )
