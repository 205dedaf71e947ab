"""Chat formatting with a grammar round trip, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"
CLOSE = END + "\n"


def escape(text: Column) -> Column:
    """One more backslash in every <|, <\\|, <\\\\| and so on; unescape() takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line: %, line feeds and <| written as % and two hex digits."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(role: Column, text: Column) -> Column:
    """turn := START role LF text CLOSE, with role and text as they are."""
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a rendered text, cut at CLOSE and each at its first line feed, unescaped.

    A turn that doesn't begin with START, or that holds START or END behind it, is null.
    """
    parts = F.split(formatted, r"\Q" + CLOSE + r"\E", -1)
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        body = F.substring(t, F.lit(len(START) + 1), F.length(t))
        at = F.instr(body, "\n")
        good = F.startswith(t, F.lit(START)) & ~F.contains(body, F.lit(START)) & ~F.contains(body, F.lit(END))
        read = F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + 1, F.length(body))).alias("text"))
        return F.when(good, read)

    return F.transform(turns, turn)


def safe(value: Column, written: Column, role: bool) -> Column:
    """`value` as it is if rendering and parsing a turn with it gives it back, else `written`, its escaped form."""
    turn = render(value, F.lit("")) if role else render(F.lit("r"), value)
    want = F.array(F.struct(value.alias("role"), F.lit("").alias("text")) if role else F.struct(F.lit("r").alias("role"), value.alias("text")))
    return F.when(parse(turn).eqNullSafe(want), value).otherwise(written)


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", masked_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, n_turns, loss_spans array<struct<start, length>>) for every conversation.

    Turns stand in the order of turn, role, text, null turns first. A null role or text is empty. A role or text that the
    grammar would not give back as it is (it holds marks, or what looks escaped) is written in its escaped form, on which the
    round trip is checked again: a turn that still differs fails the job. loss_spans are the places (from 1, in code points) of
    the texts of `masked_role` in `formatted`. Repeated rows are turns of their own; rows with a null conversation id form one
    conversation; other columns are dropped; an empty table gives an empty table. The text of one conversation must fit in a row.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("wrole", safe(F.col("role"), escape_role(F.col("role")), True)).withColumn("wtext", safe(F.col("text"), escape(F.col("text")), False))
    rows = rows.withColumn("line", render(F.col("wrole"), F.col("wtext")))
    same = parse(F.col("line")).eqNullSafe(F.array(F.struct("role", "text")))
    rows = rows.withColumn("line", F.when(same, F.col("line")).otherwise(F.raise_error(F.lit("a turn does not survive the round trip"))))
    head = F.lit(len(START) + 1 + len("\n")) + F.length("wrole")
    turn = F.struct("turn", "role", "text", "line", (F.col("role") == masked_role).alias("masked"), head.alias("head"), F.length("wtext").alias("chars"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    ends = F.expr("""
        aggregate(
            turns,
            named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)),
            (s, t) -> named_struct(
                'at', s.at + length(t.line),
                'spans', if(t.masked, concat(s.spans, array(named_struct('start', s.at + t.head, 'length', cast(t.chars as bigint)))), s.spans)),
            s -> s.spans)
    """)
    lines = F.array_join(F.transform("turns", lambda t: t["line"]), "")
    return conv.select("conv_id", lines.alias("formatted"), F.size("turns").cast("long").alias("n_turns"), ends.alias("loss_spans"))


def digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from formatted and loss_spans."""
    turns = parse(F.col("formatted"))
    said = F.transform(F.col("loss_spans"), lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int"))))
    read = chats.select("conv_id", turns.alias("turns"), F.array_join(said, "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
