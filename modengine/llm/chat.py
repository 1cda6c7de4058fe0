r"""Chat formatting with a grammar round trip; DataFrame functions only.

A turn is rendered as ``<|turn:L|>role\ntext<|end|>\n`` where L is its escape level: 0 as it is, 1 with the first
character of each control string written as %XX (and % itself), 2 with every < and [ written so. The grammar of role and
text admits no control string, and the parser undoes the escapes of the level. Each turn is rendered at the lowest level
whose reparsed role and text equal the source, so conflicting content is escaped until the round trip is identical.

Scale: turns are rendered and checked row by row; one exchange brings a conversation's blocks together, which the output
(one text a conversation) needs in any case. Splitting, parsing and hashing are linear in a conversation's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings with a meaning to this or to common chat templates; none may stand unescaped in a text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEVELS = (0, 1, 2)
END = "<|end|>\n"
_HEAD = len("<|turn:0|>")
_CODE = {"<": "%3C", "[": "%5B", "\n": "%0A"}


def _escape(text: Column, level: int, role: bool) -> Column:
    if level == 0:
        return text
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for control in CONTROL if level == 1 else ("<", "["):
        out = F.replace(out, F.lit(control), F.lit(_CODE[control[0]] + control[1:]))
    return F.replace(out, F.lit("\n"), F.lit("%0A")) if role else out


def _unescape(text: Column, level: Column) -> Column:
    plain = text
    for char, code in _CODE.items():
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return F.when(level == "0", text).otherwise(F.replace(plain, F.lit("%25"), F.lit("%")))


def _render(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(f"<|turn:{level}|>"), _escape(role, level, True), F.lit("\n"), _escape(text, level, False), F.lit(END))


def _blocks(formatted: Column) -> Column:
    """The turns of a formatted text, without their ends."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    return F.slice(pieces, 1, F.size(pieces) - 1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parse(block: Column) -> Column:
    """struct(role, text, raw text, level) of a block; null where the grammar does not admit it."""

    def of(rest: Column, level: Column) -> Column:
        valid = F.substring(block, 1, _HEAD).rlike(r"^<\|turn:[012]\|>$") & F.contains(rest, F.lit("\n"))
        for control in CONTROL:
            valid = valid & ~F.contains(rest, F.lit(control))
        parts = lambda role: _let(F.substr(rest, F.length(role) + 2), lambda raw: F.struct(_unescape(role, level).alias("role"), _unescape(raw, level).alias("text"), raw.alias("raw"), level.alias("level")))
        return F.when(valid, _let(F.substring_index(rest, "\n", 1), parts))

    return _let(F.substr(block, F.lit(_HEAD + 1)), lambda rest: _let(F.substring(block, 8, 1), lambda level: of(rest, level)))


def render_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, block): each turn at the lowest level that survives the round trip."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rendered = F.array(*[_render(F.col("role"), F.col("text"), level) for level in LEVELS])

    def survives(made: Column) -> Column:
        same = lambda parsed: F.coalesce((parsed["role"] == F.col("role")) & (parsed["text"] == F.col("text")), F.lit(False))
        return _let(_blocks(made), lambda back: (F.size(back) == 1) & _let(_parse(F.get(back, F.lit(0))), same))

    block = F.get(F.filter(rendered, survives), F.lit(0))
    return rows.withColumn("block", block)


def format_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, formatted, segments): the text of each conversation and its runs of (text, loss, level).

    Rows go by turn, then role, then text (so equal rows have no order to choose); null roles and texts are empty, rows
    with a null conv_id are one conversation. Segments concatenate to ``formatted``; loss marks the texts of assistants.
    """
    rendered = render_turns(turns, **columns)
    blocks = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "block"))).alias("b"))
    formatted = blocks.select("conv_id", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("formatted"))

    def pieces(block: Column) -> Column:
        part = lambda text, loss, level: F.struct(text.alias("text"), loss.alias("loss"), level.alias("level"))
        bare = F.lit(None).cast("string")
        head = lambda raw: F.substr(block, F.lit(1), F.length(block) - F.length(raw))
        return _let(_parse(block), lambda p: F.array(part(head(p["raw"]), F.lit(False), bare), part(p["raw"], p["role"] == "assistant", p["level"]), part(F.lit(END), F.lit(False), bare)))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(_blocks(F.col("formatted")), pieces)).alias("segments"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments, turns): the turns that the parser recovers."""
    turns = F.transform(_blocks(F.col("formatted")), _parse)
    return formatted.select("conv_id", "formatted", "segments", turns.alias("turns"))


def chat_digest(turns: DataFrame, **columns: str) -> DataFrame:
    """Counts and digests of each conversation, all read back from the formatted text and its segments."""
    parsed = parse_conversations(format_conversations(turns, **columns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: _unescape(s["text"], s["level"])), "")
    rows = parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
