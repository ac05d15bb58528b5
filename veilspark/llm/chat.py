"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of turns with one role become one
block, whose texts are joined by a separator so that the original turns can be read back.  Every control
string begins with ``<|``.  In texts a ``<`` followed by any number of backslashes and ``|`` gets one more
backslash, which is undone by removing one; so no text can hold a control string, and nothing is lost.

Defined results: null text and null role are empty strings; a null ``conv_id`` is a conversation of its own;
turns are ordered by (turn, role, text), so ties and repeated rows have one order; an empty table gives no
conversations; other columns are ignored.  A conversation is one output row and therefore has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def _segments(turns: Column, trained: str) -> Column:
    """Pieces of the formatted text in order, each marked as inside or outside of the loss."""
    n = F.size(turns)
    piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
    role = lambda i: F.get(turns, i)["role"]
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i) != role(F.greatest(i - 1, F.lit(0)))))

    def block(i: Column, k: Column, starts: Column) -> Column:
        run = F.slice(turns, i + 1, F.coalesce(F.get(starts, k + 1), n) - i)
        head = piece(F.concat(F.lit(START), escape_role(role(i)), F.lit("\n")), F.lit(False))
        texts = F.transform(
            run,
            lambda t, j: F.array(
                piece(F.when(j > 0, F.lit(SEP)).otherwise(F.lit("")), F.lit(False)),
                piece(escape(t["text"]), t["role"] == trained),
            ),
        )
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(F.lit(END), F.lit(False))))

    # ``first`` is bound by an array of one, or each block would work it out anew.
    return F.get(F.transform(F.array(first), lambda starts: F.flatten(F.transform(starts, lambda i, k: block(i, k, starts)))), F.lit(0))


def format_conversations(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``segments`` (array of piece and loss; the pieces joined give ``formatted``)."""
    turns = rows.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", _segments(F.col("turns"), trained).alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments"
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    blocks = F.split(formatted, r"<\|im_start\|>")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(
            F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks) - 1), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what is read back from the output."""
    df = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("t"), loss_text(F.col("segments")).alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return df.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
