"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, merged where adjacent turns have
the same role, and joined to one string. Control strings inside roles and texts are escaped so
that `parse` finds the turns again, one per input row, and the loss mask covers each assistant
text by itself.

Null conversation ids form one conversation; a null role or text counts as empty; rows of one
conversation with equal turns are ordered by role and text, null turns first. An empty table
gives no rows. Columns besides the four named ones are ignored. One conversation becomes one
string, so its turns meet in one task whatever the method: a conversation is bounded by the size
of a string.
"""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a formatted conversation: open role says text (also text)* end."""

    open: str = "<|turn|>"
    says: str = "<|says|>"
    also: str = "<|also|>"
    end: str = "<|end|>"
    learned: str = "assistant"
    #: Control strings of common chat models that must not come out of a text as they are.
    reserved: tuple = field(
        default=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "<unk>")
    )
    #: Starts every escape; what follows it tells the escaped character.
    escape: str = "\\"


def _controls(template):
    own = (template.open, template.says, template.also, template.end)
    return list(dict.fromkeys((*template.reserved, *own)))


def _codes(template):
    """First characters of control strings and the escapes that stand for them."""
    firsts = dict.fromkeys(c[0] for c in _controls(template))
    return {ch: f"{template.escape}{i}" for i, ch in enumerate(firsts, 1)}


def _replace(text, old, new):
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text, template=Template()):
    """Escape characters first, then the first character of each control string."""
    codes = _codes(template)
    text = _replace(text, template.escape, template.escape + "0")
    return reduce(lambda t, c: _replace(t, c, codes[c[0]] + c[1:]), _controls(template), text)


def unescape(text, template=Template()):
    """Undo `escape`: the escape character itself comes last, when no other escape is left."""
    for ch, code in _codes(template).items():
        text = _replace(text, code, ch)
    return _replace(text, template.escape + "0", template.escape)


def merge(turns):
    """Adjacent turns of one role as one (role, texts): where blocks start, then slices of texts.

    Linear in the turns: no array is copied from turn to turn.
    """
    # get() is null before the first turn, which starts a block
    starts = F.filter(
        F.transform(
            turns,
            lambda t, i: F.when(
                (i > 0) & (F.get(turns, i - 1)["role"] == t["role"]), F.lit(None)
            ).otherwise(i + 1)),
        lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))),
                    F.array(F.size(turns) + 1))
    return F.transform(
        F.arrays_zip(starts.alias("at"), ends.alias("end")),
        lambda b: F.struct(
            F.get(turns, b["at"] - 1)["role"].alias("role"),
            F.slice(turns, b["at"], b["end"] - b["at"])["text"].alias("texts")))


def format_chats(df, template=Template()):
    """One row per conversation: conv_id, formatted."""
    text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = df.select(
        F.col("`conv_id`").alias("conv_id"),
        F.struct(
            F.col("`turn`").alias("turn"),
            escape(text("role"), template).alias("role"),
            escape(text("text"), template).alias("text"),
        ).alias("turn"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def block(b):
        return F.concat(
            F.lit(template.open), b["role"], F.lit(template.says),
            F.array_join(b["texts"], template.also), F.lit(template.end),
        )

    return chats.select(
        "conv_id", F.array_join(F.transform(merge(F.col("turns")), block), "").alias("formatted")
    )


def parse(formatted, template=Template()):
    """The turns of a formatted string: array of (role, text, start, length), still escaped.

    start and length are code points within the formatted string; together the assistant's are
    the loss mask.
    """
    blocks = F.filter(F.split(formatted, "\\Q" + template.open + "\\E"), lambda b: b != "")

    def texts(block):
        body = F.substring_index(block, template.says, -1)
        return F.split(_replace(body, template.end, ""), "\\Q" + template.also + "\\E")

    parts = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                texts(b),
                lambda t, i: F.struct(
                    F.substring_index(b, template.says, 1).alias("role"),
                    t.alias("text"),
                    # what stands before this text since the end of the one before
                    F.when(
                        i == 0,
                        F.length(F.substring_index(b, template.says, 1))
                        + len(template.open) + len(template.says),
                    ).otherwise(len(template.also)).alias("gap"),
                    (i == F.size(texts(b)) - 1).alias("last"),
                ),
            ),
        )
    )
    zero = F.struct(
        F.expr("cast(array() as array<struct<role:string,text:string,start:int,length:int>>)")
        .alias("out"),
        F.lit(0).alias("at"),
    )

    def step(acc, p):
        start = acc["at"] + p["gap"]
        size = F.length(p["text"])
        row = F.struct(
            p["role"].alias("role"), p["text"].alias("text"),
            start.alias("start"), size.alias("length"),
        )
        after = start + size + F.when(p["last"], len(template.end)).otherwise(0)
        return F.struct(F.array_append(acc["out"], row).alias("out"), after.alias("at"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def digests(chats, template=Template()):
    """Read the formatted strings back: counts and digests of the turns and of the masked text."""
    turns = chats.select("conv_id", "formatted", parse(F.col("formatted"), template).alias("turns"))
    masked = F.transform(
        F.filter("turns", lambda t: t["role"] == escape(F.lit(template.learned), template)),
        # taken from the formatted string by the mask, not from the parsed text
        lambda t: unescape(F.substring(F.col("formatted"), t["start"] + 1, t["length"]), template),
    )
    told = F.transform(
        "turns",
        lambda t: F.concat(
            unescape(t["role"], template), F.lit("\n"), unescape(t["text"], template), F.lit("\n")
        ),
    )
    turns = turns.withColumn("loss", F.array_join(masked, ""))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
