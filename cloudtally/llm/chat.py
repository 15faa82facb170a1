"""Chat formatting: typed content parts flattened into one marked text, and the way back."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a message's ``parts`` column holds. Which measure counts depends on the type of the part.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHED = ("image", "audio", "document")


@dataclass(frozen=True)
class Template:
    """Control strings of a chat format, and what an attachment expands to.

    Every control string is broken wherever it occurs inside a role or a text,
    by putting ``escape`` behind its first character; ``escape`` itself is
    doubled. That can be undone by one left-to-right replacement.
    """

    begin: str = "<s>"
    open: str = "[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    escape: str = "\\"
    learn: tuple[str, ...] = ("assistant",)
    placeholders: dict[str, str] = field(
        default_factory=lambda: {"image": "<image>", "audio": "<audio>", "document": "<document>"}
    )
    patch: int = 14
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 256

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or self.escape in c:
                raise ValueError(f"a control string needs two characters and must not hold the escape: {c!r}")
            # A text's end and a marker's start must not make up a control string between them.
            for d in self.controls:
                if any(d.startswith(c[k:]) or c[k:].startswith(d) for k in range(1, len(c))):
                    raise ValueError(f"{d!r} begins as {c!r} goes on")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.open, self.middle, self.close, *self.placeholders.values())


def _java(text: str) -> str:
    """A regular expression for exactly this text."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def escaped(text: Column, t: Template) -> Column:
    """``text`` without control strings; null is the empty text."""
    starts = "|".join(f"{_java(c[0])}(?={_java(c[1:])})" for c in t.controls)
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit(t.escape), F.lit(t.escape * 2))
    return F.regexp_replace(doubled, f"({starts})", "$1" + _java(t.escape))


def unescaped(text: Column, t: Template) -> Column:
    e = _java(t.escape)
    return F.regexp_replace(text, f"{e}({e}?)", "$1")


def _visit(part: Column, learn: Column, t: Template) -> Column:
    """One part as (s, learn, kind, ref, tokens): its text, and what it attaches, if anything.

    A part of an unknown or missing type counts as text. A missing measure
    counts as zero; an attachment takes one token at least.
    """
    kind = F.when(part["type"].isin(*ATTACHED), part["type"])
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / t.patch)
    tokens = (
        F.when(kind == "image", side("width") * side("height"))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * t.audio_tokens_per_second))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(0)) * t.tokens_per_page)
    )
    spelled = escaped(part["text"], t)
    for name, mark in t.placeholders.items():
        spelled = F.when(kind == name, F.lit(mark)).otherwise(spelled)
    return F.struct(
        spelled.alias("s"),
        (learn & kind.isNull()).alias("learn"),
        kind.alias("kind"),
        part["ref"].alias("ref"),
        F.when(kind.isNotNull(), F.greatest(tokens, F.lit(1))).cast("long").alias("tokens"),
    )


def format_chats(messages: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: formatted text, loss spans and attachments, in turn order.

    ``parts`` is an array of ``PART``. Columns: conv_id, formatted, n_turns,
    loss (array of start and length in code points, for the texts of the roles
    to learn), attachments (array of position, kind, ref, tokens, in order) and
    attachment_tokens. A null role is an empty one, a null or empty part array
    an empty message. Rows of one turn number go by role and content; repeated
    rows stay. Null conversation ids make one conversation. An empty table
    gives no rows. A conversation becomes one value, so it must fit one row;
    rows are formatted before the shuffle.
    """
    t = template
    learn = F.coalesce(F.col(role).isin(*t.learn), F.lit(False))
    rows = messages.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        escaped(F.col(role), t).alias("role"),
        F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: _visit(p, learn, t)).alias("seen"),
    )
    segment = "struct<s:string,learn:boolean,kind:string,ref:string,tokens:bigint>"
    mark = lambda s: F.struct(
        s.alias("s"), F.lit(False).alias("learn"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"),
    ).cast(segment)
    message = F.concat(
        F.array(mark(F.concat(F.lit(t.open), F.col("role"), F.lit(t.middle)))),
        F.col("seen").cast(f"array<{segment}>"),
        F.array(mark(F.lit(t.close))),
    )
    turns = rows.select("conv_id", F.struct("turn", "role", message.alias("segments")).alias("m"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms")).select(
        "conv_id",
        F.size("ms").cast("long").alias("n_turns"),
        F.concat(F.array(mark(F.lit(t.begin))), F.flatten(F.transform("ms", lambda m: m["segments"]))).alias("segments"),
    )
    # One pass over the segments: where each starts, kept for learned texts and attachments only.
    places = F.aggregate(
        F.col("segments"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss")),
        lambda acc, s: F.struct(
            (acc["at"] + F.char_length(s["s"])).alias("at"),
            F.when(
                s["learn"],
                F.concat(acc["loss"], F.array(F.struct(acc["at"].alias("start"), F.char_length(s["s"]).cast("long").alias("length")))),
            ).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    attached = F.filter("segments", lambda s: s["kind"].isNotNull())
    return ordered.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["s"]), "").alias("formatted"),
        "n_turns",
        places.alias("loss"),
        F.transform(
            attached,
            lambda s, i: F.struct(i.alias("position"), s["kind"].alias("kind"), s["ref"].alias("ref"), s["tokens"].alias("tokens")),
        ).alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, s: n + s["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns in a formatted text: array of role and text, unescaped. Placeholders stay in the text."""
    t = template
    body = F.substring(formatted, F.lit(len(t.begin) + 1), F.char_length(formatted))
    pieces = F.filter(F.split(body, _java(t.close)), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring(F.substring_index(p, t.middle, 1), F.lit(len(t.open) + 1), F.char_length(p)), t).alias("role"),
            unescaped(F.substring(p, F.char_length(F.substring_index(p, t.middle, 1)) + len(t.middle) + 1, F.char_length(p)), t).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), template)), ""
    )


def text_parts(text: Column) -> Column:
    """A plain text message as its only part."""
    missing = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), missing("string").alias("ref"),
            missing("int").alias("width"), missing("int").alias("height"), missing("double").alias("seconds"), missing("int").alias("pages"),
        )
    )
