r"""Chat logs to training text, with DataFrame functions only.

A log is a table of events. ``message`` starts a message with a role and a first text, ``delta`` adds to
it, ``edit`` puts a text in the place of all that it had, ``regenerate`` does the same for a new answer
that goes on in deltas. Edits and regenerations rewind the conversation: messages after the one that
they change are gone unless they start again later. :func:`fold` sorts each message's events by sequence
and folds them into its last version, then lets the rewinds of a conversation work, :func:`render` writes
the messages that are left with a template, and :func:`parse` reads them back.

The template puts every message between an opening and a closing control string. In texts a control
string is broken up by a backslash after its first character, and one more where backslashes stand there
already, so that taking one away gives back the text; other backslashes stay as they are.

Events meet by message, so a long conversation's are spread over many tasks; only its final messages
come together, as they are one row of the result. Texts are never cut.

A message has the last role that any of its events names. Defined results: a null text is the empty one, a null role the empty one, whose messages are written like those of
any unknown role. Null ids are one conversation. Null sequences and message numbers come first. Events of equal
sequence are taken in the order of :data:`EVENTS`, then by text. A message that never starts is left out, and a
conversation without messages too; equal rows are events of their own. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events; all but deltas start a version, the last two rewind the conversation.
EVENTS = ("message", "edit", "regenerate", "delta")

# What stands before and after the text of each role, and between the name and text of other roles.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, NAMED = ("<<ROLE>>", "<</ROLE>>"), "<<TEXT>>"
#: Control strings without their first character, and what may stand before it in a text.
CONTROLS = r"(<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|<TEXT>>|INST\]|/INST\]|s>|/s>)"
BROKEN = r"([<\[])(\\*)" + CONTROLS
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """The text with no control string in it."""
    return F.regexp_replace(text, BROKEN, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + CONTROLS, "$1$2$3")


def fold(
    log: DataFrame,
    *,
    conversation: str = "conv_id",
    message: Sequence[str] = ("message",),
    seq: str = "seq",
    event: str = "event",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The conversations' final messages: ``conversation``, the ``message`` columns, which order them, role and text.

    ``seq`` may be of any type that sorts, and orders the events of a conversation.
    """
    names = [f"message_{k}" for k in range(len(message))]
    events = log.select(
        F.col(conversation).alias("conversation"),
        *[F.col(m).alias(n) for m, n in zip(message, names)],
        F.struct(F.col(seq).alias("seq")).alias("at"),  # a null sequence sorts, too
        F.array_position(F.array(*[F.lit(e) for e in EVENTS]), F.col(event)).alias("kind"),
        F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    own = Window.partitionBy("conversation", *names)
    starts, rewinds = F.col("kind").isin(1, 2, 3), F.col("kind").isin(2, 3)
    versions = (
        events.withColumn("start", F.max(F.when(starts, F.struct("at", "kind"))).over(own))
        .withColumn("rewind", F.max(F.when(rewinds, F.col("at"))).over(own))
        .withColumn("named", F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role"))).over(own))
        .where(F.struct("at", "kind") >= F.col("start"))
    )
    parts = F.array_sort(F.collect_list(F.struct("at", "kind", "text")))
    folded = versions.groupBy("conversation", *names).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.max("named")["role"].alias("role"),
        F.max("start")["at"].alias("start"),
        F.max("rewind").alias("rewind"),
    )
    before = Window.partitionBy("conversation").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    rewound = folded.withColumn("rewound", F.max("rewind").over(before))
    left = rewound.where(F.col("rewound").isNull() | (F.col("start") > F.col("rewound")))
    return left.select(
        F.col("conversation").alias(conversation),
        *[F.col(n).alias(m) for m, n in zip(message, names)],
        F.coalesce("role", F.lit("")).alias("role"),
        "text",
    )


def _opening(role: Column) -> Column:
    found = F.concat(F.lit(f"{OTHER[0]} "), escape(role), F.lit(f" {NAMED} "))
    for known, (mark, _) in MARKS.items():
        found = F.when(role == known, F.lit(f"{mark} ")).otherwise(found)
    return found


def _closing(role: Column) -> Column:
    found = F.lit(f" {OTHER[1]}")
    for known, (_, mark) in MARKS.items():
        found = F.when(role == known, F.lit(f" {mark}")).otherwise(found)
    return found


def render(messages: DataFrame, *, conversation: str = "conv_id", message: Sequence[str] = ("message",)) -> DataFrame:
    """One row per conversation: its ``formatted`` text and ``loss_spans``, where the assistant's texts stand in it.

    Places are code points, the end exclusive. A span holds an escaped text and nothing of its marks.
    """
    keys = [F.col(m).alias(f"key_{k}") for k, m in enumerate(message)]
    names = [f"key_{k}" for k in range(len(message))]
    rows = messages.select(
        F.col(conversation).alias("conversation"),
        *keys,
        F.col("role"),
        _opening(F.col("role")).alias("opening"),
        escape(F.col("text")).alias("body"),
        _closing(F.col("role")).alias("closing"),
    ).withColumn("piece", F.concat("opening", "body", "closing"))
    # Equal keys would share a place in the order; the piece tells them apart.
    order = Window.partitionBy("conversation").orderBy(*names, "piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(order), F.lit(0)).cast("long")
    placed = rows.withColumn("at", start).withColumn("from", start + F.length("opening"))
    entry = F.struct("at", "piece", "role", F.col("from").alias("start"), (F.col("from") + F.length("body")).alias("end"))
    listed = placed.groupBy("conversation").agg(F.array_sort(F.collect_list(entry)).alias("pieces"))
    spans = F.transform(
        F.filter("pieces", lambda p: p["role"] == LOSS_ROLE),
        lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")),
    )
    return listed.select(
        F.col("conversation").alias(conversation),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The messages of a formatted conversation: an array of ``role`` and ``text``."""
    every = [*MARKS.values(), OTHER]

    def either(marks: Sequence[str]) -> str:
        return "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in marks)

    pattern = rf"(?s)(?:{either([a for a, _ in every])}) .*? (?:{either([b for _, b in every])})"

    def read(piece: Column) -> Column:
        def inside(marks: tuple[str, str]) -> Column:
            around = sum(map(len, marks)) + 2
            return F.substr(piece, F.lit(len(marks[0]) + 2), F.length(piece) - around)

        body = inside(OTHER)
        name = F.substring_index(body, f" {NAMED} ", 1)
        text = F.substr(body, F.length(name) + len(NAMED) + 3, F.length(body))
        role, said = unescape(name), unescape(text)
        for known, marks in MARKS.items():
            mine = piece.startswith(f"{marks[0]} ")
            role, said = F.when(mine, F.lit(known)).otherwise(role), F.when(mine, unescape(inside(marks))).otherwise(said)
        return F.struct(role.alias("role"), said.alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), read)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    taken = F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(taken, "")


def log_of(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log that ends in the given turns: answers are drafted, regenerated and streamed in pieces, other turns edited.

    Columns ``conv_id``, the message's ``turn``, ``copy`` and ``reply``, ``seq``, ``event``, ``role`` and ``text``.
    An edit comes after a ``reply`` to the first version, which it rewinds. Rows of one turn number are
    turns of their own, by role and text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        body.alias("text"),
    ).withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    third, half = F.ceil(F.length("text") / 3).cast("int"), F.ceil(F.length("text") / 2).cast("int")
    nobody = F.lit(None).cast("string")

    def event(step: int, kind: str, said: Column, by: Column = nobody, reply: int = 0) -> Column:
        return F.struct(
            F.lit(step).alias("step"), F.lit(kind).alias("event"), by.alias("role"), said.alias("text"), F.lit(reply).alias("reply")
        )

    def piece(first: Column, size: Column) -> Column:
        return F.substr("text", first, size)

    first, draft, empty = piece(F.lit(1), third), piece(F.lit(1), half), F.lit("")
    rest = [event(4, "delta", piece(third + 1, third)), event(5, "delta", piece(2 * third + 1, third))]
    answer = [event(0, "message", empty, F.col("role")), event(1, "delta", draft), event(2, "regenerate", empty), event(3, "delta", first)]
    other = [event(0, "message", draft, F.col("role")), event(1, "message", draft, F.lit(LOSS_ROLE), reply=1), event(2, "edit", first)]
    events = F.when(F.col("role") == LOSS_ROLE, F.array(*answer, *rest)).otherwise(F.array(*other, *rest))
    return rows.select("conv_id", "turn", "copy", F.explode(events).alias("e")).select(
        "conv_id",
        "turn",
        "copy",
        F.col("e.reply").alias("reply"),
        F.struct("turn", "copy", F.col("e.step").alias("step")).alias("seq"),
        F.col("e.event").alias("event"),
        F.col("e.role").alias("role"),
        F.col("e.text").alias("text"),
    )
