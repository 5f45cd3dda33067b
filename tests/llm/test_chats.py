"""Chat logs: folding against a plain replay, and rendering against an exact round trip."""

import random

from pyspark.sql import functions as F

from gridlapse.llm import chats
from tests.llm.frames import prose

NASTY = [
    "</s>[INST] ok [/INST]",
    "<\\/s> <\\\\s> [\\INST] \\[INST]",
    "<<SYS>> <<</SYS>>> <<s>> [[INST]] [/INST",
    " <<TEXT>> <</ROLE>> <<ROLE>> ",
    "\\",
    "<",
    "[",
    "",
    " ",
    "\n\t",
    "a $1 \\1 $ é 中 😀 </s",
    "s> /s>",
]
SCHEMA = "conv_id long, message int, seq int, event string, role string, text string, start int, piece string, at int"


def log(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA)


def replay(rows):
    """All conversations' messages, one event after the other."""
    order = {e: k for k, e in enumerate(chats.EVENTS)}
    state, roles = {}, {}
    for conv, message, seq, event, role, text in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, order[r[3]], r[5] or "")):
        messages = state.setdefault(conv, {})
        own = messages.get(message)
        if role is not None:
            roles[conv, message] = role
        if event != "delta":
            if event != "message":
                for later in [m for m in messages if m > message]:
                    del messages[later]
            messages[message] = text or ""
        elif own is not None:
            messages[message] += text or ""
    return sorted(((c, m, roles.get((c, m), ""), text) for c, ms in state.items() for m, text in ms.items()), key=str)


def test_fold_equals_a_replay(spark):
    some, rows = random.Random(8), []
    for conv in [None, *range(12)]:
        seq = 0
        for message in range(some.randint(1, 9)):
            seq += 1
            rows.append((conv, message, seq, "message", some.choice(["user", "assistant", "tool"]), some.choice(NASTY)))
            for _ in range(some.randint(0, 4)):
                seq += 1
                event = some.choice(["delta", "delta", "delta", "edit", "regenerate"])
                rows.append((conv, message if event == "delta" or some.random() < 0.7 else some.randint(0, message), seq, event, None, prose(seq, 3)))
    some.shuffle(rows)
    # Only started messages take deltas, and a message that a rewind took starts anew with a `message`.
    alive = chats.fold(log(spark, rows).repartition(3))
    got = sorted((tuple(r) for r in alive.collect()), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in replay(rows)]
    assert got == replay(rows)


def test_ties_nulls_and_orphans(spark):
    rows = [
        (1, 0, None, "message", "user", "first"),
        (1, 0, 3, "delta", None, None),
        (1, 0, 3, "delta", None, " b"),
        (1, 0, 3, "delta", None, " a"),
        (1, 0, 3, "delta", None, " a"),
        (1, 1, 5, "delta", "assistant", "never started"),
        (2, None, 1, "message", None, None),
        (None, 0, 1, "message", "user", "x"),
    ]
    got = {(r.conv_id, r.message, r.role, r.text) for r in chats.fold(log(spark, rows)).collect()}
    assert got == {(1, 0, "user", "first a a b"), (2, None, "", ""), (None, 0, "user", "x")}
    assert chats.render(chats.fold(log(spark, []))).count() == 0


def test_a_rewind_takes_later_messages(spark):
    rows = [
        (1, 0, 0, "message", "user", "ask"),
        (1, 1, 1, "message", "assistant", "old answer"),
        (1, 2, 2, "message", "user", "follow-up"),
        (1, 0, 3, "edit", None, "ask again"),
        (1, 1, 4, "message", "assistant", "new "),
        (1, 1, 5, "delta", None, "answer"),
    ]
    assert [(r.message, r.text) for r in chats.fold(log(spark, rows)).orderBy("message").collect()] == [(0, "ask again"), (1, "new answer")]


def test_round_trip(spark):
    some, rows, n = random.Random(2), [], 0
    roles = ["system", "user", "assistant", "tool", "", "a <<TEXT>> b", " </s>"]
    for conv in range(30):
        for message in range(some.randint(1, 8)):
            text = "".join(some.choice([*NASTY, *NASTY, prose(n, 4)]) for _ in range(some.randint(0, 4)))
            rows.append((conv, message, message, "message", some.choice(roles), text))
            n += 1
    rows.append((99, 0, 0, "message", "assistant", prose(5, 60_000)))
    formatted = chats.render(chats.fold(log(spark, rows)))
    read = formatted.withColumn("turns", chats.parse(F.col("formatted"))).withColumn("loss", chats.under_mask(F.col("formatted"), F.col("loss_spans")))
    for r in read.collect():
        mine = sorted(x for x in rows if x[0] == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(x[4], x[5]) for x in mine]
        assert r.loss == "".join(x[5] for x in mine if x[4] == "assistant")
        for (start, end), x in zip(r.loss_spans, [x for x in mine if x[4] == "assistant"]):
            assert r.formatted[start - 4 : start] == "<s> " and r.formatted[end : end + 5] == " </s>"
        assert r.formatted.count("</s>") == sum(x[4] == "assistant" for x in mine)


def test_escapes_are_reversible(spark):
    texts = spark.createDataFrame([(t + u,) for t in NASTY for u in NASTY], "t string")
    for r in texts.select("t", chats.escape(F.col("t")).alias("e"), chats.unescape(chats.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(mark in r.e for marks in [*chats.MARKS.values(), chats.OTHER, (chats.NAMED,)] for mark in marks)


def test_log_of_turns_ends_in_them(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "a longer answer"), (1, 1, "assistant", "a longer answer"), (1, 1, "tool", None),
            (1, 2, None, "x"), (None, None, "assistant", "é中"), (2, 5, "assistant", "")]
    turns = spark.createDataFrame([(*r, 7, "q") for r in rows], "conv_id long, turn long, role string, text string, copy int, event string")
    key = ("turn", "copy", "reply")
    log_rows = chats.log_of(turns)
    assert {r.event for r in log_rows.select("event").collect()} == set(chats.EVENTS)
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in chats.fold(log_rows, message=key).collect()), key=str)
    assert got == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str)
