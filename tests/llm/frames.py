"""Small frames with the odd rows that every operator must take."""

import random
import sys

WORDS = "the of and stone river winter market silver garden window morning letter travel answer bridge forest".split()


def prose(seed: int, n: int) -> str:
    some = random.Random(seed)
    words = ["".join(some.choices("abcdefghijklmnopqrst", k=some.randint(3, 9))) if some.random() < 0.6 else some.choice(WORDS) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 11 == 10 else w for i, w in enumerate(words))


def edited(text: str, seed: int, share: float) -> str:
    some = random.Random(seed)
    return " ".join("changed" + str(some.randint(0, 99)) if some.random() < share else w for w in text.split(" "))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string, row string, value int, size int"


def documents(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text[, source]); the further columns have names that operators use for their own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "k", "h", "r", 1, 2) for r in rows]
    return spark.createDataFrame(full, schema)


def odd_rows():
    """Null id, null and empty texts, white space only, one word, ties and repeated rows, a very long text."""
    long = prose(7, 40_000)
    return [
        (None, prose(1, 30)),
        (None, None),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "word"),
        (5, prose(2, 120)),
        (5, prose(2, 120)),
        (5, prose(3, 50)),
        (6, prose(2, 120)),
        (7, long),
        (8, "Été übermäßig. ÀÉ Ω中  x y\x1c z \x0b\x0c\r\n end"),
    ]


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)


sys.setrecursionlimit(10_000)


def shuffled_records(frame):
    """How many rows each exchange of the frame wrote; runs the frame."""
    plan, found = frame._jdf.queryExecution().executedPlan(), []
    frame._jdf.queryExecution().toRdd().count()  # this very plan, so that its metrics are filled

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(node.plan())
        elif kind == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found
