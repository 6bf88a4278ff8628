"""Small fixtures with the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ("size", "bucket", "mix", "missing", "fp", "h", "score", "id", "word", "row", "label", "position", "target", "spans", "n_words", "payload", "digest", "salt", "__cut", "stratum", "gone_id", "a.b", "doc", "k1", "n", "text_hash", "passage", "tick`s")


def prose(rng: random.Random, n: int) -> str:
    words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'e', 'is', 'ung'])}" for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(20, 200)), rng.choice(["en", "de"]), f"s{i % 5}", None) for i in range(n)]
    return [(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows]


def messy() -> list[tuple]:
    base = documents(2, 12)
    return base + [
        (100, None, "en", "s0", 3), (101, "", None, None, 0), (102, " \n\t ", "fr", "", 4), (103, "word " * 60_000, "en", "s1", None), (104, base[0][1], "en", None, 5),
        (None, base[1][1], "en", "s2", 5), (None, None, None, None, None), base[3], base[3], (105, "ÀÉ über Straße \U0001f600 naïve\x0bx", "de", "s0", 9), (106, "one two", "en", "s0", 7), (-7, base[2][1], "en", "s9", 7),
    ]


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    return df


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
