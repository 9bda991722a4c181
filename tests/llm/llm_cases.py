"""Rows that every operator on documents must handle."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("node", T.StringType()), T.StructField("kinds", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("secrets", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("part", T.StringType()), T.StructField("h", T.StringType()), T.StructField("score", T.StringType()), T.StructField("k", T.StringType()), T.StructField("site", T.StringType()),
])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 120)) for _ in range(30)]
    near = [b + " " + words(rng, 1) for b in base[:10]]
    mixed = ["", None, " ", "\n\n", "a", "ab cd", "AB  cd", "Ünïcödé  text\twith\r\nlines \U0001f600", "12345 !!!", "x" * 3000 + " y", words(rng, 4000), "it's <|endoftext|> don't", "\x1c \x1f  b"]
    return base + near + mixed + [base[0]] * 15 + ["same line\n" + b for b in base[:12]]


def rows(seed=1):
    out = []
    for i, t in enumerate(texts(seed)):
        out.append((i, t, ["en", "de", None][i % 3], f"site{i % 14}" if i % 9 else None, None if t is None else len(t), *["clash"] * 3, 7, *["clash"] * 7))
    first = out[3]
    return out + [first, (3, "another text under a used id", *first[2:]), (None, "no id here at all", *first[2:]), (None, None, *[None] * (len(first) - 2))]


def frame(spark, data=None, parts=3):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
