import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    *(T.StructField(c, T.StringType()) for c in ("row", "doc_key", "node", "spans", "score", "block", "queue", "ids", "part", "n_words", "digest", "stays", "kept_text", "predicted")),
])


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), *(f"own {c}" for c in SCHEMA.names[5:]))


def hard_rows():
    """Nulls, empty and very long texts, repeated rows, equal ids, near copies, shared passages."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abdeghilmnorst") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(300).split(), prose(70)
    rows = [doc(1, prose(120)), doc(2, None), doc(3, ""), doc(4, " \t\n "), doc(5, "one two"), doc(None, prose(80) + " " + passage), doc(6, "ÉCOLE naïve über straße 日本語 words")]
    rows += [doc(10 + i, " ".join(base[:40 + i] + [word()] + base[41 + i:])) for i in range(6)]  # near copies
    rows += [doc(20, " ".join(base)), doc(20, " ".join(base)), doc(21, " ".join(base)), doc(22, " ".join(base).upper())]
    rows += [doc(30 + i, prose(30) + "\n" + passage + "\n" + prose(10), source="b") for i in range(5)]
    rows += [doc(40, "ab cd " * 400), doc(41, "ab cd " * 300), doc(42, "x " * 200), doc(43, "x " * 130)]  # runs
    rows += [doc(50, prose(30_000), source="long"), doc(51, "y" * 300_000, source=None), doc(30, "another text of the same id")]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    import re

    text = text or ""
    if lower:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text)
