import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.llm import common

SF = "/root/testdata/sf0.001"
SYLLABLES = "ta ko mi ren su lo pa ne du vi ge sha".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Null and empty texts, a null id, a very long text, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(11)
    base, passage = sentence(rng, 90), sentence(rng, 30)
    words = base.split()
    rows = [
        (1, base), (2, None), (3, ""), (4, " \t\n "), (None, base), (5, base), (6, base), (6, base), (7, " ".join(words[:40] + ["zzz"] + words[41:])),
        (8, sentence(rng, 40000)), (9, passage + "\n" + sentence(rng, 50)), (10, sentence(rng, 20) + "\n" + passage + "\n\n" + sentence(rng, 5)),
        (11, "Ünïcode ÉCOLE straße 你好 мир 123 — ok 😀"), (12, "one"), (13, "One"), (14, "!!! ... ###"), (None, None), (15, "a b c d e f g h i j k l m"),
        (16, "x A B C D E F G H I J K L M y"), (17, "a b c d e f g h i j k l m"), (18, "tab\tone\x0btwo\x0cthree\rfour five six seven eight nine ten eleven twelve thirteen"),
    ]
    return rows + [(100 + i, sentence(rng, rng.randint(1, 60))) for i in range(40)]


@pytest.fixture(autouse=True)
def few_pieces(monkeypatch):
    """Small tables in a few pieces: the same code, less to start."""
    monkeypatch.setattr(common, "LEAST_PIECES", 5)


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows as documents with further columns whose names clash with helpers."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    rows = spark.createDataFrame(edge_rows(), schema).repartition(3)
    return rows.withColumns({c: F.lit("clash") for c in ("id", "row", "key", "item", "n", "block", "chunk", "bytes", "part", "drops", "doc", "a.b")})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
