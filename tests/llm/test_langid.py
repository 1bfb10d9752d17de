import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import langid
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, edge_rows

FOLD = langid._folding()


def folded(text):
    out = " " + "".join(chr(FOLD[ord(c)]) if ord(c) < 1 << 16 else " " for c in text) + " "
    while "  " in out:
        out = out.replace("  ", " ")
    return out


def kneser_ney(texts):
    """Plain interpolated Kneser-Ney of order 4 over characters: a function of (context, character)."""
    counts = {4: {}}
    for t in texts:
        s = "   " + folded(t)
        if len(s) > 5:
            for i in range(4, len(s)):
                g = s[i - 3 : i + 1]
                counts[4][g] = counts[4].get(g, 0) + 1
    for n in (3, 2, 1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def p(n, g):
        table = counts[n]
        ones, twos = (sum(v == k for v in table.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones else 0.5
        total = sum(v for k, v in table.items() if k[:-1] == g[:-1])
        types = sum(k[:-1] == g[:-1] for k in table)
        if not total:
            return p(n - 1, g[1:])
        weight = max(d * types / total, 1e-6)
        low = p(n - 1, g[1:]) if n > 1 else 1 / (16 * len(table))
        return max(table.get(g, 0) - d, 0) / total + weight * low

    return p


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [("en", "the cat and the dog; The hat!"), ("en", "that is the end"), ("fr", "le chat et la élève de la ville"), ("fr", "une été à la mer"), (None, "x"), ("en", None)],
        "lang string, text string",
    )


def test_probabilities_equal_plain_kneser_ney(small):
    model = langid.train(small)
    rows = small.filter("lang is not null and text is not null").collect()
    for column, lang in enumerate(model.langs):
        p = kneser_ney([r["text"] for r in rows if r["lang"] == lang])
        for text in ("the hat and la mer", "été"):
            keys, _ = langid.ngrams(*langid.letters([text], FOLD))
            got = langid.log_probabilities(model, keys)[:, column]
            s = "   " + folded(text)
            for g, x in zip((s[i - 3 : i + 1] for i in range(4, len(s))), got):
                if all(any(k.endswith(g[-1]) for k in folded(r["text"])) or r["lang"] != lang for r in rows):
                    assert math.isclose(x, math.log(p(4, g)), rel_tol=1e-3), (lang, g)


def test_edges_and_rejection(edge, small):
    model = langid.train(small)
    rows = {(str(r["doc_id"]), r["lang_pred"], r["rejected"]) for r in langid.identify(edge, model).collect()}
    assert len(langid.identify(edge, model).collect()) == len(edge_rows())
    for key in ("2", "3", "4", "14"):
        assert (key, "und", True) in rows
    assert all(0 <= r["score"] <= 1 for r in langid.identify(edge, model).collect())
    got = langid.identify(small.withColumn("doc_id", F.lit(1)), model).filter("lang_pred = 'en'").collect()
    assert len(got) >= 2 and not any(r["rejected"] for r in got)


def test_nothing_learned_and_empty_table(edge, empty, small):
    model = langid.train(small.limit(0))
    assert {r["lang_pred"] for r in langid.identify(edge, model).collect()} == {"und"}
    assert langid.identify(empty, model).collect() == []


def test_calibration_takes_every_training_text(spark):
    """Limits are quantiles of all texts of a language, and texts without letters teach nothing."""
    words = ["lamp", "river", "stone", "cloud", "seven", "bread", "winter", "paper", "garden", "music"]
    cell = lambda i: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10)) + 1).cast("int"))
    docs = spark.range(9000).withColumn("lang", F.when(F.col("id") < 60, "xx").otherwise("yy"))
    docs = docs.withColumn("text", F.concat_ws(" ", cell(0), cell(1), F.when(F.col("lang") == "xx", F.concat(F.lit("zq"), "id")))).drop("id")
    docs = docs.unionByName(spark.createDataFrame([("zz", "123 456")], "lang string, text string"))
    model = langid.train(docs)
    assert model.langs == ["xx", "yy"] and model.temperature in langid.TEMPERATURES
    for i, lang in enumerate(model.langs):
        entropy, counts = langid.cross_entropies(model, [r["text"] for r in docs.filter(F.col("lang") == lang).collect()], FOLD)
        assert model.limits[i] == pytest.approx(np.quantile(entropy[counts > 0, i], langid.ACCEPTED) * 1.05, rel=1e-12)


def test_letters_folds_everything_else():
    codes, bounds = langid.letters(["A1b  c", None, "", "é😀x"], FOLD)
    texts = ["".join(map(chr, codes[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
    assert texts == [" a b c ", " ", " ", " é x "]
    assert np.diff(bounds).tolist() == [7, 1, 1, 5]


def test_query_is_accurate_on_held_out_rows(spark):
    docs = {d["doc_id"]: d["lang"] for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_language_id"](spark, SF).filter("held_out").collect()
    assert sum(docs[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 10
