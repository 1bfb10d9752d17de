import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from formline.llm import toxicity as tx
from formline.llm.queries import QUERIES
from tests.llm.conftest import edge_rows, sentence

LARGER = "/root/testdata/sf0.1"


def plain_ftrl(x, y, size, epochs):
    """The published update, one coordinate at a time."""
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        penalty = 0.0 if i == size - 1 else tx.L1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - np.sign(z[i]) * penalty) / ((tx.BETA + n[i] ** 0.5) / tx.ALPHA + tx.L2)

    for _ in range(epochs):
        for own, truth in zip(x, y):
            w = {i: weight(i) for i in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - truth
            for i in own:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / tx.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size)]


def test_ftrl_is_the_published_update():
    rng = np.random.default_rng(4)
    x = [np.append(np.unique(rng.integers(0, 30, 6)), 30) for _ in range(300)]
    y = np.array([float(3 in own) if rng.random() < 0.95 else 1.0 for own in x])
    got = tx.ftrl(x, y, 31, 2)
    assert np.allclose(got, plain_ftrl([own.tolist() for own in x], y, 31, 2))
    assert got[3] > 0 and (got[:-1] == 0).sum() > 10


def test_features_by_hand():
    """Equal n-grams, skip-grams and stems have equal features, whatever stands around them."""
    def of(text):
        return {int(f) for _, _, _, found in tx._each(pa.array([text])) for f in found}

    one, two, three = of("Ab cd"), of("ab cd ef"), of("cd ef")
    assert of("AB  cd") == one and len(one) == 3 and one < two and three < two
    assert len(two) == 3 + 2 + 1 + 1  # words, pairs, the run of three, the pair around cd
    assert len(of("abcdefgh")) == 1 + 3 and of("abcdefgh") & of("abcdxyz") and not of("abc") & of("abcdxyz")
    assert of("") == set()


def test_features_do_not_depend_on_neighbours():
    texts = [t for _, t in edge_rows()]
    together = {i: set() for i in range(len(texts))}
    for lo, _, rows, found in tx._each(pa.array(texts, pa.string())):
        for r, f in zip(rows.tolist(), found.tolist()):
            together[lo + r].add(f)
    for i, text in enumerate(texts):
        alone = {int(f) for _, _, _, found in tx._each(pa.array([text], pa.string())) for f in found}
        assert alone == together[i]


def toxic_rows(n):
    rng = random.Random(3)
    return [(i, sentence(rng, 20) + (" vileword " if i % 3 == 0 else " ") + sentence(rng, 5), int(i % 3 == 0)) for i in range(n)]


def test_scores_do_not_depend_on_partitions_and_many_shards_agree(spark, monkeypatch):
    rows = spark.createDataFrame(toxic_rows(400), "id long, text string, label int")
    one = tx.fit(tx.features(rows.repartition(1)))
    many = tx.fit(tx.features(rows.repartition(7)))
    assert np.array_equal(one.features, many.features) and np.allclose(one.weights, many.weights) and np.isclose(one.intercept, many.intercept)
    monkeypatch.setattr(tx, "SHARD_ROWS", 100)
    dealt = tx.fit(tx.features(rows))
    truth = np.array([y for _, _, y in toxic_rows(400)])
    texts = pa.array([t for _, t, _ in toxic_rows(400)])
    for model in (one, dealt):
        assert ((model.score(texts) >= 0.5) == truth).mean() > 0.97
        assert len(model.features) < 200


def test_sample_is_bounded_and_the_same(spark):
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(100)] + [(7, "again"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i % 10 else None) for i in range(100)] + [(None, 1)], "doc_id long, toxic int").withColumn("label", F.lit("clash"))
    ids = lambda d: sorted(r["id"] for r in d.collect())
    got = ids(tx.labelled(docs, labels, "toxic", 30))
    assert got == ids(tx.labelled(docs.repartition(5), labels.repartition(3), "toxic", 30)) and len(set(got)) == 30
    assert not any(i % 10 == 0 for i in got)


def test_edges(edge, empty):
    labels = edge.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    model = tx.fit(tx.features(tx.labelled(edge, labels, "y")))
    scores = [r["score"] for r in tx.score(edge, model).collect()]
    assert len(scores) == len(edge_rows()) and all(0 <= s <= 1 for s in scores)
    nothing = tx.fit(tx.features(tx.labelled(empty, labels, "y")))
    assert all(r["score"] == 0.5 for r in tx.score(edge, nothing).collect()) and tx.score(empty, model).collect() == []


def test_query_is_accurate_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [(r["predicted"], labels[r["doc_id"]]) for r in QUERIES["op12_toxicity"](spark, LARGER).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in rows) >= 0.97 * len(rows) > 500
    assert sum(a and b for a, b in rows) >= 0.85 * sum(b for _, b in rows)
    assert sum(a and not b for a, b in rows) <= 0.01 * len(rows)
