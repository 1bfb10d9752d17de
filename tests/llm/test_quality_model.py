import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from formline.llm import quality_model as qm
from formline.llm.queries import QUERIES
from tests.llm.conftest import edge_rows

LARGER = "/root/testdata/sf0.01"


def test_score_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    d = len(qm.FEATURES)
    x = [rng.normal(k, 1 + k, (200, d)) for k in range(2)]
    model = qm.from_sums(np.array([200.0, 200.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]))
    every = np.concatenate(x)
    density = []
    for k in range(2):
        cov = model.factors[k] @ model.factors[k].T
        z = every - model.means[k]
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]))
    lean = (density[1] - density[0]) / qm.TEMPER
    assert np.allclose(model.score(every), 1 / (1 + np.exp(-np.clip(lean, -60, 60))))
    assert ((model.score(every) > 0.5) == (np.arange(400) >= 200)).mean() > 0.95


def test_statistics_by_hand():
    names = dict(zip(qm.FEATURES, qm.statistics(pa.array(["Ab ab, ab\n\nab 1 $x\nx"]))[0]))
    words = ["Ab", "ab,", "ab", "ab", "1", "$x", "x"]
    assert np.isclose(names["log_words"], np.log1p(7)) and np.isclose(names["log_word_bytes"], np.log1p(sum(map(len, words)) / 7))
    assert np.isclose(names["distinct_words"], 6 / 7) and np.isclose(names["top_repeat"], np.sqrt(2 / 7))
    assert np.isclose(names["words_with_symbols"], np.sqrt(1 / 7)) and np.isclose(names["capital_words"], np.sqrt(1 / 7))
    assert np.isclose(names["log_line_words"], np.log1p(7 / 3)) and names["repeated_lines"] == 0
    assert np.isclose(qm.statistics(pa.array(["a b\na b\nc"]))[0][-1], 1 / 3)


def test_statistics_of_a_row_do_not_depend_on_its_neighbours():
    texts = [t for _, t in edge_rows()]
    together = qm.statistics(pa.array(texts))
    assert np.allclose(together, np.concatenate([qm.statistics(pa.array([t], pa.string())) for t in texts]))


def test_edges(edge, empty):
    described = qm.features(edge)
    labelled = described.select("x", F.when(F.col("id") < 10, 1).when(F.col("id") < 110, 0).alias("label"))
    scores = [r["score"] for r in qm.score(described, qm.fit(labelled)).collect()]
    assert len(scores) == len(edge_rows()) and all(0 <= s <= 1 for s in scores)
    nothing = qm.fit(qm.features(empty).withColumn("label", F.lit(1)))
    assert qm.score(qm.features(empty), nothing).collect() == []
    assert all(r["score"] == 0.5 for r in qm.score(described, nothing).collect())


def test_query_is_accurate_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_quality"](spark, LARGER).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(labels[r["doc_id"]] == r["predicted"] for r in rows) >= 0.98 * len(rows) > 50
