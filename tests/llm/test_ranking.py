import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import ranking
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, edge_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item, doc, score) of the best documents, by scoring every document."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, c in counted:
            m = 50 + (50 * c.total() * n_docs) // n_terms if n_terms else 50
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=lambda r: (str(r[0]), r[1]))


@pytest.mark.parametrize("postings, depth", [(4 << 20, 64), (50, 1), (50, 3)])
def test_edges_equal_brute_force(spark, edge, monkeypatch, postings, depth):
    monkeypatch.setattr(ranking, "POSTINGS", postings)
    monkeypatch.setattr(ranking, "DEPTH", depth)
    asked = [(1, "ta ko mi ta"), (2, ""), (3, None), (4, "Straße ÉCOLE 123"), (5, "one ONE two"), (6, "nowhere zzz"), (5, "a b c"), (7, edge_rows()[0][1])]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("id", F.lit("clash"))
    for k in (3, 50):
        assert rows_of(ranking.search(edge, items, k)) == brute(edge_rows(), [a for a in asked if a[1]], k)


def test_blocks_of_items_give_the_same(spark, edge, monkeypatch):
    items = spark.createDataFrame([(str(i), t) for i, t in enumerate(["ta ko", "mi ren su", "a b c", "one two"])], "item_id string, text string")
    whole = rows_of(ranking.search(edge, items, 5))
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 5)
    assert rows_of(ranking.search(edge, items, 5)) == whole and whole


def test_empty_tables(spark, edge, empty):
    items = spark.createDataFrame([(1, "ta ko")], "item_id long, text string")
    assert ranking.search(empty, items).collect() == []
    assert ranking.search(edge, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranking.search(edge, items.limit(0)).collect() == []


def test_best_positions_stop_before_the_end():
    """Two lists that agree on the top: the search ends long before it has met every document."""
    rng = np.random.default_rng(0)
    n = 20_000
    top = np.sort(rng.integers(1, 10**6, n))[::-1]
    row = np.tile(np.arange(n), 2)
    lists = ranking.Lists(row, np.repeat([0, 1], n), np.tile(top, 2), n, 2)
    trace: dict = {}
    found, scores = lists.search(np.array([0, 1]), 10, 1, trace)
    assert trace["met"] < n / 50
    order = np.lexsort((found, -scores))[:10]
    assert found[order].tolist() == list(range(10)) and scores[order].tolist() == (2 * top[:10]).tolist()


def test_direct_access_counts_positions_not_read():
    """A document's posting far down another list is seen too, so that list's best position runs on past the depth."""
    n = 1000
    first, second = np.arange(n, 0, -1), np.full(n, 5)
    lists = ranking.Lists(np.tile(np.arange(n), 2), np.repeat([0, 1], n), np.concatenate((first, second)), n, 2)
    trace: dict = {}
    found, scores = lists.search(np.array([0, 1]), 64, 1, trace)
    # ties in the second list lie in order of the document, so both lists are seen to the same position
    assert trace["met"] <= 128 and scores.max() == n + 5


def test_ties_at_the_last_rank_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(200, 0, -1)] + [(0, "other words here")], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert [r[2] for r in rows_of(ranking.search(docs, items, 50))] == list(range(1, 51))


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op11_best_position"](spark, SF)) == brute(docs, items, 50)
