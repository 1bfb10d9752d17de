import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from formline.llm import contamination
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, edge_rows

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(docs, items, window=13):
    """{(id, text): (n_words, n_hit, items)} by comparing every window with every place."""
    phrases = {}
    for key, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add(key)
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[tuple(w[k : k + n])]
        out.append((str(key), len(w), len(hit), sorted(found)))
    return sorted(out)


ITEMS = [(1, edge_rows()[10][1].split("\n")[0]), (2, None), (3, ""), (4, "ONE"), (5, "a b c d e f g h i j k l m"), (6, "a b, c d e f g h i j k l m n"),
         (7, "One"), (8, "école STRASSE"), (9, "école straße"), (10, "É" + "cole"), (11, "...")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_equals_brute_force_with_one_block_and_many(edge, items, block_bytes, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block_bytes)
    rows = contamination.decontaminate(edge, items).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["items"])) for r in rows) == brute(edge_rows(), ITEMS)
    for r in rows:
        assert r["n_hit"] == sum(b - a for a, b in r["spans"]) if block_bytes > 200 else True


@pytest.mark.parametrize("block_bytes", [8 << 20, 30])
def test_an_id_counts_once_however_often_its_rows_repeat(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block_bytes)
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    given = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "delta epsilon"), (2, "epsilon zeta")]
    rows = contamination.decontaminate(docs, spark.createDataFrame(given, "item_id long, text string")).collect()
    assert [(sorted(r["items"]), r["n_hit"]) for r in rows] == [([1, 2], 6)]


def test_proximity_lets_words_move(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha q q q beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    exact = {r["doc_id"]: r["items"] for r in contamination.decontaminate(docs, items).collect()}
    near = {r["doc_id"]: r["items"] for r in contamination.decontaminate(docs, items, slop=1).collect()}
    assert exact == {1: [], 2: [1], 3: []} and near == {1: [1], 2: [1], 3: []}


def test_empty_tables(edge, empty, items):
    assert contamination.decontaminate(empty, items).collect() == []
    rows = contamination.decontaminate(edge, items.limit(0)).collect()
    assert len(rows) == len(edge_rows()) and not any(r["n_hit"] for r in rows)


def test_query(spark):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(d["item_id"], d["text"]) for d in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [
        (i, n, h, len(x), hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, n, h, x in brute(docs, items)
    ]
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in QUERIES["op2_decontamination"](spark, SF).collect()]
    assert sorted(got) == want
    assert any(g[5] for g in got)


def test_a_block_of_phrases_takes_few_bytes_a_window():
    """Tasks hold the words of a block once, not a row of 13 words and places for every window."""
    items = [(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(40)]
    block = contamination.Phrases(items, 13)
    held = sum(v.nbytes for v in vars(block).values() if isinstance(v, np.ndarray))
    assert len(block.lens) > 4000 and held < 80 * len(block.lens)


def test_the_stored_index_is_read_a_few_shards_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(contamination, "SHARD_BYTES", 2000)
    monkeypatch.setattr(contamination, "ROW_GROUPS", contamination.ROW_GROUPS | {"parquet.block.size": "20000"})
    kept, plain = [], contamination.cut
    monkeypatch.setattr(contamination, "cut", lambda *given: (kept.append(plain(*given)), kept[-1])[1])
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(90)], "doc_id long, text string").coalesce(1)
    contamination.decontaminate(df, spark.createDataFrame([(1, "w3x5 w3x6")], "item_id long, text string")).count()
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in kept[0].inputFiles()]
    assert kept[0].count() == 90 and max(groups) >= 5
