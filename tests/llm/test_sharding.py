import zlib

import numpy as np

from formline.llm import sharding
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, edge_rows


def test_permutation_is_one_for_any_size():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        places = sharding.permute(np.arange(n), n, seed=5)
        assert sorted(places.tolist()) == list(range(n))
    assert (sharding.permute(np.arange(1000), 1000, 1) != sharding.permute(np.arange(1000), 1000, 2)).any()


def test_every_row_has_a_place_and_a_number(edge):
    rows = sharding.shard(edge, 7).collect()
    assert len(rows) == len(edge_rows())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in edge_rows()
    )
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(7)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    places = sharding.permute(np.array([r["row_number"] for r in rows]), len(rows), 1)
    assert [(r["shard"], r["slot"]) for r in rows] == [(p % 7, p // 7) for p in places.tolist()]


def test_same_result_for_any_partitioning(edge):
    one, other = (sorted(map(str, sharding.shard(edge.filter("doc_id > 6").repartition(n), 5).collect())) for n in (1, 6))
    assert one == other


def test_empty_table(empty):
    assert sharding.shard(empty, 3).collect() == []


def test_query(spark):
    rows = QUERIES["op9_feistel_shards"](spark, SF).collect()
    docs = {d["doc_id"]: d["text"] or "" for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs.items()}
    counts = [sum(r["shard"] == s for r in rows) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
