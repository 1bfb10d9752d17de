import hashlib

import pytest

from formline.llm import ordermin
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, edge_rows


def test_fingerprint_is_of_the_text_alone(edge):
    got = sorted((str(r["doc_id"]), r["fingerprint"]) for r in ordermin.fingerprint(edge).collect())
    assert got == sorted((str(i), ordermin.sketch(t or "")) for i, t in edge_rows())
    assert all(len(f) == ordermin.SKETCHES * ordermin.DIGITS for _, f in got)


def test_likeness_follows_edits_and_order():
    text = " ".join(f"word{i} and" for i in range(300))
    half = len(text) // 2
    assert ordermin.likeness(ordermin.sketch(text), ordermin.sketch(text)) == 1
    small = ordermin.likeness(ordermin.sketch(text), ordermin.sketch(text[:1000] + "CHANGED" + text[1000:]))
    swapped = ordermin.likeness(ordermin.sketch(text), ordermin.sketch(text[half:] + text[:half]))
    other = ordermin.likeness(ordermin.sketch(text), ordermin.sketch("nothing of it " * 100))
    assert small > 0.8 > swapped > other  # the same k-mers in another order are less alike


def test_likeness_column(spark):
    a, b = ordermin.sketch("some text that is long enough"), ordermin.sketch("some text that is long indeed")
    rows = spark.createDataFrame([(a, b), (a, a), (a, None)], "a string, b string")
    got = [r[0] for r in rows.select(ordermin.likeness_column(rows["a"], rows["b"])).collect()]
    assert got == [ordermin.likeness(a, b), 1.0, None]


def test_next_document_across_partitions(spark, edge):
    rows = sorted({i: t or "" for i, t in edge_rows() if i is not None}.items())
    docs = edge.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in ordermin.compare_with_next(docs).collect()}
    assert len(got) == len(rows)
    for (_, following), (key, text) in zip([rows[-1], *rows[:-1]], rows):
        changed = ordermin.edited(text, following)
        assert got[key]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[key]["edited_fingerprint"] == ordermin.sketch(changed)
        assert got[key]["near_next"] == ordermin.likeness(ordermin.sketch(text), ordermin.sketch(following))


def test_null_ids_and_repeated_rows_keep_their_rows(edge):
    assert ordermin.compare_with_next(edge).count() == len(edge_rows())


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(edge, n):
    rows = ordermin.compare_with_next(edge.filter("doc_id = 1").limit(n)).collect()
    assert len(rows) == n and all(r["near_next"] == 1.0 for r in rows)


def test_query(spark):
    rows = QUERIES["op4_order_minhash"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in rows) == sorted((d["doc_id"], len(d["text"] or "")) for d in docs)
    assert sum(r["near_edited"] for r in rows) / len(rows) > sum(r["near_next"] for r in rows) / len(rows) + 0.1
