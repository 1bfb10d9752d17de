import hashlib
import re

import pytest

from formline.llm import phrases
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=13):
    first = {}
    split = [(key, WORD.findall(text or "")) for key, text in docs]
    for key, w in split:
        for k in range(len(w) - window + 1 if key is not None else 0):
            at = tuple(w[k : k + window])
            first[at] = min(key, first.get(at, key))
    out = []
    for key, w in split:
        lost = set()
        for k in range(len(w) - window + 1 if key is not None else 0):
            if first[tuple(w[k : k + window])] < key:
                lost.update(range(k, k + window))
        out.append((str(key), len(w), len(lost), " ".join(x for i, x in enumerate(w) if i not in lost)))
    return sorted(out)


@pytest.mark.parametrize("shard", [500_000, 50])
def test_equals_brute_force_with_one_automaton_and_many(edge, shard, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    rows = phrases.remove_repeats(edge).collect()
    want = brute(edge_rows())
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in rows) == want


def test_other_windows(edge):
    rows = phrases.remove_repeats(edge, window=2).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in rows) == brute(edge_rows(), 2)


def test_empty_table(empty):
    assert phrases.remove_repeats(empty).collect() == []


def test_query(spark):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op6_repeated_phrases"](spark, SF).collect())
    assert got == [(i, n, x, hashlib.sha256(t.encode()).hexdigest()) for i, n, x, t in brute(docs)]
    assert any(g[2] for g in got)
