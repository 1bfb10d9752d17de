import re

import numpy as np

from formline.llm import jaccard, linking
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, edge_rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(docs, n=4, percent=85):
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(docs):
        members = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        out.append((str(key), len(sets[i]), min(members) if members else None))
    return sorted(out, key=str)


def test_equals_brute_force(edge):
    rows = jaccard.near_duplicates(edge).collect()
    assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in rows), key=str) == brute(edge_rows())
    kept = {}
    for r in rows:
        kept.setdefault((r["component_id"], r["n_shingles"] == 0 and r["row"]), set()).update([r["row"]] if r["kept"] else [])
    assert all(len(v) == 1 for v in kept.values())


def test_chains_of_small_edits(spark):
    """Groups whose ends are not similar themselves, and common passages that link nothing."""
    import random

    rng = random.Random(3)
    common, docs = sentence(rng, 30), []
    for group in range(6):
        words = sentence(rng, 120).split()
        for step in range(12):
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = sentence(rng, 1)
            docs.append((len(docs) * 7 % 101 + 1000 * group, " ".join(words) + (" " + common if step % 2 else "")))
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = jaccard.near_duplicates(rows).collect()
    assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(docs)


def test_threshold_is_exact():
    a = np.arange(100, dtype=np.uint64)
    for common in range(80, 101):
        b = np.concatenate((a[:common], np.arange(1000, 1100 - common + 1000, dtype=np.uint64)[: 100 - common]))
        assert jaccard.similar(a, np.sort(b), 85) == (100 * common >= 85 * (200 - common))


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame([*path, *star, (500, 500)], "a long, b long")
    got = {r["id"]: r["component"] for r in linking.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert linking.components(edges.limit(0)).collect() == []


def test_empty_table(empty):
    assert jaccard.near_duplicates(empty).collect() == []


def test_query(spark):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in QUERIES["op8_jaccard"](spark, SF).collect()), key=str)
    assert got == brute(docs)
