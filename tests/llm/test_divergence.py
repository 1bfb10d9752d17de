import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import divergence as dv
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, SYLLABLES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=50):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        groups[lang].add(source)
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        count = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}

        def share(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (n + 5) // (total + 5 * len(kept)) for t, n in c.items()}

        p, q = {s: share(count[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            over = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, r + 1) for r, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(60)] + ["Ünï", "мир", "e3f"]
    rows = [
        (rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", *"abcdefg", None]), " ".join(rng.choices(vocabulary[: rng.randint(5, 63)], k=rng.randint(0, 30))))
        for _ in range(300)
    ]
    rows += [("en", "silent", None), ("en", "silent", ""), ("xx", "alone", "never kept"), ("xx", "other", "123 !!"), ("en", "long", "ta ko mi " * 20_000), ("en", "a", "Same Same"), ("en", "a", "Same Same")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(corpus(), "lang string, source string, text string").repartition(5)
    return rows.withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "p", "tile", "a", "b", "value")})


@pytest.mark.parametrize("strip, tile, front", [(4096, 256, 1 << 19), (8, 256, 7), (16, 3, 64), (4096, 1, 1 << 19)])
def test_equal_to_brute_force_for_any_strips_and_tiles(docs, monkeypatch, strip, tile, front):
    for name, value in (("STRIP", strip), ("TILE", tile), ("FRONT", front)):
        monkeypatch.setattr(dv, name, value)
    assert rows_of(dv.audit(docs, least_docs=5)) == brute(corpus(), 5)


def test_few_terms_are_kept_or_none(docs):
    assert rows_of(dv.audit(docs, least_docs=10**6)) == brute(corpus(), 10**6)
    assert rows_of(dv.audit(docs, least_docs=1, top=3)) == brute(corpus(), 1, 3)


def test_empty_table(docs):
    assert dv.audit(docs.limit(0)).collect() == []


@pytest.mark.parametrize("height, width, share", [(1, 1, 1.0), (5, 1, 0.5), (3, 200, 0.05), (20, 77, 0.4), (33, 64, 0.0), (7, 30, 1.0)])
def test_trees_agree_with_the_dense_matrix(height, width, share):
    rng = np.random.default_rng(height)
    rows, columns = np.nonzero(rng.random((height, width)) < share)
    values, unseen = rng.integers(1, 10**9, len(rows)), rng.integers(1, 10**6, height)
    dense = np.repeat(unseen[:, None], width, axis=1)
    dense[rows, columns] = values
    want = np.triu(np.abs(dense[:, None] - dense[None]).sum(axis=2), 1)
    tree = dv.Tree(rows, columns, values, height, width)
    assert np.array_equal(dv.compare(tree, unseen, range(height), range(height)), want)
    half = height // 2
    cross = np.where((np.arange(height)[:, None] < half) & (np.arange(height)[None] >= half), want, 0)
    assert np.array_equal(dv.compare(tree, unseen, range(half), range(half, height)), cross)


def test_empty_quadrants_are_not_entered():
    """Two rows without cells among many columns take one price, not one a column."""
    tree = dv.Tree(np.array([0]), np.array([0]), np.array([9]), 3, 1 << 16)
    visited = []
    find = tree.find
    tree.find = lambda k, rows, columns: visited.append(len(rows)) or find(k, rows, columns)
    got = dv.compare(tree, np.array([1, 2, 4]), range(3), range(3))
    assert got[1, 2] == 2 * (1 << 16) and got[0, 1] == (1 << 16) - 1 + 7 and sum(visited) < 2000


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, kept = 10**15, 4 * 10**15 + 7, 10**6
    got = spark.range(1).select(dv.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_query_equals_brute_force(spark):
    docs = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_source_divergence"](spark, SF)) == brute(docs, 30)
