import random

import tiktoken

import corpus_pipeline
from formline.llm import bpe
from formline.llm.lines import report_lines
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, sentence
from tests.llm.test_jaccard import brute


def staged(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / f"{name}.parquet")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_agree_with_their_operators(spark, tmp_path):
    docs, good, lines, unique, clean, tokens = staged(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, tmp_path)
    assert all(d.columns == docs.columns for d in (good, lines, unique, clean))
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op7_quality"](spark, SF).collect()}
    assert ids(good) == {k for k, s in scores.items() if s >= 0.3}
    emptied = {r["doc_id"] for r in report_lines(good, min_words=0).filter("n_removed > 0").collect() if not r["text"].strip()}
    assert ids(lines) == ids(good) - emptied and emptied
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(k in ids(good) for k, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    # line dedup of all lines leaves no near-duplicates in this table; the stage has a test of its own
    assert ids(clean) < ids(unique) <= ids(lines)
    encoder = tiktoken.Encoding(
        "plain", pat_str=corpus_pipeline.public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    )
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.collect()} == {r["doc_id"]: len(encoder.encode_ordinary(r["text"])) for r in clean.collect()}


def test_near_duplicates_equal_brute_force_at_five_words(spark):
    rng, docs = random.Random(4), []
    for i in range(30):
        base = sentence(rng, 204).split()
        changed = list(base)
        for k in range(4):  # isolated edits cost 5 shingles of five words and 4 of four
            changed[20 + 40 * k] = f"edit{k}"
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(changed[: 204 - i]))]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = {str(r["doc_id"]) for r in corpus_pipeline.drop_near_duplicates(spark, rows, SF).collect()}
    five, four = ({str(c) for _, _, c in brute(docs, *law)} for law in ((5, 80), (4, 85)))
    assert kept == five and five < four


def test_edges_and_empty_table(spark, edge, empty, tmp_path):
    stages = staged(spark, edge, SF, tmp_path / "edge")
    assert all(d.columns == edge.columns for d in stages[:-1]) and stages[-1].count() == stages[-2].count()
    assert stages[3].filter("doc_id = 1").count() == 1 and stages[3].filter("doc_id = 5 or doc_id is null and text is not null").count() == 0
    assert staged(spark, empty, SF, tmp_path / "empty")[-1].collect() == []
