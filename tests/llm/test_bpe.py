import hashlib

import public_tokenizers
import tiktoken

from formline.llm import bpe
from formline.llm.queries import QUERIES
from tests.llm.conftest import SF, edge_rows

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def key(row):
    return str(row[0]), row[1]


def test_ids_equal_the_library_and_decode_back(edge):
    encoded = bpe.encode(edge, RANKS, public_tokenizers.PATTERN, chunk_chars=2000)
    got = sorted(((r["doc_id"], (list(r["ids"]), bytes(r["bytes"]))) for r in bpe.decode(encoded, RANKS).collect()), key=lambda r: (str(r[0]), str(r[1])))
    want = sorted(((i, (PLAIN.encode_ordinary(t or ""), (t or "").encode())) for i, t in edge_rows()), key=lambda r: (str(r[0]), str(r[1])))
    assert got == want


def test_empty_table(empty):
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).collect() == []


def test_unknown_id_is_an_error(spark):
    import pytest

    with pytest.raises(Exception, match="token table"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), RANKS).collect()


def test_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = PLAIN.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
