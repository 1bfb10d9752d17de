"""Byte-level BPE: every distinct word of the corpus is encoded once, ids are joined back by position.

1. Texts are split into pre-tokens in bounded chunks. A chunk keeps its documents as sequences of
   chunk-local word numbers (the positions) and lists its distinct words by hash bucket.
2. The words are shuffled by bucket; a bucket encodes each distinct word once and answers every chunk.
3. Answers meet their chunk, where the documents are put together by position.

Only distinct words of a chunk are shuffled, so a word as frequent as " the" costs one entry a chunk.
Decoding joins ids with the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from formline.llm.common import few_rows, pack, pack_strings, pick, pieces, unpack, unpack_strings
from formline.session import cut_by

#: A chunk of documents is closed at this many characters.
CHUNK_CHARS = 8 << 20
#: Ids that one batch of decoded or encoded documents holds at most, long documents aside.
BATCH_IDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """(id_col, ids array<int>) for every row of ``docs``.

    A missing or empty text has no ids. Rows that repeat, also with a missing id, each give a row.
    """
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType
    buckets = pieces(docs, 4 << 20)
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("lens", T.ArrayType(T.IntegerType())),
        T.StructField("payload", T.BinaryType()),
    ])
    out_schema = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow, out_arrow = to_arrow_schema(schema), to_arrow_schema(out_schema)
    vocabulary = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary file

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, first = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        known, codes, ids, lens, chars, number = {}, [], [], [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            lists: list[list[bytes]] = [[] for _ in range(buckets)]
            place = np.empty(len(known), np.uint32)
            for code, word in enumerate(known):
                raw = word.encode()
                place[code] = b = zlib.crc32(raw) % buckets
                lists[b].append(raw)
            own = pack(np.concatenate((np.array([len(known)], np.uint32), place, *codes)))
            out = [(first + number, -1, ids, lens, own)]
            out += [(first + number, b, None, None, pack_strings(x)) for b, x in enumerate(lists) if x]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)

        for batch in few_rows(batches):
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                words = find(text or "")
                seen = [known.setdefault(w, len(known)) for w in words]
                codes.append(np.array(seen, np.uint32))
                ids.append(key)
                lens.append(len(seen))
                chars += len(text or "")
                if chars >= chunk_chars:
                    yield from close()
                    known, codes, ids, lens, chars, number = {}, [], [], [], 0, number + 1
        if ids:
            yield from close()

    def encode_bucket(group: pa.Table) -> pa.Table:
        """Each distinct word of the bucket once, then the answer for each chunk in its own order."""
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={})
        done: dict[bytes, np.ndarray] = {}
        answers = []
        for blob in group["payload"].to_pylist():
            words = unpack_strings(blob)
            for w in words:
                if w not in done:
                    done[w] = np.array(encoder._encode_single_piece(w), np.uint32)
            found = [done[w] for w in words]
            counts = np.fromiter(map(len, found), np.uint32, len(found))
            answers.append(pack(np.concatenate((np.array([len(found)], np.uint32), counts, *found))))
        return group.set_column(group.schema.get_field_index("payload"), "payload", pa.array(answers, pa.binary()))

    def reassemble(docs_of: pa.Table, answers_of: pa.Table) -> pa.Table:
        own = docs_of.to_pylist()[0]
        answers = {r["bucket"]: unpack(r["payload"]) for r in answers_of.to_pylist()}
        sequence = unpack(own["payload"])
        n = int(sequence[0])
        place, codes = sequence[1 : n + 1], sequence[n + 1 :]
        counts, starts, parts, at = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        for b, answer in answers.items():
            k = int(answer[0])
            where = np.flatnonzero(place == b)
            counts[where] = answer[1 : k + 1]
            starts[where] = at + np.cumsum(counts[where]) - counts[where]
            parts.append(answer[k + 1 :])
            at += len(parts[-1])
        pool = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
        keys, ends = own["ids"], np.concatenate(([0], np.cumsum(own["lens"], dtype=np.int64)))
        lo, out = 0, []
        while lo < len(keys):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BATCH_IDS // 2, "right")) - 1)
            of = codes[ends[lo] : ends[hi]]
            many = counts[of]
            upto = np.concatenate(([0], np.cumsum(many)))
            index = np.repeat(starts[of] - upto[:-1], many) + np.arange(upto[-1])
            offsets = pa.array(upto[ends[lo : hi + 1] - ends[lo]], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(pool[index], pa.int32()))
            out.append(pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], out_arrow.field("id").type), lists], names=["id", "ids"]).cast(out_arrow))
            lo = hi
        return pa.Table.from_batches(out, schema=out_arrow)

    # stored by chunk: of the two sides that meet again, only the answers are shuffled
    chunks = cut_by(rows.mapInArrow(split, schema), "chunk", pieces(docs, 8 << 20))
    answered = chunks.filter("bucket >= 0").select("chunk", "bucket", "payload").groupBy("bucket").applyInArrow(
        encode_bucket, "chunk long, bucket int, payload binary"
    )
    documents = chunks.filter("bucket < 0").select("chunk", "ids", "lens", "payload")
    return documents.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(reassemble, out_schema).select(
        F.col("id").alias(id_col), "ids"
    )


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, bytes binary): each row's ids joined with the token-byte table, in order.

    A missing list counts as empty; an id that the table lacks is an error.
    """
    rows = pick(encoded, id=id_col, ids=ids_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])
    by_id = sorted((rank, token) for token, rank in ranks.items())
    vocabulary = encoded.sparkSession.sparkContext.broadcast(by_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = vocabulary.value[-1][0] + 1 if vocabulary.value else 0
        words: list[bytes] = [b""] * size
        present = np.zeros(size + 1, bool)
        for rank, token in vocabulary.value:
            words[rank], present[rank] = token, True
        pool = np.frombuffer(b"".join(words), np.uint8)
        lens = np.fromiter(map(len, words), np.int64, size)
        starts = np.cumsum(lens) - lens
        for batch in batches:
            lists = batch["ids"]
            limits = np.concatenate(([0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and not (present[np.clip(ids, 0, size)] & (ids >= 0)).all():
                raise ValueError("an id is not in the token table")
            lo = 0
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(limits, limits[lo] + BATCH_IDS, "right")) - 1)
                of = ids[limits[lo] : limits[hi]]
                many = lens[of]
                upto = np.concatenate(([0], np.cumsum(many)))
                raw = pool[np.repeat(starts[of] - upto[:-1], many) + np.arange(upto[-1])]
                offsets = upto[limits[lo : hi + 1] - limits[lo]].astype(np.int32)
                cells = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), lists.slice(lo, hi - lo), cells], names=["id", "ids", "bytes"])
                lo = hi

    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "bytes")
