"""Ranked lexical search by the Best Position Algorithm over impact lists.

One pass over the documents keeps, for each, its number of terms and its counts of the items' terms; corpus
sums and document frequencies are aggregates over it. Each task then turns its rows, a bounded number of
postings at a time, into impact lists (a term's documents by descending impact) and searches every item.

A search reads the lists of the item's terms from the top, all to the same depth. Every document met is
looked up in the other lists too (direct access by document), which gives its whole score and its positions there.
The best position of a list is the last of the unbroken run of seen positions from its top, often far below
the depth that was read; the impacts at the best positions sum to a bound on everything unseen. The search stops
once that bound is strictly below the score of the k-th document so far, so equal scores are never cut.
What a task has found in earlier postings counts as its k-th already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.llm.common import few_rows, pick
from formline.llm.tokens import ALPHANUMERIC, bytes_of, slices, words
from formline.session import cut

#: Bytes of item texts that are searched together; postings that a task holds at a time; first depth of a search.
BLOCK_BYTES = 8 << 20
POSTINGS = 4 << 20
DEPTH = 64
_MOST = np.iinfo(np.int64).max


@dataclass
class Items:
    """Some items as sets of term numbers; terms are known by sorted hashes and confirmed by their bytes."""

    ids: list
    hashes: np.ndarray  # sorted
    numbers: np.ndarray  # of the term at each hash
    begins: np.ndarray  # by number, in ``data``
    lens: np.ndarray
    data: np.ndarray
    terms: list  # of each item: term numbers

    @staticmethod
    def of(ids: list, texts: list) -> "Items":
        names: dict[tuple[int, bytes], int] = {}
        terms = []
        for text in texts:
            column = pa.array([text], pa.string())
            found = words(*bytes_of(column), ALPHANUMERIC, lower=True)
            own = {(int(h), found.text(i)) for i, h in enumerate(found.hashes)}
            terms.append(np.array(sorted(names.setdefault(t, len(names)) for t in own), np.int64))
        keys = list(names)
        hashes = np.array([h for h, _ in keys], np.uint64)
        order = np.argsort(hashes, kind="stable")
        lens = np.array([len(t) for _, t in keys], np.int64)
        data = np.frombuffer(b"".join(t for _, t in keys), np.uint8)
        return Items(ids, hashes[order], order, np.cumsum(lens) - lens, lens, data, terms)

    def numbers_of(self, found) -> np.ndarray:
        """Term number of each word, -1 where it is none of the items'."""
        if not len(self.hashes) or not len(found.hashes):
            return np.full(len(found.hashes), -1)
        out = np.full(len(found.hashes), -1)
        first = np.searchsorted(self.hashes, found.hashes)
        for step in range(int(np.max(np.unique(self.hashes, return_counts=True)[1]))):  # 1, but for equal hashes
            at = (first + step).clip(0, len(self.hashes) - 1)
            near = np.flatnonzero((self.hashes[at] == found.hashes) & (out < 0))
            number = self.numbers[at[near]]
            same = self.lens[number] == (found.ends - found.starts)[near]
            near, number = near[same], number[same]
            out[near[_equal(found.data, found.starts[near], self.data, self.begins[number], self.lens[number])]] = -2
            good = out[near] == -2
            out[near[good]] = number[good]
        return out


def _equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether the runs of bytes are the same, in pieces of bounded size."""
    out = np.ones(len(lens), bool)
    for i in range(int(lens.max(initial=0))):
        on = np.flatnonzero((lens > i) & out)
        out[on] = a[a_at[on] + i] == b[b_at[on] + i]
    return out


def term_lists(docs: DataFrame, shared) -> DataFrame:
    """(id, n, terms, counts): all terms of a document, and its counts of the items' terms."""
    schema = T.StructType([
        docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(**shared.value)
        for batch in few_rows(batches, 1024):
            data, bounds = bytes_of(batch["text"])
            for lo, hi in slices(bounds):
                found = words(data, bounds[lo : hi + 1], ALPHANUMERIC, lower=True)
                number = items.numbers_of(found)
                keys, counts = np.unique((found.rows[number >= 0] << 32) | number[number >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(keys >> 32, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch["id"].slice(lo, hi - lo), pa.array(np.diff(found.first).astype(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array((keys & 0xFFFFFFFF).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64))),
                ], names=["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, schema)


class Lists:
    """Impact lists of some documents, and the same postings by document for direct access."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int, terms: int):
        by_list = np.lexsort((row, -impact, term))
        self.term, self.row, self.impact = term[by_list], row[by_list], impact[by_list]
        self.first = np.searchsorted(self.term, np.arange(terms + 1))
        # postings of a document, each with its place in the lists
        self.places = np.argsort(self.row, kind="stable")
        self.doc_first = np.searchsorted(self.row[self.places], np.arange(rows + 1))
        self.rows = rows

    def search(self, terms: np.ndarray, k: int, floor: int, trace: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of all documents with a score of at least ``floor`` that may be among the best ``k``.

        ``floor`` is a k-th score known from elsewhere; it is above 0.
        """
        begin, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        terms, begin, size = terms[size > 0], begin[size > 0], size[size > 0]
        wanted = np.zeros(len(self.first), bool)
        wanted[terms] = True
        seen_rows = np.zeros(self.rows, bool)
        # seen positions of the lists, one after the other, with one that is never seen at the end of each
        base = np.cumsum(size + 1) - size - 1
        of_term = np.zeros(len(self.first), np.int64)
        of_term[terms] = np.arange(len(terms))
        seen = np.zeros(int((size + 1).sum()), bool)
        best = np.zeros(len(terms), np.int64)  # positions from the top that are all seen
        rows, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        depth, kth, read = 0, floor, 0
        while len(terms):
            new_depth = DEPTH if not depth else 2 * depth
            lo, hi = np.minimum(depth, size), np.minimum(new_depth, size)
            take = np.repeat(begin + lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
            met = np.unique(self.row[take])
            met = met[~seen_rows[met]]
            seen_rows[met] = True
            read += len(met)
            # direct access: every posting of the new documents that belongs to the item
            counts = self.doc_first[met + 1] - self.doc_first[met]
            own = np.repeat(self.doc_first[met] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            place, of = self.places[own], np.repeat(np.arange(len(met)), counts)
            ours = wanted[self.term[place]]
            place, of = place[ours], of[ours]
            score = np.zeros(len(met), np.int64)
            np.add.at(score, of, self.impact[place])
            which = of_term[self.term[place]]
            seen[base[which] + place - begin[which]] = True
            rows.append(met)
            scores.append(score)
            for i in range(len(terms)):
                # the run of seen positions goes on to the first gap
                run = seen[base[i] + best[i] : base[i] + size[i] + 1]
                best[i] += int(np.argmin(run))
            every = np.concatenate(scores)
            if len(every) >= k:
                kth = max(kth, int(np.partition(every, len(every) - k)[len(every) - k]))
                rows, scores = [np.concatenate(rows)], [every]
            # what is unseen has at most the impact at the best position of each list, the last position that is seen
            bound = int(self.impact[begin + np.maximum(best - 1, 0)][best < size].sum())
            depth = new_depth
            if bound < kth or bool((best == size).all()) or depth >= int(size.max()):
                break
        if trace is not None:
            trace["met"] = trace.get("met", 0) + read
        row, score = np.concatenate(rows), np.concatenate(scores)
        good = score >= kth
        return row[good], score[good]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents with a score above 0 of every item.

    Rows of the same item id are one item with the terms of all; repeated documents are ranked each on its own, a
    missing doc_id after all others of its score. Items without terms and empty tables give no rows. Items are
    searched in blocks of ``BLOCK_BYTES`` of text.
    """
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(_MOST)))
    asked = pick(items, item=item_col, text=item_text).filter("text is not null")
    parts = [_search_block(spark, rows, block, k) for block in _blocks(asked)]
    item = T.StructField("item", asked.schema["item"].dataType)
    kept = T.StructType([item, T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    found = parts[0] if parts else spark.createDataFrame([], kept)
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    doc = F.when(F.col("id") < _MOST, F.col("id")).alias(id_col)
    return ranked.select(F.col("item").alias(item_col), "rank", doc, "score")


def _blocks(asked: DataFrame) -> Iterator[Items]:
    """Items in order of their id, ``BLOCK_BYTES`` of text at a time; the driver holds one block."""
    ids, texts, size = [], [], 0
    for r in asked.orderBy("item", "text").toLocalIterator():
        if ids and ids[-1] == r["item"]:
            texts[-1] += "\n" + r["text"]
        else:
            if size >= BLOCK_BYTES:
                yield Items.of(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(r["item"])
            texts.append(r["text"])
        size += len(r["text"].encode())
    if ids:
        yield Items.of(ids, texts)


def _search_block(spark, rows: DataFrame, items: Items, k: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(vars(items))  # BLOCK_BYTES of terms
    lists = cut(term_lists(rows, shared))
    total = lists.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    per_term = lists.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # terms of the block
    frequency = np.zeros(len(items.lens), np.int64)
    for r in per_term:
        frequency[r["t"]] = r["df"]
    n_docs, n_terms = total["docs"], total["terms"]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequency + 1).astype(np.float64))).astype(np.int64)
    corpus = spark.sparkContext.broadcast((n_docs, n_terms, weight, items.terms))
    schema = "at int, id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_terms, weight, terms = corpus.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in terms]
        for ids, lists in _impacts(batches, n_docs, n_terms, weight):
            for i, own in enumerate(terms):
                held, held_scores = best[i]
                floor = int(held_scores[-1]) if len(held) >= k else 1
                row, score = lists.search(own, k, floor)
                if len(row):
                    best[i] = _best(np.concatenate((held, ids[row])), np.concatenate((held_scores, score)), k)
        counts = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(best)), counts).astype(np.int32)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best])),
        ], names=["at", "id", "score"])

    found = lists.select("id", "n", "terms", "counts").mapInArrow(run, schema)
    names = spark.createDataFrame([(i, name) for i, name in enumerate(items.ids)], T.StructType([T.StructField("at", T.IntegerType()), T.StructField("item", _type_of(items.ids))]))
    return found.join(names, "at").select("item", "id", "score")


def _type_of(ids: list) -> T.DataType:
    return T.StringType() if any(isinstance(i, str) for i in ids) else T.LongType()


def _impacts(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, weight: np.ndarray) -> Iterator[tuple[np.ndarray, Lists]]:
    """Document ids and impact lists of ``POSTINGS`` postings at a time."""
    held, size = [], 0

    def made() -> tuple[np.ndarray, Lists]:
        ids, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        lens, term, count = (np.concatenate([h[c] for h in held]) for c in (2, 3, 4))
        row = np.repeat(np.arange(len(ids)), lens)
        spread = 50 + (50 * n * n_docs) // max(1, n_terms)
        impact = weight[term] * ((10**9 * count) // (1000 * count + 20 * spread[row]))
        used = impact > 0
        return ids, Lists(row[used], term[used].astype(np.int64), impact[used], len(ids), len(weight))

    for batch in batches:
        terms, counts = batch["terms"], batch["counts"]
        ends = terms.offsets.to_numpy().astype(np.int64)
        held.append((
            batch["id"].to_numpy(zero_copy_only=False), batch["n"].to_numpy(zero_copy_only=False), np.diff(ends), terms.flatten().to_numpy(), counts.flatten().to_numpy(),
        ))
        size += int(ends[-1] - ends[0])
        if size >= POSTINGS:
            yield made()
            held, size = [], 0
    if held:
        yield made()
