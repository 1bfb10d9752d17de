"""Word-use divergence of sources within their language, over a quadtree of the group-term count matrix.

The rows of a language's matrix are its sources (groups), its columns the kept terms. Columns are dealt
into strips by hash and groups into tiles, so a task holds one strip of two tiles at most, whatever
the size of the corpus. Each strip is stored as a K-squared tree (K = 2): level by level, the codes of the
quadrants that hold a count. Two groups are compared by going down their nodes together. Where both quadrants
are empty, every cell has the price of two unseen terms, so the quadrant is priced by its number of columns
alone; otherwise its four children are visited, down to cells of which one is counted at least. Sums of the
strips add up in Spark.

All numbers are integers: shares per billion, 1 + floor(10^9 (count + 5) / (N + 5 V)), by decimals in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import pick
from formline.session import cut

#: What separates terms, after A to Z are lower-cased.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Columns of a strip, about; rows of a tile. A task holds at most a strip of two tiles.
STRIP, TILE = 4096, 256
#: Pairs of nodes that are taken down a level together.
FRONT = 1 << 19


def sorted_terms(text: Column) -> Column:
    """All terms of a text with repeats, in order."""
    terms = F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), NO_TERM)
    return F.sort_array(F.filter(terms, lambda t: t != ""))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and its documents there.

    In a document's sorted terms a term is new where it differs from the one before, so documents are
    counted together with occurrences and only partial sums are shuffled.
    """
    def marked(terms: Column) -> Column:
        return F.transform(terms, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(terms, i - 1) != t)).cast("long").alias("new")))

    # the sorted array is bound once, as the only element of another
    each = F.transform(F.array(sorted_terms(F.col("text"))), marked)[0]
    long = docs.select("lang", "source", F.explode(each).alias("e")).select("lang", "source", "e.term", "e.new")
    return long.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact for any long."""
    over = F.lit(10**9).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    return F.call_function("div", over, (total + 5 * kept).cast("decimal(20,0)")) + 1


class Tree:
    """Occupied quadrants of a matrix, level by level: sorted codes row * 2^32 + column, from the root to the cells."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int):
        self.height, self.width = height, width
        self.depth = max(int(max(height, width, 1) - 1).bit_length(), 0)
        self.levels = []  # levels[k] has quadrants of 2^k rows and columns
        code = (rows.astype(np.int64) << 32) | columns
        order = np.argsort(code)
        code, self.values = code[order], values[order]
        for k in range(self.depth + 1):
            if k:
                code = np.unique(((code >> 33) << 32) | ((code & 0xFFFFFFFF) >> 1))
            self.levels.append(code)

    def find(self, k: int, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of quadrants on level ``k``, and whether they are occupied."""
        codes = self.levels[k]
        if not len(codes):
            return np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        wanted = (rows << 32) | columns
        at = np.searchsorted(codes, wanted).clip(0, len(codes) - 1)
        return at, codes[at] == wanted


def compare(tree: Tree, unseen: np.ndarray, left: range, right: range) -> np.ndarray:
    """Sum of absolute differences over all columns for each row of ``left`` by each row of ``right``.

    ``unseen`` has every row's value where it has no cell. Only pairs with the left row before the right one
    are told; the others are 0.
    """
    a_side = np.zeros((tree.height, tree.height), np.int64)
    both_empty = np.zeros((tree.height, tree.height), np.int64)
    stack = [(tree.depth, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, a, b, c = stack.pop()
        if len(a) > FRONT:
            for lo in range(0, len(a), FRONT):
                stack.append((k, a[lo : lo + FRONT], b[lo : lo + FRONT], c[lo : lo + FRONT]))
            continue
        # a pair of nodes counts if some row of the one is in left, some row of the other in right, and before it
        inside = (a << k < left.stop) & (((a + 1) << k) > left.start) & (b << k < right.stop) & (((b + 1) << k) > right.start)
        inside &= (a <= b) & (c << k < tree.width)
        a, b, c = a[inside], b[inside], c[inside]
        at_a, in_a = tree.find(k, a, c)
        at_b, in_b = tree.find(k, b, c)
        empty = ~(in_a | in_b)
        if empty.any():
            columns = np.minimum(tree.width, (c[empty] + 1) << k) - (c[empty] << k)
            blocks, place = np.unique((a[empty] << 32) | b[empty], return_inverse=True)
            for block, n in zip(blocks.tolist(), _sums(place, columns, len(blocks)).tolist()):
                x, y = (block >> 32) << k, (block & 0xFFFFFFFF) << k
                both_empty[x : x + (1 << k), y : y + (1 << k)] += n
        a, b, c, at_a, at_b, in_a, in_b = (v[~empty] for v in (a, b, c, at_a, at_b, in_a, in_b))
        if not len(a):
            continue
        if k == 0:
            p = np.where(in_a, tree.values[at_a], unseen[a])
            q = np.where(in_b, tree.values[at_b], unseen[b])
            np.add.at(a_side, (a, b), np.abs(p - q))
            continue
        bits = np.arange(8)
        stack.append((k - 1, (2 * a[:, None] + (bits >> 2)).ravel(), (2 * b[:, None] + (bits >> 1 & 1)).ravel(), (2 * c[:, None] + (bits & 1)).ravel()))
    total = a_side + both_empty * np.abs(unseen[:, None] - unseen[None, :])
    rows = np.arange(tree.height)
    wanted = np.isin(rows, left)[:, None] & np.isin(rows, right)[None, :] & (rows[:, None] < rows[None, :])
    return np.where(wanted, total, 0)


def _sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, place, values)
    return out


def _compare_strip(group: pa.Table) -> pa.Table:
    """Partial sums of one strip of two tiles: rows without a term carry the groups, the others the cells."""
    source, column, p = group["source"].combine_chunks(), group["term"].combine_chunks(), group["p"].to_numpy()
    tile = group["tile"].to_numpy()
    head = np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False))
    # the groups in order of tile and name; cells find theirs by name
    names = source.take(pa.array(head)).to_pylist()
    order = sorted(range(len(head)), key=lambda i: (tile[head[i]], names[i].encode()))
    row_of = {names[i]: k for k, i in enumerate(order)}
    unseen, tiles = p[head[order]], tile[head[order]]
    cells = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    coded = source.take(pa.array(cells)).dictionary_encode()
    rows = np.array([row_of[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    terms = column.take(pa.array(cells)).dictionary_encode()
    codes, used = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
    # columns of like density lie side by side, so empty quadrants are large; terms of other tiles alone come last
    rank = np.empty(used, np.int64)
    rank[np.argsort(-np.bincount(codes, minlength=used), kind="stable")] = np.arange(used)
    tree = Tree(rows, rank[codes], p[cells], len(names), group["width"].to_numpy().max())
    # a tile with itself, or two tiles, of which one may have no groups
    one, other = group["tile_a"][0].as_py(), group["tile_b"][0].as_py()
    first = int(np.searchsorted(tiles, one, "right"))
    left, right = range(0, first), range(0, first) if one == other else range(first, len(names))
    sums = compare(tree, unseen, left, right)
    a, b = np.nonzero((np.arange(len(names))[:, None] < np.arange(len(names))[None, :]) & np.isin(np.arange(len(names)), left)[:, None] & np.isin(np.arange(len(names)), right)[None, :])
    ordered = pa.array([names[i] for i in order], pa.string())
    lang = pa.array([group["lang"][0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "a": ordered.take(pa.array(a)), "b": ordered.take(pa.array(b)), "value": pa.array(sums[a, b])})


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of a language and a source.

    Part ``pair`` ranks the language's other sources by the divergence of their shares, summed over all kept
    terms; part ``term`` ranks the ``top`` kept terms that a group uses more than its language does.
    A missing language, source or text is empty text. Repeated rows count as often; a group without terms has
    the even share everywhere, and a language without kept terms the value 0. No rows for an empty table.
    """
    rows = pick(docs, lang=lang_col, source=source_col, text=text_col)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")})
    counts = cut(term_counts(rows))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).filter(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", "term", "whole"))
    cells = cut(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "whole"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")])
    # a tile is about TILE groups of a language; all numbers of a language fit on each of its groups
    of_lang = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    groups = cut(groups.join(of_lang, "lang").withColumns({
        "tile": F.pmod(F.xxhash64("source"), F.col("tiles")), "strips": F.greatest(F.lit(1), F.ceil(F.col("kept") / STRIP)),
    }))
    shared = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    over = shared.withColumn("value", F.col("p") - share(F.col("whole"), F.col("lang_total"), F.col("kept"))).filter("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    at_zero = share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    heads = groups.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)))
    strip = F.pmod(F.xxhash64("term"), F.col("strips")).alias("strip")
    widths = kept.join(groups.select("lang", "strips").distinct(), "lang").groupBy("lang", strip).agg(F.count(F.lit(1)).alias("width"))
    # without kept terms there is nothing to share: heads alone, of the same value
    heads = heads.join(widths, ["lang", "strip"], "left").select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "strip", "tile", "tiles",
        F.when(F.col("kept") > 0, at_zero).otherwise(0).alias("p"), F.coalesce("width", F.lit(0)).cast("long").alias("width"),
    )
    body = shared.select("lang", "source", "term", strip, "tile", "tiles", "p", F.lit(0).cast("long").alias("width"))
    # a tile meets every tile of its language once, itself included
    met = heads.unionByName(body).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = met.withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")})
    partial = met.groupBy("lang", "strip", "tile_a", "tile_b").applyInArrow(_compare_strip, "lang string, a string, b string, value long")
    sums = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)
