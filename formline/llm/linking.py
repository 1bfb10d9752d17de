"""Groups of linked items from shared keys, without all pairs of a group.

Items that share a key are candidates. Each item is first checked against one item of each of its keys (the one
that meets most others, which is the original of a group of edited copies), which joins large groups by stars. Components are taken, and only items that share a key
across different components are then checked with each other, so every link between two components is found
while copies of one text never meet as all pairs. Components are exact: links inside a component add nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of ``edges`` (a, b), itself included.

    Parents only ever fall: each round hooks ids and their parents to the smallest grandparent among their
    neighbours, and shortens the paths. A round is written, so lineage and lost executors cost nothing.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    parents = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("p")))
    total = parents.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        above = parents.select(F.col("id").alias("p"), F.col("p").alias("g"))
        known = parents.join(above, "p").select("id", "p", "g")
        least = both.join(known.select(F.col("id").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("g"))
        hooked = parents.join(least, parents["id"] == least["a"]).select(F.explode(F.array("id", "p")).alias("id"), F.col("g").alias("p"))
        shorter = known.select("id", F.least("p", "g").alias("p"))
        parents = cut(hooked.unionByName(shorter).groupBy("id").agg(F.min("p").alias("p")))
        now = parents.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    return parents.select("id", F.col("p").alias("component"))


def linked_groups(
    keyed: DataFrame, payload: list[str], may_link: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(a, b) links that connect the same groups as all links do.

    keyed: rows (key, id, payload...) of long keys and ids; a row may repeat. may_link: filter on a pair of rows
    with one key, given the prefixes of both sides' payload columns; it must hold for at least one common key of
    every linked pair. verify: keeps the linked ones of distinct pairs (a, b).
    """
    # one shuffle serves both the counts and the join: they read the same columns of it
    dealt = keyed.repartition("key")
    shared = dealt.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("met"), *[F.max(c).alias(f"read_{c}") for c in payload])
    shared = shared.filter(" and ".join(["low < high", *[f"(read_{c} is null or read_{c} is not null)" for c in payload]])).select("key", "met")
    dense = cut(dealt.join(shared.hint("shuffle_hash"), "key"))
    own = [F.col(c).alias(f"b_{c}") for c in payload]
    # a key of two rows is one pair; only larger ones have a hub, and pairs left to try
    two, large = dense.filter("met = 2"), dense.filter("met > 2")
    one, other = (two.select("key", F.col("id").alias(v), *[F.col(c).alias(f"{side}{c}") for c in payload]) for v, side in (("x", "a_"), ("y", "b_")))
    degrees = large.groupBy("id").agg(F.sum("met").alias("degree"))
    hub = F.max(F.struct("degree", "id", *payload)).alias("hub")
    hubs = large.join(degrees, "id").groupBy("key").agg(hub).select("key", F.col("hub.id").alias("x"), *[F.col(f"hub.{c}").alias(f"a_{c}") for c in payload])
    spokes = large.select("key", F.col("id").alias("y"), *own).join(hubs, "key").filter((F.col("x") != F.col("y")) & may_link("a_", "b_"))
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    star = spokes.select(*pair).unionByName(one.join(other, "key").filter((F.col("x") < F.col("y")) & may_link("a_", "b_")).select(*pair))
    tried = cut(star.distinct())
    first = cut(verify(tried))
    group = components(first).withColumnRenamed("component", "c")
    rows = large.select("key", "id", *payload).join(group, "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    open_rows = cut(rows.join(mixed, "key").distinct())
    sizes = open_rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"))
    marked = cut(open_rows.join(main, "key"))
    left = marked.filter("c != main").select("key", F.col("id").alias("x"), F.col("c").alias("x_c"), *[F.col(c).alias(f"a_{c}") for c in payload])
    right = marked.select("key", F.col("id").alias("y"), F.col("c").alias("y_c"), F.col("main"), *own)
    across = (F.col("x_c") != F.col("y_c")) & ((F.col("y_c") == F.col("main")) | (F.col("x") < F.col("y")))
    pairs = left.join(right, "key").filter(across & may_link("a_", "b_"))
    fresh = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return first.unionByName(verify(cut(fresh)))
