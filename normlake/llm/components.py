"""Connected components of a graph given as pairs.

Vertices of degree one are stripped and vertices of degree two are spliced out
of their chains (list ranking by independent sets) until little but a core of
higher degree is left. The core is solved by label contraction, and the removed
vertices get their labels back in reverse order through the vertex each was
attached to. Everything stays distributed; each round ends in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.plans.runtime import cut, lookup_join

#: Rounds of stripping at most, and the shrinkage below which the core is solved instead.
MAX_ROUNDS, LEAST_SHRINK = 12, 0.1
#: Label contraction halves the vertices at least every few rounds; running out of rounds is a bug and an error.
MAX_CONTRACTIONS = 64


def _edges(pairs: DataFrame) -> DataFrame:
    """Undirected edges (a < b), each once, without loops and nulls."""
    return pairs.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")


def strip_round(edges: DataFrame, round_no: int) -> tuple[DataFrame, DataFrame]:
    """One round: (v, parent) of the removed vertices, and the edges that remain.

    Removed are vertices of degree one (of a lone pair the larger) and, of the
    vertices of degree two, an independent set: those whose random rank is below
    that of every neighbour that may be removed too. A removed degree-two vertex
    leaves an edge between its neighbours. A hub's row count is its degree, but
    degrees are combined map-side and only low degrees keep their neighbours.
    """
    both = _both(edges)
    low = both.groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.min("w").alias("w1"), F.max("w").alias("w2")).where("d <= 2")
    rank = F.xxhash64("v", F.lit(round_no))
    low = low.withColumn("r", F.struct(rank.alias("h"), F.col("v").alias("v")))
    sides = low.select("v", "r", "w1", "w2", F.explode(F.array_distinct(F.array("w1", "w2"))).alias("w"))
    others = low.select(F.col("v").alias("w"), F.col("r").alias("other"))
    gone = (
        sides.join(others, "w", "left")
        .groupBy("v", "w1", "w2")
        .agg(F.min(F.coalesce(F.col("r") < F.col("other"), F.lit(True))).alias("lowest"))
        .where("lowest")
        .select("v", "w1", "w2")
    )
    gone = cut(gone)
    # A removed vertex has one or two edges, and those are known: they are named and taken out whole, so
    # no join is on the ends, of which a hub has any number.
    lost = gone.select("v", F.explode(F.array_distinct(F.array("w1", "w2"))).alias("w")).select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"))
    fresh = gone.where("w1 < w2").select(F.col("w1").alias("a"), F.col("w2").alias("b"))
    marked = edges.select("a", "b", F.lit(False).alias("out")).unionByName(lost.select("a", "b", F.lit(True).alias("out")))
    marked = marked.unionByName(fresh.select("a", "b", F.lit(False).alias("out")))
    # The edge between two neighbours may be there already; only old edges are taken out, and those end in a removed vertex.
    kept = marked.groupBy("a", "b").agg(F.max("out").alias("out")).where("not out").select("a", "b")
    return gone.select("v", F.col("w1").alias("parent")), cut(kept)


def contract(edges: DataFrame) -> DataFrame:
    """(v, label) of the vertices of a core: each round every vertex points to its smallest neighbour or itself, and the pointers are merged."""
    labels = None
    current = edges
    for _ in range(MAX_CONTRACTIONS):
        if current.isEmpty():
            return labels
        hook = _both(current).groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))
        # Pointers only descend, so the forest has no cycle; each doubling halves its depth.
        while True:
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("g"))
            hook = cut(hook.join(up, "p", "left").select("v", F.coalesce("g", "p").alias("q"), F.col("p")))
            changed = not hook.where("q <> p").isEmpty()
            hook = hook.select("v", F.col("q").alias("p"))
            if not changed:
                break
        if labels is None:
            labels = hook.select("v", F.col("p").alias("label"))
        else:
            step = hook.select(F.col("v").alias("label"), F.col("p").alias("next"))
            # One giant component is one label: large ones are joined apart.
            labels = cut(lookup_join(labels, step, "label").select("v", F.coalesce("next", "label").alias("label")))
        step_a = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        step_b = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        current = lookup_join(lookup_join(current, step_a, "a"), step_b, "b")
        current = cut(_edges(current.select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
    raise RuntimeError(f"the core is not solved after {MAX_CONTRACTIONS} contractions")


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(record_id, group_id) of every record in a group of two or more; group_id is its smallest record.

    Pairs with a null end or with itself link nothing; repeated pairs and both
    orientations count once; an empty input gives no rows.
    """
    edges = cut(_edges(pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    vertices = edges.select(F.explode(F.array("a", "b")).alias("v"))
    removed: list[DataFrame] = []
    n = edges.count()
    for i in range(MAX_ROUNDS):
        if n == 0:
            break
        gone, edges = strip_round(edges, i)
        removed.append(gone)
        before, n = n, edges.count()
        if n > before * (1 - LEAST_SHRINK):
            break
    labels = contract(edges) if n else None
    for gone in reversed(removed):
        # A parent that no later step labelled stands for its own group.
        named = gone.select("v", F.col("parent").alias("u"))
        if labels is None:
            labels = named.select("v", F.col("u").alias("label")).unionByName(named.select(F.col("u").alias("v"), F.col("u").alias("label")).distinct())
            continue
        known = labels.select(F.col("v").alias("u"), "label")
        # Any number of removed vertices may hang on one hub.
        got = lookup_join(named, known, "u").select("v", "u", F.coalesce("label", "u").alias("label"), F.col("label").isNull().alias("root"))
        roots = got.where("root").select(F.col("u").alias("v"), F.col("u").alias("label")).distinct()
        labels = labels.unionByName(got.select("v", "label")).unionByName(roots)
        labels = cut(labels)
    if labels is None:
        return vertices.select(F.col("v").alias("record_id"), F.col("v").alias("group_id"))
    # Names of groups are arbitrary vertices; the smallest member replaces them. A group may hold
    # any share of the records: large ones are joined apart.
    least = labels.groupBy("label").agg(F.min("v").alias("group_id"))
    return lookup_join(labels, least, "label").select(F.col("v").alias("record_id"), "group_id")
