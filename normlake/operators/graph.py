"""Graph operators over (nodes, edges) tables with switchable overlays ("lenses").

An overlay never changes the raw tables: it resolves node types, and it marks
edges as valid, reversed or deleted at reading time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.operators.retrieval import batch_search
from normlake.plans.runtime import cut

#: Hops after which the lineage of an expansion is cut.
CUT_EVERY = 3


def fold_ascii(c: Column) -> Column:
    """Lower case of ASCII letters only, as the key of a case-insensitive natural key."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lens_nodes(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Nodes with `shown_type`: the overlay's type, else the raw one. types(node_id, resolved_type) is unique by node."""
    return nodes.join(types.withColumnRenamed("node_id", "id"), "id", "left").withColumn("shown_type", F.coalesce("resolved_type", "raw_entity_type"))


def lens_edges(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges as an overlay shows them: deleted ones out, reversed ones swapped, relations resolved.

    verdicts(edge_id, verdict, resolved_relation_type) is unique by edge; an edge without one is valid.
    """
    seen = edges.join(verdicts.withColumnRenamed("edge_id", "id"), "id", "left")
    swap = F.col("verdict").eqNullSafe("reversed")
    return seen.where(F.coalesce("verdict", F.lit("valid")) != "deleted").select(
        "id",
        "context_id",
        F.when(swap, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"),
        F.when(swap, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"),
        F.coalesce("resolved_relation_type", "relation_type").alias("relation"),
    )


def deleted_relation_counts(nodes: DataFrame, edges: DataFrame, verdicts: DataFrame, types: DataFrame, min_count: int) -> DataFrame:
    """How often each (source type, relation, target type) was deleted, above min_count (strictly)."""
    gone = edges.join(verdicts.where("verdict = 'deleted'").select(F.col("edge_id").alias("id")), "id", "left_semi")
    shown = lens_nodes(nodes, types).select("id", "shown_type")
    source = shown.select(F.col("id").alias("source_id"), F.col("shown_type").alias("source_type"))
    target = shown.select(F.col("id").alias("target_id"), F.col("shown_type").alias("target_type"))
    counted = gone.join(source, "source_id").join(target, "target_id").groupBy("source_type", "relation_type", "target_type")
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_count)


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree): a loop counts twice. One pass, combined map-side."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).where("node_id is not null")
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node_id, hop) of all nodes within `hops` undirected steps of each seed, the seed itself at hop 0.

    seeds(seed) start at the node of that id; seeds(seed, node_id) may give a seed,
    as a query, any number of nodes to start from, and the least hop counts. The
    walk follows edges wherever they lead, whatever the contexts of the seeds.

    The frontier is expanded a hop at a time and nodes seen before are taken
    out, so work follows the ball and not the number of walks.
    """
    both = edges.where("source_id is not null and target_id is not null").select(
        F.explode(F.array(F.struct(F.col("source_id").alias("u"), F.col("target_id").alias("w")), F.struct(F.col("target_id").alias("u"), F.col("source_id").alias("w")))).alias("e")
    )
    both = both.select("e.u", "e.w").distinct()
    front = seeds.select("seed", F.col("node_id" if "node_id" in seeds.columns else "seed").alias("node_id")).distinct()
    ball = front.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        step = front.join(both, front["node_id"] == both["u"]).select("seed", F.col("w").alias("node_id")).distinct()
        front = step.join(ball.select("seed", "node_id"), ["seed", "node_id"], "left_anti")
        if hop % CUT_EVERY == 0:
            front = cut(front)
        ball = ball.unionByName(front.withColumn("hop", F.lit(hop)))
        if hop % CUT_EVERY == 0:
            ball = cut(ball)
    return ball


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of which both ends are among members(seed, node_id), per seed."""
    a = members.select("seed", F.col("node_id").alias("source_id"))
    b = members.select("seed", F.col("node_id").alias("target_id"))
    return edges.join(a, "source_id").join(b, ["seed", "target_id"])


def described_nodes(nodes: DataFrame) -> DataFrame:
    """(id, line): 'label (type): description'."""
    return nodes.select("id", F.concat(F.coalesce("label", F.lit("")), F.lit(" ("), F.coalesce("shown_type", F.lit("")), F.lit("): "), F.coalesce("description", F.lit(""))).alias("line"))


def described_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, line): 'source -[relation]-> target', for edges whose ends exist."""
    s = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("source"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("target"))
    return edges.join(s, "source_id").join(t, "target_id").select("id", F.concat("source", F.lit(" -["), "relation", F.lit("]-> "), "target").alias("line"))


def fold_merges(pairs: Iterable[tuple[int, int]], alive: set[int]) -> list[tuple[int, int]]:
    """The pairs (winner, loser) of a request that are executed, in order: both must still be alive."""
    done = []
    for winner, loser in pairs:
        if winner != loser and winner in alive and loser in alive:
            alive.discard(loser)
            done.append((winner, loser))
    return done


def executed_merges(request: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs request(seq, winner_id, loser_id) that a sequential merge executes, for requests of any size.

    A pair is skipped if an end does not exist or was merged away by an earlier
    executed pair. Pairs are settled in rounds: the first open pair of both its
    ends is certain; those that it makes void fall. Each round settles at least
    the earliest open pair of every component.
    """
    alive = nodes.select("id").distinct()
    open_ = request.where("winner_id <> loser_id").join(alive.withColumnRenamed("id", "winner_id"), "winner_id", "left_semi")
    open_ = cut(open_.join(alive.withColumnRenamed("id", "loser_id"), "loser_id", "left_semi").select("seq", "winner_id", "loser_id"))
    done = None
    while not open_.isEmpty():
        ends = open_.select("seq", F.explode(F.array("winner_id", "loser_id")).alias("id"))
        first = ends.groupBy("id").agg(F.min("seq").alias("first"))
        w = first.select(F.col("id").alias("winner_id"), F.col("first").alias("fw"))
        l = first.select(F.col("id").alias("loser_id"), F.col("first").alias("fl"))
        marked = cut(open_.join(w, "winner_id").join(l, "loser_id"))
        now = marked.where("seq = fw and seq = fl").select("seq", "winner_id", "loser_id")
        done = now if done is None else done.unionByName(now)
        dead = now.select(F.col("loser_id").alias("x"))
        rest = marked.where("not (seq = fw and seq = fl)").select("seq", "winner_id", "loser_id")
        rest = rest.join(dead.withColumnRenamed("x", "winner_id"), "winner_id", "left_anti").join(dead.withColumnRenamed("x", "loser_id"), "loser_id", "left_anti")
        open_ = cut(rest)
    return done if done is not None else open_


def merge_nodes(nodes: DataFrame, edges: DataFrame, executed: DataFrame, rounds: int = 32) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after executed(winner_id, loser_id): losers gone, ends moved, doubles and loops of merged nodes collapsed.

    Of edges that become equal (ends, relation without ASCII case) the smallest id stays.
    """
    moved = executed.select(F.col("loser_id").alias("old"), F.col("winner_id").alias("new"))
    # A winner may be merged later itself: follow the pointers to their end.
    for _ in range(rounds):
        further = moved.select(F.col("old").alias("new"), F.col("new").alias("end"))
        step = cut(moved.join(further, "new", "left").select("old", F.coalesce("end", "new").alias("new"), F.col("end").isNotNull().alias("changed")))
        moved = step.select("old", "new")
        if step.where("changed").isEmpty():
            break
    kept = nodes.join(executed.select(F.col("loser_id").alias("id")), "id", "left_anti")
    for end in ("source_id", "target_id"):
        to = moved.select(F.col("old").alias(end), F.col("new").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    merged = moved.select(F.col("new").alias("source_id")).distinct().withColumn("touched", F.lit(True))
    loose = edges.join(merged, "source_id", "left").where("not (touched is not null and source_id <=> target_id)").drop("touched")
    order = Window.partitionBy("context_id", "source_id", "target_id", fold_ascii(F.col("relation_type"))).orderBy("id")
    return kept, loose.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def communities(members: DataFrame) -> DataFrame:
    """(community_id, node_count, members_key): distinct members in order, joined by commas."""
    ids = F.sort_array(F.collect_set("node_id"))
    return members.groupBy("community_id").agg(F.size(ids).alias("node_count"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("members_key"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node_id, community): each round every node takes the most frequent label around it, ties the smallest."""
    both = edges.where("source_id <> target_id").select(F.explode(F.array(F.struct(F.col("source_id").alias("u"), F.col("target_id").alias("w")), F.struct(F.col("target_id").alias("u"), F.col("source_id").alias("w")))).alias("e")).select("e.u", "e.w").distinct()
    both = cut(both)
    labels = both.select(F.col("u").alias("node_id"), F.col("u").alias("community")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node_id", "w"), "w").groupBy("u", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("u").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community"))
        labels = cut(best.withColumnRenamed("u", "node_id"))
    return labels


def seed_nodes(queries: DataFrame, vectors: DataFrame, k: int, per_context: bool = True) -> DataFrame:
    """(seed, node_id): the k nodes nearest to each of queries(query_id, space, qvec), in each context or in all of a model.

    vectors(id, space, context_id, vec); space is the embedding model, and a query
    meets vectors of its own model only. One query asks every context for its k
    best; a batch of queries asks every model.
    """
    by = ("space", "context_id") if per_context else ("space",)
    found = batch_search(queries, vectors, k, by=by)
    return found.select(F.col("query_id").alias("seed"), F.col("id").alias("node_id")).distinct()


def graph_context(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, kind, id, line): the nodes within `hops` of each seed's nodes and the edges between them, as text.

    nodes(id, label, shown_type, description) and edges(id, source_id, target_id,
    relation) are as the lens shows them. Edges without both ends among the
    nodes, or without a label at one, have no line.
    """
    ball = cut(neighbourhood(seeds, edges, hops))
    own = ball.select("seed", F.col("node_id").alias("id")).join(described_nodes(nodes), "id")
    inside = induced(edges, ball).select("seed", "id").join(described_edges(edges, nodes), "id").where("line is not null")
    return own.select("seed", F.lit("node").alias("kind"), "id", "line").unionByName(inside.select("seed", F.lit("edge").alias("kind"), "id", "line"))


def community_search(queries: DataFrame, found: DataFrame, contexts: DataFrame, k: int, per_context: bool = True) -> DataFrame:
    """(seed, id, line): the k communities nearest to each query in each context, or each model, as 'label: summary'.

    found(id, context_id, space, lens_id, label, summary_text, vec) is first
    limited to those of the context's active lens or of none, see
    communities_in_view; one without a vector is never found.
    """
    seen = communities_in_view(found.where("vec is not null"), contexts)
    by = ("space", "context_id") if per_context else ("space",)
    best = batch_search(queries, seen.select("id", "space", "context_id", "vec"), k, by=by)
    line = F.concat(F.coalesce("label", F.lit("")), F.lit(": "), F.coalesce("summary_text", F.lit("")))
    return best.select(F.col("query_id").alias("seed"), "id").join(seen.select("id", line.alias("line")), "id").select("seed", "id", "line")


def with_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges with `evidence`, a map from chunk to the words that support the edge; empty where there is none.

    evidence(edge_id, chunk_id, evidence): null chunks are dropped, words may be
    null, and of several rows of an edge and chunk the greatest words count. The
    map of an edge is made by grouping by edge, never of more than its chunks.
    """
    each = evidence.where("edge_id is not null and chunk_id is not null").groupBy("edge_id", "chunk_id").agg(F.max("evidence").alias("words"))
    maps = each.groupBy(F.col("edge_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "words"))).alias("evidence"))
    kind = dict(maps.dtypes)["evidence"]
    return edges.join(maps, "id", "left").withColumn("evidence", F.coalesce("evidence", F.create_map().cast(kind)))


def moved_to_natural_key(old: DataFrame, evidence: DataFrame) -> DataFrame:
    """(edge_id, chunk_id) after edges of one natural key became one: evidence of any of them goes to the smallest id.

    The key is context, both ends and the relation without ASCII case; edges with
    a null in it have no place in the new table. Every pair comes out once.
    """
    keyed = old.where("context_id is not null and source_id is not null and target_id is not null and relation_type is not null")
    key = ["context_id", "source_id", "target_id", "k"]
    keyed = keyed.select("id", "context_id", "source_id", "target_id", fold_ascii(F.col("relation_type")).alias("k"))
    new = keyed.groupBy(*key).agg(F.min("id").alias("edge_id"))
    return evidence.where("chunk_id is not null").join(keyed, evidence["edge_id"] == keyed["id"]).drop("edge_id").join(new, key).select("edge_id", "chunk_id").distinct()


def communities_in_view(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """Communities of the context's active lens or of none; found(id, context_id, lens_id), contexts(context_id, active_lens_id)."""
    seen = found.join(contexts, "context_id")
    return seen.where(F.col("lens_id").isNull() | (F.col("lens_id") == F.col("active_lens_id"))).drop("active_lens_id")


def cached_summary(found: DataFrame, context_id: int, lens_id: int | None, members_key: str) -> DataFrame:
    """The summary of a community with the same members under the same lens (null is a lens of its own); the smallest id of several."""
    same = (F.col("context_id") == context_id) & F.col("lens_id").eqNullSafe(F.lit(lens_id)) & (F.col("members_key") == members_key)
    return found.where(same & (F.coalesce("summary_text", F.lit("")) != "")).orderBy("id").limit(1).select("id", "summary_text")
