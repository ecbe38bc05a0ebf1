"""Graph, overlay, merge and keyed-state queries over the ontology tables.

The tables hold no overlays, so one is made by rule: an edge whose id leaves 0
of 10 is deleted, 1 reversed, 2 valid with its raw relation; a node whose id
leaves 0 of 7 has its raw type in upper case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.operators import graph as G
from normlake.operators import state as M
from normlake.plans.registry import Registry, values_sql
from normlake.plans.runtime import table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql
add = registry.add

HOPS = 2


def nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ontology_nodes").select("id", "context_id", "label", "entity_type", "raw_entity_type", "description")


def edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ontology_edges").select("id", "context_id", "source_id", "target_id", "relation_type", "raw_relation_type").distinct()


def types(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).where("id % 7 = 0").select(F.col("id").alias("node_id"), F.upper("raw_entity_type").alias("resolved_type"))


def verdicts(s: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("id") % 10 == 0, "deleted").when(F.col("id") % 10 == 1, "reversed").otherwise("valid")
    resolved = F.when(F.col("id") % 10 == 2, F.col("raw_relation_type"))
    return edges(s, d).where("id % 10 < 3").select(F.col("id").alias("edge_id"), v.alias("verdict"), resolved.alias("resolved_relation_type"))


_E = "(SELECT DISTINCT id, context_id, source_id, target_id, relation_type, raw_relation_type FROM ontology_edges)"
_N = "(SELECT id, context_id, label, description, CASE WHEN id % 7 = 0 THEN coalesce(upper(raw_entity_type), raw_entity_type) ELSE raw_entity_type END AS shown_type FROM ontology_nodes)"
_LENS = f"""(SELECT id, context_id, CASE WHEN id % 10 = 1 THEN target_id ELSE source_id END AS source_id, CASE WHEN id % 10 = 1 THEN source_id ELSE target_id END AS target_id,
CASE WHEN id % 10 = 2 THEN coalesce(raw_relation_type, relation_type) ELSE relation_type END AS relation FROM {_E} WHERE id % 10 <> 0)"""


@add("g6_lens_nodes", f"SELECT id, shown_type FROM {_N}")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.lens_nodes(nodes(s, d), types(s, d)).select("id", "shown_type")


@add("g7_lens_edges", f"SELECT id, context_id, source_id, target_id, relation FROM {_LENS}")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.lens_edges(edges(s, d), verdicts(s, d))


@add("f6_not_deleted", f"SELECT id FROM {_E} WHERE id % 10 <> 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.lens_edges(edges(s, d), verdicts(s, d)).select("id")


@add("a4_deleted_relations", f"SELECT s.shown_type AS source_type, e.relation_type, t.shown_type AS target_type, count(*) AS n FROM {_E} e JOIN {_N} s ON s.id = e.source_id JOIN {_N} t ON t.id = e.target_id WHERE e.id % 10 = 0 GROUP BY 1, 2, 3 HAVING count(*) > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.deleted_relation_counts(nodes(s, d), edges(s, d), verdicts(s, d), types(s, d), 0)


@add("f13_node_lines", f"SELECT id, coalesce(label, '') || ' (' || coalesce(shown_type, '') || '): ' || coalesce(description, '') AS line FROM {_N}")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.described_nodes(G.lens_nodes(nodes(s, d), types(s, d)))


_BALL = f"""b AS (WITH RECURSIVE u AS (SELECT source_id AS a, target_id AS b FROM {_LENS} UNION SELECT target_id, source_id FROM {_LENS}),
r AS (SELECT id AS seed, id AS node_id, 0 AS hop FROM ontology_nodes WHERE id % 100 = 0 UNION SELECT r.seed, u.b, r.hop + 1 FROM r JOIN u ON u.a = r.node_id WHERE r.hop < {HOPS} AND u.b IS NOT NULL)
SELECT seed, node_id, min(hop)::BIGINT AS hop FROM r GROUP BY 1, 2)"""


def _ball(s: SparkSession, d: str) -> DataFrame:
    seeds = nodes(s, d).where("id % 100 = 0").select(F.col("id").alias("seed"))
    return G.neighbourhood(seeds, G.lens_edges(edges(s, d), verdicts(s, d)), HOPS)


@add("g2_hops", f"WITH {_BALL} SELECT seed, node_id, hop FROM b")
def _(s: SparkSession, d: str) -> DataFrame:
    return _ball(s, d).select("seed", "node_id", F.col("hop").cast("long").alias("hop"))


@add("j13_induced_edges", f"WITH {_BALL} SELECT x.seed, e.id FROM {_LENS} e JOIN b x ON x.node_id = e.source_id JOIN b y ON y.node_id = e.target_id AND y.seed = x.seed")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.induced(G.lens_edges(edges(s, d), verdicts(s, d)), _ball(s, d)).select("seed", "id")


@add(
    "g3_graph_context",
    f"""WITH {_BALL}, l AS (SELECT x.seed, e.id, s.label || ' -[' || e.relation || ']-> ' || t.label AS line FROM {_LENS} e JOIN b x ON x.node_id = e.source_id JOIN b y ON y.node_id = e.target_id AND y.seed = x.seed
    JOIN ontology_nodes s ON s.id = e.source_id JOIN ontology_nodes t ON t.id = e.target_id)
    SELECT seed, string_agg(line, '; ' ORDER BY id) AS lines FROM l WHERE line IS NOT NULL GROUP BY seed""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    seen = G.lens_edges(edges(s, d), verdicts(s, d))
    inside = G.induced(seen, _ball(s, d)).select("seed", "id")
    lines = inside.join(G.described_edges(seen, nodes(s, d)), "id").where("line is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "; ")
    return lines.groupBy("seed").agg(joined.alias("lines"))


_PLAIN_VECTOR = "vector_blob IS NOT NULL AND len(vector_blob) = 64 AND list_bool_and(list_transform(vector_blob, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vector_blob, lambda x: x <> 0))"


@add(
    "g1_node_search",
    f"""WITH v AS (SELECT id, context_id, vector_blob::DOUBLE[] AS vec FROM ontology_nodes WHERE {_PLAIN_VECTOR}),
    p AS (SELECT q.id AS query_id, v.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(v.vec, q.vec), 9) DESC, v.id) AS rank FROM v q JOIN v ON v.context_id = q.context_id WHERE q.id % 100 = 0)
    SELECT query_id, id, rank FROM p WHERE rank <= 5""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    from normlake.operators.retrieval import batch_search

    good = "vector_blob is not null and size(vector_blob) = 64 and forall(vector_blob, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(vector_blob, x -> x <> 0)"
    v = table(s, d, "ontology_nodes").where(good).select("id", F.col("context_id").alias("space"), F.col("vector_blob").alias("vec"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "space", F.col("vec").alias("qvec"))
    return batch_search(q, v, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


# Retrieval from query vectors. The queries are the vectors of nodes whose id is divisible by 100; a context's
# model is the parity of its number, and a query asks its own model.

_GOOD = "vector_blob is not null and size(vector_blob) = 64 and forall(vector_blob, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(vector_blob, x -> x <> 0)"


def node_vectors(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "ontology_nodes").where(_GOOD).select("id", "context_id", (F.col("context_id") % 2).alias("space"), F.col("vector_blob").alias("vec"))
    return v.dropDuplicates(["id"])


def node_queries(s: SparkSession, d: str) -> DataFrame:
    return node_vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "space", F.col("vec").alias("qvec"))


def _seeded_sql(per: str, k: int) -> str:
    """Lines of nodes and edges within one hop of the k best nodes a query and context or model."""
    return f"""WITH RECURSIVE v AS (SELECT id, any_value(context_id) AS context_id, any_value(context_id) % 2 AS space, any_value(vector_blob)::DOUBLE[] AS vec FROM ontology_nodes WHERE {_PLAIN_VECTOR} GROUP BY id),
    p AS (SELECT q.id AS seed, v.id AS node_id, row_number() OVER (PARTITION BY q.id, v.{per} ORDER BY round(list_cosine_similarity(v.vec, q.vec), 9) DESC, v.id) AS rank FROM v q JOIN v ON v.space = q.space WHERE q.id % 100 = 0),
    u AS (SELECT source_id AS a, target_id AS b FROM {_LENS} UNION SELECT target_id, source_id FROM {_LENS}),
    m AS (SELECT seed, node_id FROM p WHERE rank <= {k} UNION SELECT p.seed, u.b FROM p JOIN u ON u.a = p.node_id WHERE rank <= {k} AND u.b IS NOT NULL),
    n AS (SELECT DISTINCT id, coalesce(label, '') || ' (' || coalesce(shown_type, '') || '): ' || coalesce(description, '') AS line FROM {_N}),
    e AS (SELECT e.id, source_id, target_id, s.label || ' -[' || relation || ']-> ' || t.label AS line FROM {_LENS} e JOIN ontology_nodes s ON s.id = source_id JOIN ontology_nodes t ON t.id = target_id)
    SELECT DISTINCT seed, 'node' AS kind, id, line FROM m JOIN n ON n.id = m.node_id
    UNION ALL SELECT DISTINCT x.seed, 'edge', e.id, e.line FROM e JOIN m x ON x.node_id = e.source_id JOIN m y ON y.node_id = e.target_id AND y.seed = x.seed WHERE e.line IS NOT NULL"""


def _graph_of_queries(s: SparkSession, d: str, k: int, per_context: bool) -> DataFrame:
    seeds = G.seed_nodes(node_queries(s, d), node_vectors(s, d), k, per_context)
    shown = G.lens_nodes(nodes(s, d), types(s, d))
    return G.graph_context(seeds, shown, G.lens_edges(edges(s, d), verdicts(s, d)), 1).distinct()


@add("g3_graph_retrieval", _seeded_sql("context_id", 1))
def _(s: SparkSession, d: str) -> DataFrame:
    """The nearest node of every context of the query's model, and what is one hop around them, as the lens shows it."""
    return _graph_of_queries(s, d, 1, True)


@add("g4_graph_retrieval_batch", _seeded_sql("space", 5))
def _(s: SparkSession, d: str) -> DataFrame:
    """The five nearest nodes of the query's model, whatever their contexts, and what is one hop around them."""
    return _graph_of_queries(s, d, 5, False)


#: Communities over the recorded ones: the context and vector of the smallest member, a lens by number, and the active
#: lens of a context by number.
_LENSES = "CASE community_id % 3 WHEN 0 THEN NULL ELSE community_id % 3 END"


@add(
    "g5_community_search",
    f"""WITH v AS (SELECT id, any_value(context_id) AS context_id, any_value(vector_blob)::DOUBLE[] AS vec FROM ontology_nodes WHERE {_PLAIN_VECTOR} GROUP BY id),
    c AS (SELECT community_id AS id, min(node_id) AS node_id, count(DISTINCT node_id) AS n FROM ontology_community_members GROUP BY 1),
    o AS (SELECT c.id, v.context_id, v.context_id % 2 AS space, {_LENSES.replace("community_id", "c.id")} AS lens_id, v.vec, 'community ' || c.id || ': ' || c.n || ' members' AS line FROM c JOIN v ON v.id = c.node_id),
    p AS (SELECT q.id AS seed, o.id, o.line, row_number() OVER (PARTITION BY q.id, o.context_id ORDER BY round(list_cosine_similarity(o.vec, q.vec), 9) DESC, o.id) AS rank
      FROM v q JOIN o ON o.space = q.context_id % 2 WHERE q.id % 100 = 0 AND (o.lens_id IS NULL OR o.lens_id = 1 + o.context_id % 2))
    SELECT seed, id, line FROM p WHERE rank <= 2""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """The two nearest communities of every context of the query's model, under the context's active lens or none."""
    v = node_vectors(s, d)
    members = table(s, d, "ontology_community_members").groupBy(F.col("community_id").alias("id")).agg(F.min("node_id").alias("node_id"), F.countDistinct("node_id").alias("n"))
    lens = F.when(F.col("id") % 3 != 0, F.col("id") % 3)
    placed = members.join(v.withColumnRenamed("id", "node_id"), "node_id").withColumn("lens_id", lens)
    label = F.concat(F.lit("community "), F.col("id").cast("string"))
    found = placed.select("id", "context_id", "space", "lens_id", label.alias("label"), F.concat(F.col("n").cast("string"), F.lit(" members")).alias("summary_text"), "vec")
    contexts = v.select("context_id", (1 + F.col("context_id") % 2).alias("active_lens_id")).distinct()
    return G.community_search(node_queries(s, d), found, contexts, 2)


#: Evidence of edges: every citation supports the edge of its number and the next one with its key.
_EVIDENCE = "(SELECT DISTINCT id + o AS edge_id, chunk_id, ref_key AS evidence FROM chunk_refs, (VALUES (0), (1)) AS t(o))"


def evidence(s: SparkSession, d: str) -> DataFrame:
    refs = table(s, d, "chunk_refs").select("id", "chunk_id", "ref_key").distinct()
    return refs.select(F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("edge_id"), "chunk_id", F.col("ref_key").alias("evidence"))


def _listed_evidence(edges_: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.transform(F.map_entries("evidence"), lambda x: F.struct(x["key"].alias("c"), x["value"].alias("w"))))
    text = F.array_join(F.transform(pairs, lambda x: F.concat(x["c"].cast("string"), F.lit("="), F.coalesce(x["w"], F.lit("")))), ";")
    return edges_.select("id", "context_id", "relation", F.size("evidence").cast("long").alias("n"), text.alias("evidence"))


def _evidence_sql(edges_: str) -> str:
    return f"""WITH w AS (SELECT edge_id, chunk_id, max(evidence) AS words FROM {_EVIDENCE} WHERE chunk_id IS NOT NULL GROUP BY 1, 2)
    SELECT e.id, e.context_id, e.relation, count(w.chunk_id) AS n, coalesce(string_agg(w.chunk_id || '=' || coalesce(w.words, ''), ';' ORDER BY w.chunk_id), '') AS evidence
    FROM {edges_} e LEFT JOIN w ON w.edge_id = e.id GROUP BY 1, 2, 3"""


@add("a8_edge_evidence", _evidence_sql("(SELECT id, context_id, relation_type AS relation FROM ontology_edges GROUP BY ALL)"))
def _(s: SparkSession, d: str) -> DataFrame:
    """The map from chunk to words of every raw edge; empty for edges without evidence."""
    raw = edges(s, d).select("id", "context_id", F.col("relation_type").alias("relation")).distinct()
    return _listed_evidence(G.with_evidence(raw, evidence(s, d)))


@add("j6_lens_edges_with_evidence", _evidence_sql(f"(SELECT DISTINCT id, context_id, relation FROM {_LENS})"))
def _(s: SparkSession, d: str) -> DataFrame:
    """Edges as the lens shows them, each with its evidence."""
    seen = G.lens_edges(edges(s, d), verdicts(s, d)).select("id", "context_id", "relation").distinct()
    return _listed_evidence(G.with_evidence(seen, evidence(s, d)))


@add(
    "j14_natural_key_migration",
    f"""WITH o AS (SELECT id, context_id, source_id, target_id, translate(relation_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM {_E}),
    n AS (SELECT context_id, source_id, target_id, k, min(id) AS edge_id FROM o GROUP BY ALL)
    SELECT DISTINCT n.edge_id, c.chunk_id FROM {_EVIDENCE} c JOIN o ON o.id = c.edge_id JOIN n USING (context_id, source_id, target_id, k) WHERE c.chunk_id IS NOT NULL""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Evidence moved to the edge that stays of each natural key."""
    return G.moved_to_natural_key(edges(s, d), evidence(s, d))


@add("g14_merge_log_newest", "SELECT DISTINCT id, context_id, winner_id, loser_id, loser_label, merged_at FROM ontology_merge_log ORDER BY merged_at DESC, id DESC")
def _(s: SparkSession, d: str) -> DataFrame:
    """The merge log, newest first."""
    return table(s, d, "ontology_merge_log").select("id", "context_id", "winner_id", "loser_id", "loser_label", "merged_at").distinct().orderBy(F.desc("merged_at"), F.desc("id"))


@add("m10_merges_of_log")
def _(s: SparkSession, d: str) -> DataFrame:
    """The logged merges executed over all nodes and edges, losers put back first; SQL has no sequential merge, so tested against a plain loop."""
    log = table(s, d, "ontology_merge_log").select("id", "winner_id", "loser_id").distinct()
    alive = table(s, d, "ontology_nodes").select("id").unionByName(log.select(F.col("loser_id").alias("id"))).where("id is not null").distinct()
    done = G.executed_merges(log.withColumnRenamed("id", "seq"), alive)
    _, left = G.merge_nodes(alive, edges(s, d), done)
    return left.select("id", "context_id", "source_id", "target_id", "relation_type")


@add("g9_degree", f"SELECT node_id, count(*) AS degree FROM (SELECT source_id AS node_id FROM {_LENS} UNION ALL SELECT target_id FROM {_LENS}) WHERE node_id IS NOT NULL GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.degrees(G.lens_edges(edges(s, d), verdicts(s, d)))


@add("g10_communities", "SELECT community_id, count(DISTINCT node_id) AS node_count, string_agg(DISTINCT node_id::VARCHAR, ',' ORDER BY node_id) AS members_key FROM (SELECT DISTINCT * FROM ontology_community_members) GROUP BY 1".replace("string_agg(DISTINCT", "string_agg("))
def _(s: SparkSession, d: str) -> DataFrame:
    found = G.communities(table(s, d, "ontology_community_members"))
    return found.select("community_id", F.col("node_count").cast("long").alias("node_count"), "members_key")


@add("g12_verdict_both_ways", "SELECT DISTINCT context_id, id1, id2, identical FROM (SELECT context_id, id1, id2, identical FROM ontology_dedup_cache UNION ALL SELECT context_id, id2, id1, identical FROM ontology_dedup_cache)")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.symmetric(table(s, d, "ontology_dedup_cache").select("context_id", "id1", "id2", "identical"))


@add("g13_cached_types", "SELECT DISTINCT n.raw_entity_type AS raw_type FROM ontology_nodes n JOIN ontology_type_vector_cache c ON c.raw_type = n.raw_entity_type AND c.embedding_model_id = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    cached = table(s, d, "ontology_type_vector_cache").where("embedding_model_id = 1").select("raw_type")
    return nodes(s, d).select(F.col("raw_entity_type").alias("raw_type")).join(cached, "raw_type", "left_semi").distinct()


@add("g14_merge_log", "SELECT winner_id, count(DISTINCT id) AS merged, max(merged_at) AS latest FROM ontology_merge_log GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "ontology_merge_log").groupBy("winner_id").agg(F.countDistinct("id").alias("merged"), F.max("merged_at").alias("latest"))
    return log.orderBy(F.desc("latest"), "winner_id")


@add("g15_natural_key", f"SELECT context_id, source_id, target_id, translate(relation_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k, min(id) AS id FROM {_E} WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2, 3, 4")
def _(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d).where("source_id is not null and target_id is not null")
    return e.groupBy("context_id", "source_id", "target_id", G.fold_ascii(F.col("relation_type")).alias("k")).agg(F.min("id").alias("id"))


def _propagated_sql(rounds: int) -> str:
    """Label propagation, a table a round."""
    steps = [
        f"l{i} AS MATERIALIZED (SELECT u AS node_id, arg_max(community, (n, -community)) AS community FROM (SELECT u, community, count(*) AS n FROM e JOIN l{i - 1} ON node_id = w GROUP BY 1, 2) GROUP BY 1)"
        for i in range(1, rounds + 1)
    ]
    ends = "SELECT source_id AS u, target_id AS w FROM ontology_edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM ontology_edges WHERE source_id <> target_id"
    return f"WITH e AS MATERIALIZED ({ends}), l0 AS MATERIALIZED (SELECT DISTINCT u AS node_id, u AS community FROM e), {', '.join(steps)} SELECT node_id, community FROM l{rounds}"


@add("g16_label_propagation", _propagated_sql(5))
def _(s: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(edges(s, d).where("source_id is not null and target_id is not null"))


# Keyed state


@add("m1_last_write", "SELECT run_id, row_uid, arg_max(status, id) AS status FROM grid_chat_results WHERE row_uid IS NOT NULL GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    changes = table(s, d, "grid_chat_results").where("row_uid is not null").select("run_id", "row_uid", F.col("id").alias("seq"), "status")
    return M.last_write(changes, ["run_id", "row_uid"])


@add("m2_first_write", "SELECT community_id, min(node_id) AS node_id FROM ontology_community_members GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    changes = table(s, d, "ontology_community_members").select("community_id", F.col("node_id").alias("seq"), "node_id")
    return M.first_write(changes, ["community_id"])


@add("m4_coalesce", "SELECT run_id, row_uid, arg_max(error, id) FILTER (WHERE error IS NOT NULL) AS error, arg_max(status, id) AS status FROM grid_chat_results WHERE row_uid IS NOT NULL GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    changes = table(s, d, "grid_chat_results").where("row_uid is not null").select("run_id", "row_uid", F.col("id").alias("seq"), "error", "status")
    return M.last_non_null(changes, ["run_id", "row_uid"], ["error"])


@add("m5_latch", "SELECT context_id, id1, arg_max(id2, id2) AS id2, coalesce(bool_or(identical), false) AS identical FROM ontology_dedup_cache GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    changes = table(s, d, "ontology_dedup_cache").select("context_id", "id1", F.col("id2").alias("seq"), "id2", "identical")
    return M.latch(changes, ["context_id", "id1"], "identical")


@add("m6_counter", "SELECT user_id, count(*) AS attempts, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    changes = table(s, d, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    return M.counted(changes, ["user_id"])


@add("f10_prune", "SELECT DISTINCT id FROM grid_chat_results WHERE run_id IS DISTINCT FROM (SELECT min(run_id) FROM grid_chat_results) OR row_uid IN ('r1', 'r2')")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "grid_chat_results")
    first = rows.agg(F.min("run_id")).first()[0]
    return M.prune(rows, first, ["r1", "r2"]).select("id").distinct()


@add("m9_cascade", "SELECT DISTINCT r.id FROM chunk_refs r WHERE r.chunk_id IS NULL OR r.chunk_id IN (SELECT id FROM chunks WHERE context_id <> 3)")
def _(s: SparkSession, d: str) -> DataFrame:
    left = table(s, d, "chunks").where("context_id <> 3").select("id")
    return M.delete_cascade(table(s, d, "chunk_refs").select("id", "chunk_id"), left, "chunk_id").select("id").distinct()


@add("m11_delete_by_ids", f"SELECT id FROM {_E} WHERE id % 10 <> 0 OR id IS NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    gone = verdicts(s, d).where("verdict = 'deleted'").select(F.col("edge_id").alias("id"))
    return edges(s, d).join(gone, "id", "left_anti").select("id")


@add("m12_inverted", f"SELECT id, target_id AS source_id, source_id AS target_id FROM {_E}")
def _(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).select("id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))


@add("m13_wipe_context", f"SELECT id FROM {_E} WHERE context_id <> 3")
def _(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).where("context_id <> 3").select("id")


#: Nodes 1 to 5; edges (id, source, target, relation); merge requests in order. Expected is what a step-by-step merge leaves.
_MERGED = [(1, 1, 3, "R"), (3, 1, 4, "R")]


@add("m10_merge", values_sql(["id", "source_id", "target_id", "relation_type"], _MERGED))
def _(s: SparkSession, d: str) -> DataFrame:
    n = s.createDataFrame([(i,) for i in range(1, 6)], "id long")
    e = s.createDataFrame([(1, 7, 1, 3, "R"), (2, 7, 2, 3, "r"), (3, 7, 1, 4, "R"), (4, 7, 1, 2, "R")], "id long, context_id long, source_id long, target_id long, relation_type string")
    # The second request's winner is gone when its turn comes.
    request = s.createDataFrame([(1, 1, 2), (2, 2, 5)], "seq long, winner_id long, loser_id long")
    done = G.executed_merges(request, n)
    _, left = G.merge_nodes(n, e, done)
    return left.select("id", "source_id", "target_id", "relation_type")


#: Communities with one vector under lens 1, lens 2 and none; context 7 shows lens 1, context 8 none.
_COMMUNITIES = [(1, 7, 1, "1,2", "A"), (2, 7, 2, "1,2", "B"), (3, 7, None, "1,2", "C"), (4, 8, 1, "3", "D"), (5, 8, None, "3", ""), (6, 8, None, "3", "E")]


def _communities(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_COMMUNITIES, "id long, context_id long, lens_id long, members_key string, summary_text string")


@add("g5_communities_in_view", values_sql(["id"], [(1,), (3,), (5,), (6,)]))
def _(s: SparkSession, d: str) -> DataFrame:
    contexts = s.createDataFrame([(7, 1), (8, None)], "context_id long, active_lens_id long")
    return G.communities_in_view(_communities(s), contexts).select("id")


@add("g11_cached_summary", values_sql(["id", "summary_text"], [(6, "E"), (2, "B")]))
def _(s: SparkSession, d: str) -> DataFrame:
    return G.cached_summary(_communities(s), 8, None, "3").unionByName(G.cached_summary(_communities(s), 7, 2, "1,2"))


@add("g8_raw_view", f"SELECT e.id, e.source_id, e.target_id, coalesce(e.raw_relation_type, e.relation_type) AS relation FROM {_E} e")
def _(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).select("id", "source_id", "target_id", F.coalesce("raw_relation_type", "relation_type").alias("relation"))


@add("m3_settings", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    changes = table(s, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), "value", "event_id")
    return M.last_write(changes, ["user_id", "event_type"])


@add("m8_replaced_members", "SELECT DISTINCT community_id, node_id FROM ontology_community_members WHERE community_id % 2 = 0 UNION ALL SELECT community_id, min(node_id) FROM ontology_community_members WHERE community_id % 2 = 1 GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """The members of odd communities are replaced by their smallest one; the others stay."""
    old = table(s, d, "ontology_community_members").distinct()
    new = old.where("community_id % 2 = 1").groupBy("community_id").agg(F.min("node_id").alias("node_id"))
    return M.replace_children(old, new, "community_id")


@add("g17_nearest_type", f"""WITH t AS (SELECT DISTINCT raw_type, vector::DOUBLE[] AS v FROM ontology_type_vector_cache WHERE embedding_model_id = 1 AND vector IS NOT NULL AND len(vector) = 64 AND list_bool_and(list_transform(vector, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))),
p AS (SELECT a.raw_type, b.raw_type AS profile_type, row_number() OVER (PARTITION BY a.raw_type ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.raw_type) AS n FROM t a JOIN t b ON NOT contains(b.raw_type, '_') WHERE contains(a.raw_type, '_'))
SELECT raw_type, profile_type FROM p WHERE n = 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Raw types (with an underscore) snapped to the nearest profile type (without one)."""
    from normlake.operators.retrieval import batch_search

    good = "vector is not null and size(vector) = 64 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(vector, x -> x <> 0)"
    t = table(s, d, "ontology_type_vector_cache").where("embedding_model_id = 1").where(good).select("raw_type", "vector").distinct()
    raw = t.where("contains(raw_type, '_')").select(F.col("raw_type").alias("query_id"), F.lit(1).alias("space"), F.col("vector").alias("qvec"))
    profile = t.where("not contains(raw_type, '_')").select(F.col("raw_type").alias("id"), F.lit(1).alias("space"), F.col("vector").alias("vec"))
    return batch_search(raw, profile, 1).select(F.col("query_id").alias("raw_type"), F.col("id").alias("profile_type"))
