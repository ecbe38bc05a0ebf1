"""Scans, filters, joins, aggregations, windows and set operations over the tables.

Rows of a table with one id are one row; `once` says so where it matters.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normlake.functions.dates import with_age
from normlake.functions.text import estimated_tokens
from normlake.operators.graph import degrees, fold_ascii
from normlake.operators.state import keep_last_n
from normlake.plans.registry import Registry
from normlake.plans.runtime import table
from normlake.sources.database import Database

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql
add = registry.add


def once(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["id"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks")


# Scans


@add("sc2_list_chunks", "SELECT id, document_id, chunk_index FROM chunks WHERE context_id = 3 AND NOT is_omitted ORDER BY document_id, chunk_index")
def _(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).where("context_id = 3 and not is_omitted").select("id", "document_id", "chunk_index").orderBy("document_id", "chunk_index")


@add("sc3_chunk_by_id", "SELECT id, document_id, text FROM chunks WHERE id = 17")
def _(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).where("id = 17").select("id", "document_id", "text").limit(1)


@add("sc4_chunks_by_ids", "SELECT id, context_id FROM chunks WHERE id IN (SELECT DISTINCT chunk_id FROM chunk_refs)")
def _(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "chunk_refs").select(F.col("chunk_id").alias("id")).distinct()
    return chunks(s, d).join(ids, "id", "left_semi").select("id", "context_id")


@add("sc5_context_vectors", "SELECT id, len(vector_blob)::BIGINT AS size FROM ontology_nodes WHERE context_id = 3 AND vector_blob IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ontology_nodes").where("context_id = 3 and vector_blob is not null").select("id", F.size("vector_blob").cast("long").alias("size"))


@add("sc6_chunk_by_place", "SELECT id, text FROM chunks WHERE document_id = 5 AND chunk_index = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).where("document_id = 5 and chunk_index = 1").select("id", "text")


# Filters


@add("f1_kept_chunks", "SELECT context_id, count(*) AS n FROM chunks WHERE NOT is_omitted GROUP BY context_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).where("not is_omitted").groupBy("context_id").agg(F.count(F.lit(1)).alias("n"))


@add("f2_in_list", "SELECT id FROM chunks WHERE document_id IN (1, 2, 3, 5, 8, 13)")
def _(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).where(F.col("document_id").isin(1, 2, 3, 5, 8, 13)).select("id")


@add("f3_empty_scope", "SELECT id FROM chunks WHERE false")
def _(s: SparkSession, d: str) -> DataFrame:
    from normlake.operators.retrieval import scoped

    return scoped(chunks(s, d), []).select("id")


@add("f4_contains", "SELECT id FROM chunks WHERE text ILIKE '%unverzüglich%'")
def _(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).where(F.col("text").ilike("%unverzüglich%")).select("id")


@add("f5_null_safe", "SELECT DISTINCT a.id FROM ontology_nodes a WHERE a.raw_entity_type IS NOT DISTINCT FROM a.entity_type")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ontology_nodes").where(F.col("raw_entity_type").eqNullSafe(F.col("entity_type"))).select("id").distinct()


@add("f7_worklist", "SELECT DISTINCT id, status FROM grid_chat_results WHERE status IN ('queued', 'retrieving', 'llm', 'error')")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "grid_chat_results").where(F.col("status").isin("queued", "retrieving", "llm", "error")).select("id", "status").distinct()


#: A page is a number or a string with a leading number; broken JSON has none.
PAGE_KEYS = ("page", "Page", "seite", "Seite")
_PAGES = " OR ".join(f"coalesce(try_cast(nullif(regexp_extract(CASE WHEN json_valid(metadata) THEN metadata ->> '$.{k}' END, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), CASE WHEN json_valid(metadata) AND (metadata ->> '$.{k}') IS NOT NULL THEN 0 END) = 4" for k in PAGE_KEYS)


#: Pages by rule, since the tables have none: under any of the keys, as number or text, with blanks or letters around, or in broken JSON.
_PAGED = """(SELECT id, CASE id % 6 WHEN 0 THEN '{"page": ' || chunk_index || '}' WHEN 1 THEN '{"Page": "' || chunk_index || 'a"}' WHEN 2 THEN '{"seite": " ' || chunk_index || ' "}'
 WHEN 3 THEN '{"page": ' || chunk_index WHEN 4 THEN '{"Seite": "x' || chunk_index || '"}' END AS metadata FROM chunks)"""


def _by_page(rows: DataFrame, page: int) -> DataFrame:
    """Rows whose metadata name the page under any of PAGE_KEYS; a text counts with its leading number, or as 0."""
    hit = F.lit(False)
    for k in PAGE_KEYS:
        value = F.get_json_object("metadata", f"$.{k}")
        number = F.regexp_extract(value, r"^\s*([+-]?\d+)", 1).try_cast("long")
        hit = hit | F.coalesce(F.when(value.isNotNull(), F.coalesce(number, F.lit(0))) == page, F.lit(False))
    return rows.where(hit)


def _paged(s: SparkSession, d: str) -> DataFrame:
    at, rest = F.col("chunk_index").cast("string"), F.col("id") % 6
    made = F.when(rest == 0, F.concat(F.lit('{"page": '), at, F.lit("}"))).when(rest == 1, F.concat(F.lit('{"Page": "'), at, F.lit('a"}'))).when(rest == 2, F.concat(F.lit('{"seite": " '), at, F.lit(' "}')))
    made = made.when(rest == 3, F.concat(F.lit('{"page": '), at)).when(rest == 4, F.concat(F.lit('{"Seite": "x'), at, F.lit('"}')))
    return chunks(s, d).select("id", made.alias("metadata"))


@add("f8_by_page", f"SELECT id FROM {_PAGED} WHERE {_PAGES.replace(') = 4', ') = 1')} UNION ALL SELECT -id FROM {_PAGED} WHERE {_PAGES.replace(') = 4', ') = 0')}")
def _(s: SparkSession, d: str) -> DataFrame:
    """The chunks of page 1, and under negative ids those of page 0, where everything without a number falls."""
    rows = _paged(s, d)
    return _by_page(rows, 1).select("id").unionByName(_by_page(rows, 0).select((-F.col("id")).alias("id")))


@add("f9_missing_vectors", "SELECT DISTINCT id, context_id FROM ontology_nodes WHERE vector_blob IS NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ontology_nodes").where("vector_blob is null").select("id", "context_id").distinct()


@add("f12_edge_direction", "SELECT DISTINCT id, CASE WHEN relation_type < 'M' THEN target_id ELSE source_id END AS tail FROM ontology_edges")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ontology_edges").select("id", F.when(F.col("relation_type") < "M", F.col("target_id")).otherwise(F.col("source_id")).alias("tail")).distinct()


@add("f14_winner_alive", "SELECT DISTINCT m.id FROM ontology_merge_log m WHERE EXISTS (SELECT 1 FROM ontology_nodes n WHERE n.id = m.winner_id)")
def _(s: SparkSession, d: str) -> DataFrame:
    nodes = table(s, d, "ontology_nodes").select(F.col("id").alias("winner_id"))
    return table(s, d, "ontology_merge_log").join(nodes, "winner_id", "left_semi").select("id").distinct()


@add("f15_results_of_context", "SELECT DISTINCT id FROM grid_chat_results WHERE row_ref_type = 'chunk' AND row_ref_id IN (SELECT id FROM chunks WHERE context_id = 3)")
def _(s: SparkSession, d: str) -> DataFrame:
    own = chunks(s, d).where("context_id = 3").select(F.col("id").alias("row_ref_id"))
    return table(s, d, "grid_chat_results").where("row_ref_type = 'chunk'").join(own, "row_ref_id", "left_semi").select("id").distinct()


# Joins


@add("j1_chunks_of_documents", "SELECT c.id, d.name, d.source FROM chunks c JOIN documents d ON c.document_id = d.doc_id")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "name", "source")
    return chunks(s, d).select("id", "document_id").join(docs, "document_id").select("id", "name", "source")


@add("j2_needs_embedding", "SELECT c.id FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.id WHERE NOT c.is_omitted AND (e.vec_id IS NULL OR e.label % 2 <> c.context_id % 2)")
def _(s: SparkSession, d: str) -> DataFrame:
    have = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("model"))
    stale = F.col("model").isNull() | (F.col("model") != F.col("context_id") % 2)
    return chunks(s, d).where("not is_omitted").select("id", "context_id").join(have, "id", "left").where(stale).select("id")


@add("j3_chunks_with_ref", "SELECT DISTINCT c.id, r.ref_key FROM chunks c JOIN chunk_refs r ON r.chunk_id = c.id WHERE NOT c.is_omitted")
def _(s: SparkSession, d: str) -> DataFrame:
    refs = table(s, d, "chunk_refs").select(F.col("chunk_id").alias("id"), "ref_key")
    return chunks(s, d).where("not is_omitted").select("id").join(refs, "id").select("id", "ref_key").distinct()


@add("j4_documents_cited_early", "SELECT id FROM chunks WHERE document_id IN (SELECT DISTINCT c.document_id FROM chunks c JOIN chunk_refs r ON r.chunk_id = c.id WHERE c.chunk_index <= 2 AND r.ref_key LIKE '%Art%')")
def _(s: SparkSession, d: str) -> DataFrame:
    cited = table(s, d, "chunk_refs").where("ref_key like '%Art%'").select(F.col("chunk_id").alias("id"))
    gate = chunks(s, d).where("chunk_index <= 2").join(cited, "id", "left_semi").select("document_id").distinct()
    return chunks(s, d).join(gate, "document_id", "left_semi").select("id")


@add(
    "j9_edge_labels",
    """SELECT e.id, s.label AS source, e.relation_type, t.label AS target FROM (SELECT DISTINCT id, source_id, target_id, relation_type FROM ontology_edges) e
    JOIN ontology_nodes s ON s.id = e.source_id JOIN ontology_nodes t ON t.id = e.target_id""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    nodes = table(s, d, "ontology_nodes")
    a = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("source"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("target"))
    edges = table(s, d, "ontology_edges").select("id", "source_id", "target_id", "relation_type").distinct()
    return edges.join(a, "source_id").join(b, "target_id").select("id", "source", "relation_type", "target")


@add(
    "j8_parallel_edges",
    """WITH e AS (SELECT DISTINCT id, context_id, source_id, target_id, relation_type FROM ontology_edges)
    SELECT a.id AS keep_id, b.id AS drop_id FROM e a JOIN e b ON a.context_id = b.context_id AND a.source_id = b.source_id AND a.target_id = b.target_id
    AND translate(a.relation_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(b.relation_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AND a.id < b.id
    WHERE a.id = (SELECT min(c.id) FROM e c WHERE c.context_id = a.context_id AND c.source_id = a.source_id AND c.target_id = a.target_id
    AND lower(c.relation_type) = lower(a.relation_type))""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    # The kept edge of a group is its smallest: an aggregate window instead of a self join.
    edges = table(s, d, "ontology_edges").where("source_id is not null and target_id is not null").select("id", "context_id", "source_id", "target_id", fold_ascii(F.col("relation_type")).alias("r")).distinct()
    w = Window.partitionBy("context_id", "source_id", "target_id", "r")
    return edges.withColumn("keep_id", F.min("id").over(w)).where("id > keep_id").select("keep_id", F.col("id").alias("drop_id"))


# Aggregations


@add("a1_counts", "SELECT (SELECT count(*) FROM chunks WHERE context_id = 3) AS chunks, (SELECT count(*) FROM embeddings WHERE label = 3) AS vectors, (SELECT count(DISTINCT id) FROM ontology_nodes WHERE vector_blob IS NOT NULL) AS nodes")
def _(s: SparkSession, d: str) -> DataFrame:
    one = chunks(s, d).where("context_id = 3").agg(F.count(F.lit(1)).alias("chunks"))
    two = table(s, d, "embeddings").where("label = 3").agg(F.count(F.lit(1)).alias("vectors"))
    three = table(s, d, "ontology_nodes").where("vector_blob is not null").agg(F.countDistinct("id").alias("nodes"))
    return one.crossJoin(two).crossJoin(three)  # one row each


@add("a2_entity_types", "SELECT entity_type, count(DISTINCT id) AS n FROM ontology_nodes GROUP BY entity_type HAVING count(DISTINCT id) > 3")
def _(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "ontology_nodes").select("id", "entity_type")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).where("n > 3").orderBy(F.desc("n"), "entity_type")


@add("a3_relation_types", "SELECT relation_type, count(DISTINCT id) AS n FROM ontology_edges GROUP BY relation_type HAVING count(DISTINCT id) > 3")
def _(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "ontology_edges").select("id", "relation_type")).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n")).where("n > 3").orderBy(F.desc("n"), "relation_type")


_EDGES = "(SELECT DISTINCT id, source_id, target_id FROM ontology_edges)"


@add("a5_degrees", f"SELECT node_id, sum(n)::BIGINT AS degree FROM (SELECT source_id AS node_id, count(*) AS n FROM {_EDGES} GROUP BY 1 UNION ALL SELECT target_id, count(*) FROM {_EDGES} GROUP BY 1) WHERE node_id IS NOT NULL GROUP BY node_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return degrees(table(s, d, "ontology_edges").select("id", "source_id", "target_id").distinct())


@add("a6_runs", "SELECT run_id, min(prompt) AS prompt, max(updated_at) AS updated_at FROM grid_chat_results GROUP BY run_id")
def _(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "grid_chat_results").groupBy("run_id").agg(F.min("prompt").alias("prompt"), F.max("updated_at").alias("updated_at"))
    return runs.orderBy(F.desc("updated_at"), "run_id")


@add("a7_mean_by_kind", "SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"))


@add("a9_distinct_keys", "SELECT DISTINCT ref_key FROM chunk_refs")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk_refs").select("ref_key").distinct()


@add("a10_contexts_by_parity", "SELECT context_id % 2 AS model_id, string_agg(DISTINCT context_id::VARCHAR, ',' ORDER BY context_id::VARCHAR) AS contexts FROM chunks GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    named = chunks(s, d).select((F.col("context_id") % 2).alias("model_id"), F.col("context_id").cast("string").alias("c")).distinct()
    return named.groupBy("model_id").agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("contexts"))


@add("a11_ref_density", "SELECT chunk_id, count(DISTINCT id) AS density FROM chunk_refs WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk_refs").where("chunk_id is not null").select("id", "chunk_id").distinct().groupBy("chunk_id").agg(F.count(F.lit(1)).alias("density"))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@add("a12_first_of_every_key", f"SELECT context_id, {_FOLD.format('ref_key')} AS k, min(id) AS id, min(created_at) AS created_at FROM chunk_refs GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    """The first row of each key, without regard to the case of ASCII letters."""
    return table(s, d, "chunk_refs").groupBy("context_id", fold_ascii(F.col("ref_key")).alias("k")).agg(F.min("id").alias("id"), F.min("created_at").alias("created_at"))


#: Laid-out lines by rule, since the tables have none: a chunk is a line of its document, four lines a page, with a size and a
#: place by number; the fourth line of a page stands apart.
_LINES = "(SELECT document_id AS doc_id, chunk_index // 4 AS page, chunk_index AS line_no, 1000 + 120 * (chunk_index % 4) + CASE WHEN chunk_index % 4 = 3 THEN 400 ELSE 0 END AS y, text, 8.0::DOUBLE + id % 5 AS size, id FROM chunks)"


def lines(s: SparkSession, d: str) -> DataFrame:
    i = F.col("chunk_index")
    y = 1000 + 120 * (i % 4) + F.when(i % 4 == 3, 400).otherwise(0)
    return chunks(s, d).select(F.col("document_id").alias("doc_id"), F.floor(i / 4).alias("page"), i.alias("line_no"), y.alias("y"), "text", (F.lit(8.0) + F.col("id") % 5).alias("size"), "id")


@add("a14_mean_font_size", f"SELECT doc_id, round(sum(size * length(coalesce(text, ''))) / nullif(sum(length(coalesce(text, ''))), 0), 6) AS mean FROM {_LINES} GROUP BY doc_id")
def _(s: SparkSession, d: str) -> DataFrame:
    from normlake.operators.chunking import mean_font_size

    return mean_font_size(lines(s, d)).select("doc_id", F.round("mean", 6).alias("mean"))


@add(
    "w6_fresh_lines",
    f"""WITH l AS (SELECT *, lag(page) OVER w AS p, lag(y) OVER w AS above FROM {_LINES} WHERE trim(coalesce(text, '')) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY page, line_no, id))
    SELECT id, (p IS NULL OR p <> page OR abs(above - y) / 10 > 1.5 * size) AS fresh FROM l""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    from normlake.operators.chunking import fresh_lines

    # Of lines with one number the smaller id comes first.
    return fresh_lines(lines(s, d).withColumn("line_no", F.struct("line_no", "id"))).select("id", "fresh")


# Windows


@add("w3_last_three", "SELECT event_type, user_id, round(avg(value), 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3 GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    kept = keep_last_n(table(s, d, "events"), ["event_type", "user_id"], 3, "ts", "event_id")
    return kept.groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 4).alias("mean"))


@add(
    "w4_inherited_heading",
    """SELECT id, last_value(h IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING) AS section
    FROM (SELECT id, document_id, chunk_index, nullif(trim(CASE WHEN json_valid(metadata) THEN metadata ->> '$.section' END), '') AS h FROM chunks)""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    h = F.trim(F.get_json_object("metadata", "$.section"))
    w = Window.partitionBy("document_id").orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, 0)
    named = chunks(s, d).select("id", "document_id", "chunk_index", F.when(h != "", h).alias("h"))
    return named.select("id", F.last("h", ignorenulls=True).over(w).alias("section"))


@add(
    "w5_section_runs",
    """WITH c AS (SELECT id, document_id, chunk_index, is_omitted, nullif(CASE WHEN json_valid(metadata) THEN metadata ->> '$.section' END, '') AS section FROM chunks),
    m AS (SELECT *, CASE WHEN lag(chunk_index) OVER w = chunk_index - 1 AND lag(section) OVER w = section AND NOT is_omitted AND NOT lag(is_omitted) OVER w THEN 0 ELSE 1 END AS fresh
      FROM c WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, id)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT document_id, run::BIGINT AS run, min(id) AS first_id, count(*) AS n FROM r WHERE section IS NOT NULL GROUP BY 1, 2""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    section = F.get_json_object("metadata", "$.section")
    c = chunks(s, d).select("id", "document_id", "chunk_index", "is_omitted", F.when(section != "", section).alias("section"))
    w = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    goes_on = (F.lag("chunk_index").over(w) == F.col("chunk_index") - 1) & (F.lag("section").over(w) == F.col("section")) & ~F.col("is_omitted") & ~F.lag("is_omitted").over(w)
    marked = c.withColumn("fresh", F.when(goes_on, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("section is not null").groupBy("document_id", "run").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@add(
    "w7_chunk_of_start",
    """WITH c AS (SELECT id, document_id, chunk_index, nullif(trim(CASE WHEN json_valid(metadata) THEN metadata ->> '$.section' END), '') AS section FROM chunks),
    l AS (SELECT *, lag(section) OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS before FROM c)
    SELECT id, max(CASE WHEN section IS NOT NULL AND section IS DISTINCT FROM before THEN chunk_index END) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS UNBOUNDED PRECEDING) AS start_index FROM l""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """The place at which the section of a chunk starts: the largest start up to it. A start is a chunk that names another section than the one before."""
    h = F.trim(F.get_json_object("metadata", "$.section"))
    order = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    c = chunks(s, d).select("id", "document_id", "chunk_index", F.when(h != "", h).alias("section"))
    starts = F.when(F.col("section").isNotNull() & ~F.col("section").eqNullSafe(F.lag("section").over(order)), F.col("chunk_index"))
    marked = c.withColumn("start", starts)
    return marked.select("id", F.max("start").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("start_index"))


@add(
    "n18_complete_section",
    """WITH c AS (SELECT id, document_id, chunk_index, nullif(CASE WHEN json_valid(metadata) THEN metadata ->> '$.section' END, '') AS section, is_omitted AS o FROM chunks),
    u AS (SELECT document_id, chunk_index, min(id) AS id, arg_min(coalesce(section, ''), id) AS section, arg_min(o, id) AS o FROM c GROUP BY 1, 2),
    l AS (SELECT document_id, chunk_index, lead(id, 1) OVER w AS i1, lead(id, 2) OVER w AS i2, lead(id, 3) OVER w AS i3, lead(section, 1) OVER w AS s1, lead(section, 2) OVER w AS s2, lead(section, 3) OVER w AS s3,
      lead(o, 1) OVER w AS o1, lead(o, 2) OVER w AS o2, lead(o, 3) OVER w AS o3, lead(chunk_index, 1) OVER w AS n1, lead(chunk_index, 2) OVER w AS n2, lead(chunk_index, 3) OVER w AS n3 FROM u WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)),
    k AS (SELECT c.id AS chunk_id, i1, i2, i3, coalesce(n1 = c.chunk_index + 1 AND NOT o1 AND s1 = c.section, false) AS a, coalesce(n2 = c.chunk_index + 2 AND NOT o2 AND s2 = c.section, false) AS b,
      coalesce(n3 = c.chunk_index + 3 AND NOT o3 AND s3 = c.section, false) AS d FROM c JOIN l USING (document_id, chunk_index) WHERE c.section IS NOT NULL AND trim(c.section) <> '')
    SELECT chunk_id, CASE WHEN a AND b THEN i1 || ',' || i2 WHEN a THEN i1::VARCHAR ELSE '' END AS continuation, CASE WHEN a AND b AND d THEN i3 END AS continues_at FROM k""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """For every chunk with a section, up to two chunks that carry it on, and where it goes on after them."""
    from normlake.operators.chunking import continued_sections

    c = chunks(s, d).withColumn("section", F.get_json_object("metadata", "$.section"))
    found = continued_sections(c, 2)
    return found.select("chunk_id", F.array_join(F.col("continuation").cast("array<string>"), ",").alias("continuation"), "continues_at")


# Order, limits, sets


@add("l2_newest_merges", "SELECT id, winner_id, loser_id, merged_at FROM (SELECT DISTINCT id, winner_id, loser_id, merged_at FROM ontology_merge_log) ORDER BY merged_at DESC, id DESC LIMIT 20")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ontology_merge_log").select("id", "winner_id", "loser_id", "merged_at").distinct().orderBy(F.desc("merged_at"), F.desc("id")).limit(20)


@add("l8_every_label", f"SELECT context_id, {_FOLD.format('label')} AS k, min(id) AS id FROM ontology_nodes GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    """The node of each label, without regard to the case of ASCII letters; the smallest id of several."""
    return table(s, d, "ontology_nodes").groupBy("context_id", fold_ascii(F.col("label")).alias("k")).agg(F.min("id").alias("id"))


@add("u1_end_counts", f"SELECT node_id, side, count(*) AS n FROM (SELECT source_id AS node_id, 'source' AS side FROM {_EDGES} UNION ALL SELECT target_id, 'target' FROM {_EDGES}) WHERE node_id IS NOT NULL GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "ontology_edges").select("id", "source_id", "target_id").distinct()
    ends = e.select(F.col("source_id").alias("node_id"), F.lit("source").alias("side")).unionByName(e.select(F.col("target_id").alias("node_id"), F.lit("target").alias("side")))
    return ends.where("node_id is not null").groupBy("node_id", "side").agg(F.count(F.lit(1)).alias("n"))


@add("c3_token_estimate", "SELECT id, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM chunks")
def _(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).select("id", estimated_tokens(F.col("text")).alias("tokens"))


#: The moment that stands for now: a parameter of whatever asks for the age of something.
CLOCK = datetime(2026, 1, 1)


@add("d1_ages", f"SELECT event_id, floor(epoch(ts))::BIGINT AS epoch, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, epoch(TIMESTAMP '{CLOCK}')::BIGINT - floor(epoch(ts))::BIGINT AS age FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    """Times as seconds, as text, and as age against a clock that is given."""
    return with_age(table(s, d, "events"), "ts", CLOCK).select("event_id", "epoch", "shown", "age")


@add("sc1_views", "SELECT context_id, count(DISTINCT id) AS nodes, (SELECT count(DISTINCT id) FROM ontology_edges e WHERE e.context_id = n.context_id) AS edges FROM ontology_nodes n GROUP BY context_id")
def _(s: SparkSession, d: str) -> DataFrame:
    """SQL over the opened tables of a directory."""
    db = Database.open(s, d)
    return db.sql("SELECT n.context_id, n.nodes, coalesce(e.edges, 0) AS edges FROM (SELECT context_id, count(DISTINCT id) AS nodes FROM {ontology_nodes} GROUP BY context_id) n LEFT JOIN (SELECT context_id, count(DISTINCT id) AS edges FROM {ontology_edges} GROUP BY context_id) e ON n.context_id = e.context_id")


# Messages and evaluation


@add("sc2_messages_of_session", "SELECT DISTINCT id, role, content, created_at FROM chat_messages WHERE session_id = 53 ORDER BY created_at, id")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chat_messages").where("session_id = 53").select("id", "role", "content", "created_at").distinct().orderBy("created_at", "id")


@add(
    "a16_eval_metrics",
    """WITH r AS (SELECT DISTINCT id, run_id, first_rank, hit5, hit10, skipped FROM eval_run_results)
    SELECT run_id, count(*) AS n, sum(CASE WHEN skipped THEN 1 ELSE 0 END)::BIGINT AS skipped, round(avg(CASE WHEN NOT skipped THEN hit5::INT END), 4) AS hit5,
    round(avg(CASE WHEN NOT skipped THEN hit10::INT END), 4) AS hit10, round(avg(CASE WHEN NOT skipped THEN coalesce(1.0 / first_rank, 0) END), 4) AS mrr FROM r GROUP BY run_id""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    from normlake.operators.evalset import run_metrics

    return run_metrics(table(s, d, "eval_run_results"))


@add(
    "a16_anchor_hits",
    """WITH a AS (SELECT id AS entry_id, unnest(CASE WHEN json_valid(anchors_any) THEN (anchors_any::JSON ->> '$[*]') ELSE [] END) AS anchor FROM eval_golden_entries),
    n AS (SELECT entry_id, trim(regexp_replace(lower(anchor), '\\s+', ' ', 'g')) AS anchor FROM a)
    SELECT DISTINCT n.entry_id, c.id AS chunk_id FROM n JOIN chunks c ON contains(trim(regexp_replace(lower(c.text), '\\s+', ' ', 'g')), n.anchor) WHERE n.anchor <> ''""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    from normlake.operators.evalset import anchor_hits

    return anchor_hits(table(s, d, "eval_golden_entries"), chunks(s, d))


@add("f11_equal_or_null", "SELECT DISTINCT id FROM ontology_nodes WHERE raw_entity_type = entity_type OR raw_entity_type IS NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ontology_nodes").where("raw_entity_type = entity_type or raw_entity_type is null").select("id").distinct()


@add("u3_merged_lists", "SELECT 'chunk' AS kind, id FROM chunks WHERE text ILIKE '%Depotquote%' UNION ALL SELECT 'node', id FROM ontology_nodes WHERE description ILIKE '%Depotquote%'")
def _(s: SparkSession, d: str) -> DataFrame:
    a = chunks(s, d).where(F.col("text").ilike("%Depotquote%")).select(F.lit("chunk").alias("kind"), "id")
    b = table(s, d, "ontology_nodes").where(F.col("description").ilike("%Depotquote%")).select(F.lit("node").alias("kind"), "id")
    return a.unionByName(b)


@add("u5_nodes_named_anywhere", "SELECT winner_id AS id FROM ontology_merge_log UNION SELECT loser_id FROM ontology_merge_log UNION SELECT id1 FROM ontology_dedup_cache UNION SELECT id2 FROM ontology_dedup_cache")
def _(s: SparkSession, d: str) -> DataFrame:
    log, cache = table(s, d, "ontology_merge_log"), table(s, d, "ontology_dedup_cache")
    ends = log.select(F.explode(F.array("winner_id", "loser_id")).alias("id")).unionByName(cache.select(F.explode(F.array("id1", "id2")).alias("id")))
    return ends.distinct()


@add("l1_ordered_nodes", "SELECT id, context_id, label FROM ontology_nodes ORDER BY context_id, label, id")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ontology_nodes").select("id", "context_id", "label").orderBy("context_id", "label", "id")


@add("j10_members_in_order", "SELECT m.community_id, n.label, m.node_id FROM (SELECT DISTINCT * FROM ontology_community_members) m JOIN ontology_nodes n ON n.id = m.node_id ORDER BY 1, 3")
def _(s: SparkSession, d: str) -> DataFrame:
    members = table(s, d, "ontology_community_members").distinct()
    labels = table(s, d, "ontology_nodes").select(F.col("id").alias("node_id"), "label")
    return members.join(labels, "node_id").select("community_id", "label", "node_id").orderBy("community_id", "node_id")
