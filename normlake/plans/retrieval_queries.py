"""Vector, keyword and hybrid retrieval over the tables.

Spaces: an embedding's label is its context, the label's parity its model. The
queries of the batch operators are the vectors whose id is divisible by 100.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normlake.functions import vectors as V
from normlake.functions.text import ACCENTED, PLAIN, match_expression
from normlake.operators import retrieval as R
from normlake.operators.keywords import KeywordIndex
from normlake.operators.state import last_write
from normlake.plans.registry import Registry, values_sql
from normlake.plans.runtime import shared_dir, table
from normlake.sources.store import Store

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql
add = registry.add

#: One fixed query vector, along the first two axes.
AXIS = [1.0, 0.5] + [0.0] * 62
_AXIS = "[" + ", ".join(map(repr, AXIS)) + "]::DOUBLE[]"
K = 10


def space(spark: SparkSession, d: str) -> DataFrame:
    """(id, context_id, space, vec) of the embeddings."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("context_id"), (F.col("label") % 2).cast("long").alias("space"), F.col("embedding").alias("vec"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return space(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "space", F.col("vec").alias("qvec"))


_SPACE = "(SELECT vec_id AS id, label::BIGINT AS context_id, (label % 2)::BIGINT AS space, embedding::DOUBLE[] AS vec FROM embeddings)"
_ASKED = f"(SELECT id AS query_id, space, vec AS qvec FROM {_SPACE} WHERE id % 100 = 0)"


@add("r1_cosine", f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_AXIS}), 4) AS score FROM embeddings")
def _(s: SparkSession, d: str) -> DataFrame:
    q = F.array(*map(F.lit, AXIS))
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), q), 4).alias("score"))


@add("r2_vector_topk", f"SELECT id, round(score, 4) AS score FROM (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {_AXIS}) AS score FROM embeddings WHERE label = 3) ORDER BY round(score, 9) DESC, id LIMIT {K}")
def _(s: SparkSession, d: str) -> DataFrame:
    v = space(s, d).where("context_id = 3").withColumn("document_id", F.col("id"))
    return R.search(v, AXIS, K).select("id", F.round("score", 4).alias("score"))


_PER_CONTEXT = f"""SELECT query_id, context_id, id, score, row_number() OVER (PARTITION BY query_id, context_id ORDER BY round(score, 9) DESC, id) AS rank
FROM (SELECT query_id, context_id, id, list_cosine_similarity(vec, qvec) AS score FROM {_ASKED} q JOIN {_SPACE} v ON q.space = v.space)"""


@add("r3_per_context_merge", f"SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ({_PER_CONTEXT}) WHERE rank <= {K}) WHERE rank <= {K}")
def _(s: SparkSession, d: str) -> DataFrame:
    per_context = R.batch_search(asked(s, d), space(s, d), K, by=("space", "context_id"))
    return R.top(per_context.drop("rank"), ["query_id"], K).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@add("r4_batch_topk", f"SELECT query_id, id, rank, round(score, 4) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, id, list_cosine_similarity(vec, qvec) AS score FROM {_ASKED} q JOIN {_SPACE} v ON q.space = v.space)) WHERE rank <= {K}")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.batch_search(asked(s, d), space(s, d), K).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@add(
    "w1_topk_per_context",
    f"SELECT query_id, context_id, id, rank FROM ({_PER_CONTEXT}) WHERE rank <= 3",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return R.batch_search(asked(s, d), space(s, d), 3, by=("space", "context_id")).select("query_id", "context_id", "id", F.col("rank").cast("long").alias("rank"))


@add(
    "r6_score_ids",
    f"SELECT c.id, round(CASE WHEN e.vec_id IS NULL OR e.label % 2 <> 0 THEN 0 ELSE list_cosine_similarity(e.embedding::DOUBLE[], {_AXIS}) END, 4) AS score FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.id",
)
def _(s: SparkSession, d: str) -> DataFrame:
    q = s.createDataFrame([(0, AXIS)], "space long, qvec array<double>")
    found = R.scores_of(table(s, d, "chunks").select("id"), space(s, d), F.broadcast(q))
    return found.select("id", F.round("score", 4).alias("score"))


_CASES = [("AT 4.3.2", '"AT" OR "4.3.2"'), ("§ 25a KWG", '"25a" OR "KWG"'), ("Art. 28", '"Art." OR "28"'), ("", ""), ("   ", ""), ("§ — ()", "")]


@add("r7_match_expression", values_sql(["query", "expression"], _CASES))
def _(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(q, match_expression(q)) for q, _ in _CASES], "query string, expression string")


#: A keyword query with a phrase term; the words are neither very rare nor in most chunks.
QUERY = "Depotquote Leasingfrist surcharge 27.8.2020"
_PLAIN = f"translate(lower(coalesce(text, '')), '{ACCENTED}', '{PLAIN}')"
_INDEX = f"(SELECT id, context_id, is_omitted, list_filter(regexp_split_to_array({_PLAIN}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS tokens FROM chunks)"


def _bm25(where: str = "true") -> str:
    phrases = [["depotquote"], ["leasingfrist"], ["surcharge"], ["27", "8", "2020"]]
    tf = []
    for p in phrases:
        if len(p) == 1:
            tf.append(f"len(list_filter(tokens, lambda t: t = '{p[0]}'))")
        else:
            text = "' ' || array_to_string(tokens, '  ') || ' '"
            wanted = " " + "  ".join(p) + " "
            tf.append(f"(length({text}) - length(replace({text}, '{wanted}', ''))) // {len(wanted)}")
    cols = ", ".join(f"{e} AS t{i}" for i, e in enumerate(tf))
    dfs = ", ".join(f"sum((t{i} > 0)::INT) AS d{i}" for i in range(len(tf)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(tf)))
    hit = " OR ".join(f"t{i} > 0" for i in range(len(tf)))
    return f"""(WITH x AS (SELECT id, context_id, is_omitted, len(tokens) AS dl, {cols} FROM {_INDEX}), st AS (SELECT count(*) AS n, avg(dl) AS mean, {dfs} FROM x)
    SELECT id, context_id, {score} AS score FROM x, st WHERE ({hit}) AND NOT is_omitted AND {where})"""


_KEPT: dict[tuple[str, str], KeywordIndex] = {}


def kept_index(s: SparkSession, d: str) -> KeywordIndex:
    """The keyword index of a data directory's chunks, in the shared folder; built when it is first asked for in a session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _KEPT:
        index = KeywordIndex(Store(s, f"{shared_dir(s)}/keywords-{uuid.uuid4().hex}"))
        index.rebuild(table(s, d, "chunks").select("id", F.col("context_id").alias("part"), "text"))
        _KEPT[key] = index
    return _KEPT[key]


def _keyword(s: SparkSession, d: str) -> DataFrame:
    kept = table(s, d, "chunks").where("not is_omitted").select("id", "context_id")
    return kept_index(s, d).bm25(QUERY).select("id", "score").join(kept, "id")


@add("r8_bm25", f"SELECT id, round(score, 4) AS score FROM {_bm25()} ORDER BY round(score, 9) DESC, id LIMIT 50")
def _(s: SparkSession, d: str) -> DataFrame:
    return _keyword(s, d).orderBy(F.desc(F.round("score", 9)), "id").limit(50).select("id", F.round("score", 4).alias("score"))


@add("w2_keyword_rank", f"SELECT context_id, id, rank FROM (SELECT context_id, id, row_number() OVER (PARTITION BY context_id ORDER BY round(score, 9) DESC, id) AS rank FROM {_bm25()}) WHERE rank <= 5")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.top(_keyword(s, d), ["context_id"], 5).select("context_id", "id", F.col("rank").cast("long").alias("rank"))


@add("r9_phrase", f"SELECT id FROM {_INDEX} WHERE NOT is_omitted AND contains(' ' || array_to_string(tokens, ' ') || ' ', ' der prufung stellte die stelle ')")
def _(s: SparkSession, d: str) -> DataFrame:
    kept = table(s, d, "chunks").where("not is_omitted").select("id")
    return kept_index(s, d).phrase("der Prüfung stellte die Stelle").select("id").join(kept, "id", "left_semi")


_RRF = [(1, 1 / 61 + 1 / 62, 1), (2, 1 / 62, 3), (3, 1 / 61, 2)]


@add("r10_rrf", "SELECT id, round(score, 9) AS score, rank FROM (" + values_sql(["id", "score", "rank"], _RRF) + ")")
def _(s: SparkSession, d: str) -> DataFrame:
    lists = s.createDataFrame([(1, 1), (2, 2), (3, 1), (1, 2)], "id long, rank long")
    fused = R.fuse(lists)
    w = Window.orderBy(F.desc("score"), "id")
    return fused.select("id", F.round("score", 9).alias("score"), F.row_number().over(w).cast("long").alias("rank"))


_FAN = [(1, 50), (10, 50), (20, 100)]


@add("r11_fanout", values_sql(["k", "n"], _FAN))
def _(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(k, R.fanout(k)) for k, _ in _FAN], "k long, n long")


@add(
    "r12_hybrid",
    f"""WITH v AS (SELECT context_id, id, row_number() OVER (PARTITION BY context_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT c.context_id, c.id, list_cosine_similarity(e.embedding::DOUBLE[], {_AXIS}) AS score FROM chunks c JOIN embeddings e ON e.vec_id = c.id WHERE NOT c.is_omitted)),
    k AS (SELECT context_id, id, row_number() OVER (PARTITION BY context_id ORDER BY round(score, 9) DESC, id) AS rank FROM {_bm25()}),
    f AS (SELECT context_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM v WHERE rank <= 50 UNION ALL SELECT * FROM k WHERE rank <= 50) GROUP BY 1, 2),
    g AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY round(score, 9) DESC, id) AS rank FROM f)
    SELECT id, round(sum(score), 6) AS score FROM g WHERE rank <= 50 GROUP BY id ORDER BY round(sum(score), 9) DESC, id LIMIT {K}""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    chunks = table(s, d, "chunks")
    n = R.fanout(K)
    q = F.array(*map(F.lit, AXIS))
    vectors = chunks.where("not is_omitted").select("id", "context_id").join(space(s, d).select("id", "vec"), "id")
    near = R.top(vectors.select("context_id", "id", V.cosine(F.col("vec"), q).alias("score")), ["context_id"], n)
    words = R.top(_keyword(s, d).select("context_id", "id", "score"), ["context_id"], n)
    fused = R.fuse(near.unionByName(words), ["context_id"], n)
    total = fused.groupBy("id").agg(F.sum("score").alias("score"))
    return total.orderBy(F.desc(F.round("score", 9)), "id").limit(K).select("id", F.round("score", 6).alias("score"))


#: White space between words, as str.split() sees it.
_WHITE = "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@add(
    "r14_rerank",
    f"""WITH h AS (SELECT id FROM {_bm25()}), w AS (SELECT id, text, list_distinct(regexp_split_to_array(lower(text), '{_WHITE}')) AS words FROM chunks SEMI JOIN h USING (id)),
    s AS (SELECT id, len(list_intersect(words, {QUERY.lower().split()!r}))::DOUBLE AS score FROM w)
    SELECT * FROM (SELECT 1::BIGINT AS query_id, id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= {K}""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Pairs scored by an injected scorer, here the shared words."""

    def scorer(pairs: list[tuple[str, str]]) -> list[float]:
        return [float(len(set(q.lower().split()) & set(t.lower().split()))) for q, t in pairs]

    found = _keyword(s, d).join(table(s, d, "chunks").select("id", "text"), "id")
    pairs = found.select(F.lit(1).cast("long").alias("query_id"), "id", F.lit(QUERY).alias("query"), "text")
    found = R.rerank(pairs, scorer, K)
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


_PAIRS = [("0,11,12,2", "0,21,2", "0,11,12,2,2,21,2"), ("0,9,2", "", "0,9,2,2"), ("0,9,2", "0", "0,9,2,2,0")]


@add("r15_pair_tokens", values_sql(["q", "t", "tokens"], _PAIRS))
def _(s: SparkSession, d: str) -> DataFrame:
    as_ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    rows = s.createDataFrame([r[:2] for r in _PAIRS], "q string, t string")
    return rows.select("q", "t", F.array_join(R.pair_tokens(as_ints(F.col("q")), as_ints(F.col("t"))).cast("array<string>"), ",").alias("tokens"))


_POOLED = [("1 1 0", "2.0 3.0"), ("0 0 0", "0.0 0.0"), ("1", "1.0 2.0")]


@add("a13_mean_pool", values_sql(["mask", "pooled"], _POOLED))
def _(s: SparkSession, d: str) -> DataFrame:
    states = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((1.0, 2.0), (3.0, 4.0), (100.0, 100.0))])
    rows = s.createDataFrame([(m,) for m, _ in _POOLED], "mask string")
    mask = F.transform(F.split("mask", " "), lambda x: x.cast("int"))
    return rows.select("mask", F.array_join(V.mean_pooled(states, mask).cast("array<string>"), " ").alias("pooled"))


@add("r16_shortened", "SELECT vec_id AS id, round(embedding[1] / sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))), 4) AS first FROM embeddings")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(V.truncated(F.col("embedding"), 16)[0], 4).alias("first"))


@add("r17_embeddable", "SELECT id FROM chunks WHERE NOT is_omitted AND context_id = 3")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").where("not is_omitted and context_id = 3").select("id")


@add("r18_replace_vectors", "SELECT label, max(vec_id) AS vec_id, arg_max(round(embedding[1], 4), vec_id) AS first FROM embeddings GROUP BY label")
def _(s: SparkSession, d: str) -> DataFrame:
    changes = table(s, d, "embeddings").where(F.size("embedding") == 64).select("label", F.col("vec_id").alias("seq"), "vec_id", F.round(F.col("embedding")[0], 4).alias("first"))
    return last_write(changes, ["label"])


@add("sc9_vector_codec", "SELECT vec_id AS id, 256::BIGINT AS bytes, round(embedding[64], 4) AS last FROM embeddings")
def _(s: SparkSession, d: str) -> DataFrame:
    coded = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), V.to_blob("embedding").alias("b"))
    return coded.select("id", F.octet_length("b").cast("long").alias("bytes"), F.round(V.from_blob("b")[63], 4).alias("last"))


_RANKED = [(1, 1), (3, 2), (2, 3), (0, 4)]


@add("l5_rank_merge", values_sql(["id", "rank"], _RANKED))
def _(s: SparkSession, d: str) -> DataFrame:
    scored = s.createDataFrame([(0, 0.1), (1, 0.9), (2, 0.5), (3, 0.7)], "id long, score double")
    return R.rank_merge(scored.withColumn("q", F.lit(1)), 4, ["q"]).select("id", F.col("rank").cast("long").alias("rank"))


_QTERMS = f"translate(lower(coalesce(question, '')), '{ACCENTED}', '{PLAIN}')"


@add(
    "r13_keyword_batch",
    f"""WITH q AS (SELECT id AS query_id, term, count(*) AS w FROM (SELECT id, unnest(list_filter(regexp_split_to_array({_QTERMS}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM eval_golden_entries) GROUP BY 1, 2),
    x AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM {_INDEX}), tf AS (SELECT term, id, dl, count(*) AS tf FROM x GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM {_INDEX}),
    sc AS (SELECT query_id, id, sum(w * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
    SELECT query_id, id, rank, round(score, 4) AS score FROM r WHERE rank <= 5""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    queries = table(s, d, "eval_golden_entries").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    found = kept_index(s, d).batch(queries, 5)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


_KEPT_TERMS = f"""q AS (SELECT id AS query_id, term, count(*) AS w FROM (SELECT id, unnest(list_filter(regexp_split_to_array({_QTERMS}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM eval_golden_entries) GROUP BY 1, 2),
    x AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM {_INDEX}), tf AS (SELECT term, id, dl, count(*) AS tf FROM x GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM {_INDEX}),
    sc AS (SELECT query_id, id, sum(w * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


@add(
    "r13_hybrid_batch",
    f"""WITH {_KEPT_TERMS},
    c AS (SELECT id, context_id FROM chunks WHERE NOT is_omitted),
    k AS (SELECT query_id, context_id, id, row_number() OVER (PARTITION BY query_id, context_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc JOIN c USING (id)),
    v AS (SELECT query_id, context_id, id, row_number() OVER (PARTITION BY query_id, context_id ORDER BY round(score, 9) DESC, id) AS rank
      FROM (SELECT g.id AS query_id, c.context_id, c.id, list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS score
      FROM eval_golden_entries g JOIN embeddings a ON a.vec_id = g.id, c JOIN embeddings e ON e.vec_id = c.id)),
    f AS (SELECT query_id, context_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM v WHERE rank <= 50 UNION ALL SELECT query_id, context_id, id, rank FROM k WHERE rank <= 50) GROUP BY 1, 2, 3),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id, context_id ORDER BY round(score, 9) DESC, id) AS rank FROM f),
    t AS (SELECT query_id, id, sum(score) AS score FROM g WHERE rank <= 50 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM t)
    SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """All golden questions with their words and, where there is one, their vector: the embedding of their number."""
    chunks = table(s, d, "chunks").where("not is_omitted").select("id", "context_id")
    golden = table(s, d, "eval_golden_entries").select(F.col("id").alias("query_id"), F.coalesce("question", F.lit("")).alias("query"))
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked_ = golden.join(vectors.withColumnRenamed("id", "query_id"), "query_id").select("query_id", F.lit(0).alias("space"), F.col("vec").alias("qvec"))
    n = R.fanout(K)
    near = R.batch_search(asked_, chunks.join(vectors, "id").withColumn("space", F.lit(0)), n, by=("space", "context_id"))
    words = kept_index(s, d).batch(golden, n, by_part=True, kept=chunks).withColumnRenamed("part", "context_id")
    fused = R.hybrid_batch(near, words, K)
    return fused.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


#: A log of changes to the index: of the texts of context 3, those whose id leaves 1 of 3 are changed, 2 deleted, and one comes in.
_EDITED = "SELECT id, CASE WHEN context_id = 3 AND id % 3 = 1 THEN 'Leasingfrist neu geregelt' ELSE text END AS text FROM chunks WHERE NOT (context_id = 3 AND id % 3 = 2) UNION ALL SELECT 900000000, 'eine neue Leasingfrist'"


@add(
    "m14_synced_index",
    f"""WITH t AS ({_EDITED}), x AS (SELECT id, list_filter(regexp_split_to_array({_PLAIN}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS tokens FROM t),
    st AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM x), h AS (SELECT id, len(tokens) AS dl, len(list_filter(tokens, lambda t: t = 'leasingfrist')) AS tf FROM x),
    df AS (SELECT count(*) AS df FROM h WHERE tf > 0)
    SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 4) AS score FROM h, st, df WHERE tf > 0""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """An index that follows inserts, changes and deletions of texts."""
    index = KeywordIndex(Store(s, f"{shared_dir(s)}/keywords-{uuid.uuid4().hex}"))
    texts = table(s, d, "chunks").select("id", F.col("context_id").alias("part"), "text")
    index.rebuild(texts)
    own = texts.where("part = 3")
    fresh = s.createDataFrame([(900_000_000, 3, "eine neue Leasingfrist")], "id long, part long, text string")
    index.apply(own.where("id % 3 = 1").withColumn("text", F.lit("Leasingfrist neu geregelt")).unionByName(fresh), own.where("id % 3 = 2").select("id"))
    return index.bm25("Leasingfrist").select("id", F.round("score", 4).alias("score"))


@add(
    "r5_text_to_hits",
    f"""WITH q AS (SELECT id AS query_id, (id % 2)::BIGINT AS space, list_transform(range(64), lambda i: (length(lower(coalesce(question, ''))) - length(replace(lower(coalesce(question, '')), chr((97 + i % 26)::INT), '')) + i)::DOUBLE) AS qvec FROM eval_golden_entries),
    p AS (SELECT query_id, q.space, v.id, list_cosine_similarity(v.vec, q.qvec) AS score FROM q JOIN {_SPACE} v ON v.space = q.space)
    SELECT * FROM (SELECT query_id, space, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM p) WHERE rank <= 5""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Questions embedded by an injected embedder, here letter counts."""

    def embedder(texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(chr(97 + i % 26)) + i) for i in range(64)] for t in texts]

    texts = table(s, d, "eval_golden_entries").select(F.col("id").alias("query_id"), (F.col("id") % 2).alias("space"), F.col("question").alias("text"))
    found = R.batch_search(R.embedded(texts, embedder), space(s, d), 5)
    return found.select("query_id", "space", "id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))
