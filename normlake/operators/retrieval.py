"""Vector, keyword and hybrid retrieval.

Spaces are kept apart: a query vector is only ever compared with vectors of its
own space (embedding model). Ties always go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlake.functions.text import plain_tokens, query_terms, search_tokens
from normlake.functions.vectors import cosine

#: Constant of reciprocal rank fusion, and of BM25. Fixed values.
RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
#: Rows of a block of queries and of vectors in batch search, and queries multiplied at a time: one
#: product has 4 million cells, and a task holds a few such arrays.
QUERY_BLOCK, VECTOR_BLOCK, STRIPE = 4096, 8192, 512


def scoped(df: DataFrame, documents: Sequence[int] | None, column: str = "document_id") -> DataFrame:
    """None: everything; a list: only these documents; an empty list: nothing."""
    if documents is None:
        return df
    return df.where(F.col(column).isin(list(documents))) if documents else df.where(F.lit(False))


def fanout(k: int) -> int:
    """Hits of each method that enter fusion."""
    return max(50, 5 * k)


def search(vectors: DataFrame, query: Sequence[float], k: int, documents: Sequence[int] | None = None) -> DataFrame:
    """(id, score): the k most similar of vectors(id, document_id, vec); a vector of another size is an error."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    sized = F.when(F.size("vec") == len(query), F.col("vec")).otherwise(F.raise_error(F.lit("vector of another size")).cast("array<float>"))
    found = scoped(vectors, documents).select("id", cosine(sized, wanted).alias("score"))
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def top(df: DataFrame, keys: Sequence[str], k: int, score: str = "score", id_: str = "id") -> DataFrame:
    """The k best of each key, `rank` from 1. The limit works before the shuffle, too."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), id_)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def batch_search(queries: DataFrame, vectors: DataFrame, k: int, by: Sequence[str] = ("space",), block: int | None = None, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, *by, id, score, rank): for each query of queries(query_id, space, qvec) the k best per `by` of vectors(id, *by, vec).

    Both sides are cut into blocks by a hash, and each pair of blocks of a space
    meets in one task, which multiplies STRIPE queries at a time; only k rows a
    query leave it. Vectors of another size than the query's are skipped. `block`
    sets the rows of a block of either side.
    """
    query_block, vector_block = block or query_block, block or vector_block
    extra = [b for b in by if b != "space"]
    nq, nv = max(1, -(-queries.count() // query_block)), max(1, -(-vectors.count() // vector_block))
    q = queries.select("query_id", "space", "qvec", F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("bq")).withColumn("bv", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    v = vectors.select("id", "space", *extra, "vec", F.pmod(F.xxhash64("id"), F.lit(nv)).alias("bv")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q, v = q.withColumn("bv", F.col("bv").cast("long")), v.withColumn("bq", F.col("bq").cast("long"))

    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack(column.to_numpy()).astype(np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = right["vec"].map(len).to_numpy() if len(right) else np.array([])
        wanted = left["qvec"].map(len).to_numpy() if len(left) else np.array([])
        for size in np.intersect1d(sizes, wanted):
            a, b = left[wanted == size], right[sizes == size].reset_index(drop=True)
            x = unit(a["qvec"])
            for _, own in b.groupby(extra, sort=False) if extra else [(None, b)]:
                y, ids = unit(own["vec"]), own["id"].to_numpy()
                for lo in range(0, len(x), STRIPE):
                    score = x[lo : lo + STRIPE] @ y.T
                    near = np.round(score, 9)
                    # What is not behind the k-th stays, ties included; the smaller id decides among those.
                    last = np.partition(near, -k, axis=1)[:, -k, None] if len(own) > k else np.full((len(near), 1), -np.inf)
                    row, at = np.nonzero(near >= last)
                    order = np.lexsort((ids[at], -near[row, at], row))
                    row, at = row[order], at[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, at = row[keep], at[keep]
                    found = pd.DataFrame({"query_id": a["query_id"].to_numpy()[row + lo], "space": a["space"].iloc[0]})
                    for e in extra:
                        found[e] = own[e].iloc[0]
                    found["id"], found["score"] = ids[at], score[row, at]
                    out.append(found)
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "space", *extra, "id", "score"])

    kinds = {c: queries.schema[c].dataType.simpleString() for c in ("query_id", "space")} | {c: vectors.schema[c].dataType.simpleString() for c in (*extra, "id")}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "space", *extra, "id")) + ", score double"
    keys = ("space", "bq", "bv")
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(pair, schema)
    return top(found, ["query_id", *by], k)


def scores_of(ids: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, score) of explicit ids(id): 0 without a vector or without a query for its space. queries(space, qvec) has one row a space."""
    known = ids.select("id").distinct().join(vectors.select("id", "space", "vec"), "id", "left").join(queries, "space", "left")
    return known.select("id", F.when(F.col("vec").isNull() | F.col("qvec").isNull(), 0.0).otherwise(cosine(F.col("vec"), F.col("qvec"))).alias("score"))


def postings(chunks: DataFrame) -> DataFrame:
    """(id, tokens, length) of chunks(id, text): the keyword index, omitted chunks included."""
    tokens = search_tokens(F.coalesce("text", F.lit("")))
    return chunks.select("id", tokens.alias("tokens")).withColumn("length", F.size("tokens"))


def _frequency(tokens: Column, phrase: Sequence[str]) -> Column:
    """How often the tokens of a phrase stand side by side."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    text = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    wanted = " " + "  ".join(phrase) + " "
    return ((F.length(text) - F.length(F.replace(text, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")


def bm25(index: DataFrame, query: str) -> DataFrame:
    """(id, score) of every chunk that holds a term of the query; no term, no rows.

    A term of several tokens is a phrase. Statistics cover the whole index,
    whatever is filtered afterwards. One pass counts, one scores.
    """
    phrases = [p for p in (plain_tokens(t) for t in query_terms(query)) if p]
    if not phrases:
        return index.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    n = F.count(F.lit(1)).alias("n")
    each = [F.sum((_frequency(F.col("tokens"), p) > 0).cast("long")).alias(f"df{i}") for i, p in enumerate(phrases)]
    stats = index.agg(n, F.avg("length").alias("mean"), *each)  # one row
    score: Column = F.lit(0.0)
    hit = F.lit(False)
    for i, p in enumerate(phrases):
        tf, df = _frequency(F.col("tokens"), p), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))
        hit = hit | (tf > 0)
    return index.crossJoin(F.broadcast(stats)).where(hit).select("id", score.alias("score"))


def phrase_search(index: DataFrame, query: str) -> DataFrame:
    """(id) of chunks in which the query's tokens stand side by side, in order."""
    phrase = plain_tokens(query)
    return index.where(_frequency(F.col("tokens"), phrase) > 0 if phrase else F.lit(False)).select("id")


def fuse(ranked: DataFrame, keys: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """(*keys, id, score): reciprocal rank fusion of ranked(*keys, id, rank), all lists in one."""
    score = F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score")
    fused = ranked.groupBy(*keys, "id").agg(score)
    if k is None:
        return fused
    return top(fused, list(keys), k).drop("rank") if keys else fused.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def rank_merge(scored: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Positions of the k best scores, best first, ties in order of position: scored(*keys, id, score)."""
    return top(scored, list(keys), k)


def hybrid_batch(near: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): near and words(query_id, context_id, id, rank) fused by context, then over the contexts of a query.

    Of each context fanout(k) fused rows count, and a chunk of several contexts
    adds up. A query that one of the two lists lacks is ranked by the other.
    """
    both = near.select("query_id", "context_id", "id", "rank").unionByName(words.select("query_id", "context_id", "id", "rank"))
    fused = fuse(both, ["query_id", "context_id"], fanout(k))
    total = fused.groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    return top(total, ["query_id"], k)


def rerank(candidates: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], k: int, batch: int = 16) -> DataFrame:
    """(query_id, id, score, rank): candidates(query_id, id, query, text) by an injected pair scorer, in small batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pairs = list(zip(part["query"], part["text"], strict=True))
            scores = [s for i in range(0, len(pairs), batch) for s in scorer(pairs[i : i + batch])]
            yield pd.DataFrame({"query_id": part["query_id"], "id": part["id"], "score": scores})

    return top(candidates.select("query_id", "id", "query", "text").mapInPandas(run, "query_id long, id long, score double"), ["query_id"], k)


def pair_tokens(query: Column, text: Column) -> Column:
    """Token layout of a pair: the query, its end token (or 2), the text without its start."""
    end = F.coalesce(F.try_element_at(query, F.lit(-1)), F.lit(2))
    return F.concat(query, F.array(end), F.when(F.size(text) > 1, F.slice(text, 2, F.size(text))).otherwise(text))


def bm25_batch(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best chunks of postings that are not kept for each of queries(query_id, query), by single words. See keywords.KeywordIndex.batch."""
    from normlake.operators.keywords import counted, score_batch

    stats = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("length").cast("long")).alias("total")).first()
    return score_batch(counted(index), stats["n"], stats["total"] or 0, queries, k).select("query_id", "id", "score", "rank")


def embedded(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """(query_id, space, qvec) of texts(query_id, space, text), by an injected embedder, in small batches; vectors get length one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            listed = part["text"].fillna("").tolist()
            found = [v for i in range(0, len(listed), batch) for v in embedder(listed[i : i + batch])]
            x = np.asarray(found, dtype=np.float64).reshape(len(part), -1)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"query_id": part["query_id"], "space": part["space"], "qvec": list(np.divide(x, length, out=x, where=length > 0))})

    return texts.select("query_id", "space", "text").mapInPandas(run, "query_id long, space long, qvec array<double>")
