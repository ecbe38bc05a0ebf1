"""A kept keyword index: BM25, phrases and batches of queries over it.

The index is tables in a store. `docs` has a row a text: its part, length and
terms with their counts, in order of the parts. Segments of postings have a row a
term and text, with the term's places, under a bucket of the term, so a query
reads the buckets of its terms only. A change of texts adds a segment and
replaces rows of `docs`; what an older segment says of a changed text no longer
counts, since postings and texts carry the number of their change. When there are
many segments they are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlake.functions.text import plain_tokens, query_terms, search_tokens
from normlake.operators.retrieval import BM25_B, BM25_K1, top
from normlake.sources.store import Store

#: Buckets of terms, and segments from which they are merged.
BUCKETS, MOST_SEGMENTS = 64, 8
#: Terms of queries that are sent to all tasks at once; more are taken block by block.
MOST_TERMS = 100_000
#: Texts scored at once, and cells (queries times texts) of one matrix at most.
DOCS_AT_ONCE, MOST_CELLS = 2048, 4_000_000

_POSTINGS = "term string, id long, seq long, places array<int>"


def _pieces(rows: DataFrame) -> DataFrame:
    """(id, part, seq, length, terms, counts, places) of rows(id, part, seq, text); null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts, places = [], [], []
            for tokens in batch.column(3).to_pylist():
                found: dict[str, list[int]] = {}
                for i, t in enumerate(tokens):
                    found.setdefault(t, []).append(i)
                terms.append(list(found))
                counts.append([len(p) for p in found.values()])
                places.append(list(found.values()))
            lengths = pa.array([sum(c) for c in counts], pa.int32())
            columns = [batch.column(0), batch.column(1), batch.column(2), lengths, pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "seq", "length", "terms", "counts", "places"])

    tokens = search_tokens(F.coalesce("text", F.lit(""))).alias("tokens")
    schema = "id long, part long, seq long, length int, terms array<string>, counts array<int>, places array<array<int>>"
    return rows.select("id", "part", "seq", tokens).mapInArrow(run, schema)


class KeywordIndex:
    """The index of texts(id, part, text) in a store. Omitted texts count for the statistics; who searches leaves them out."""

    def __init__(self, store: Store, name: str = "keywords", buckets: int = BUCKETS) -> None:
        self.store, self.name, self.buckets = store, name, buckets

    def _segments(self) -> list[str]:
        return [t for t in self.store.tables() if t.startswith(f"{self.name}.postings.")]

    def _postings(self, pieces: DataFrame) -> DataFrame:
        rows = pieces.select("id", "seq", F.explode(F.arrays_zip("terms", "places")).alias("p")).select(F.col("p.terms").alias("term"), "id", "seq", "p.places")
        return rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))

    def _write(self, seq: int, pieces: DataFrame, docs: DataFrame, postings: DataFrame | None = None, drop: Sequence[str] = ()) -> None:
        found = self._postings(pieces) if postings is None else postings
        # A bucket with a frequent term is spread over a few files.
        found = found.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "term", "id")
        ordered = docs.select("id", "part", "seq", "length", "terms", "counts").repartitionByRange("part", "id").sortWithinPartitions("part", "id")
        stats = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("length").cast("long")).alias("total"), F.lit(seq).cast("long").alias("seq"))
        tables = {f"{self.name}.docs": ordered, f"{self.name}.stats": stats, f"{self.name}.postings.{seq:08d}": found}
        self.store.commit(tables, {f"{self.name}.postings.{seq:08d}": ["bucket"]}, drop=drop)

    def rebuild(self, texts: DataFrame) -> None:
        """Index texts(id, part, text) afresh; of rows with one id any one counts."""
        old = self._segments()
        seq = (self._seq() + 1) if old else 1
        pieces = _pieces(texts.dropDuplicates(["id"]).withColumn("seq", F.lit(seq).cast("long")))
        self._write(seq, pieces, pieces, drop=old)

    def _seq(self) -> int:
        return self.store.read(f"{self.name}.stats").first()["seq"]

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Put changed(id, part, text) into the index and take deleted(id) out; an id in both is deleted."""
        seq = self._seq() + 1
        docs = self.store.read(f"{self.name}.docs")
        rows = changed.dropDuplicates(["id"]) if changed is not None else self.store.spark.createDataFrame([], "id long, part long, text string")
        if deleted is not None:
            rows = rows.join(deleted.select("id").distinct(), "id", "left_anti")
            docs = docs.join(deleted.select("id").distinct(), "id", "left_anti")
        pieces = _pieces(rows.withColumn("seq", F.lit(seq).cast("long")))
        kept = docs.join(rows.select("id"), "id", "left_anti").unionByName(pieces.drop("places"))
        self._write(seq, pieces, kept)
        if len(self._segments()) > MOST_SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """All segments into one, without what no longer counts."""
        old = self._segments()
        live = self._read(old).join(self.store.read(f"{self.name}.docs").select("id", "seq"), ["id", "seq"], "left_semi")
        seq = self._seq() + 1
        docs = self.store.read(f"{self.name}.docs").withColumn("seq", F.lit(seq).cast("long"))
        self._write(seq, docs, docs, live.withColumn("seq", F.lit(seq).cast("long")), drop=old)

    def _read(self, segments: Sequence[str]) -> DataFrame:
        parts = [self.store.read(s).select("bucket", "term", "id", "seq", "places") for s in segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """(term, id, part, length, places) of the terms; reads their buckets only."""
        listed = sorted(set(terms))
        spark = self.store.spark
        of = spark.createDataFrame([(t,) for t in listed], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct()
        wanted = [r["b"] for r in of.collect()]  # at most BUCKETS
        found = self._read(self._segments()).where(F.col("bucket").isin(wanted) & F.col("term").isin(listed))
        docs = self.store.read(f"{self.name}.docs").select("id", "seq", "part", "length")
        return found.join(docs, ["id", "seq"]).select("term", "id", "part", "length", "places")

    def _frequencies(self, phrases: Sequence[Sequence[str]]) -> DataFrame:
        """(id, part, length, tf0, tf1, …): how often each phrase stands in each text that holds a token of any."""
        by = self.postings([t for p in phrases for t in p]).groupBy("id", "part", "length").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m"))
        none = F.array().cast("array<int>")

        def tf(phrase: Sequence[str]) -> F.Column:
            at = [F.coalesce(F.try_element_at("m", F.lit(t)), none) for t in phrase]
            if len(phrase) == 1:
                return F.size(at[0])

            def follows(p: F.Column) -> F.Column:
                out = F.lit(True)
                for i, places in enumerate(at[1:], 1):
                    out = out & F.array_contains(places, p + i)
                return out

            return F.size(F.filter(at[0], follows))

        return by.select("id", "part", "length", *[tf(p).alias(f"tf{i}") for i, p in enumerate(phrases)])

    def bm25(self, query: str) -> DataFrame:
        """(id, part, score) of every text that holds a term of the query; no term, no rows. A term of several tokens is a phrase."""
        phrases = [p for p in (plain_tokens(t) for t in query_terms(query)) if p]
        if not phrases:
            return self.store.read(f"{self.name}.docs").select("id", "part", F.lit(0.0).alias("score")).where(F.lit(False))
        found = self._frequencies(phrases)
        stats = self.store.read(f"{self.name}.stats").select("n", (F.col("total") / F.col("n")).alias("mean"))  # one row
        df = found.agg(*[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(phrases))])  # one row
        score, hit = F.lit(0.0), F.lit(False)
        for i in range(len(phrases)):
            tf, d = F.col(f"tf{i}"), F.col(f"df{i}")
            idf = F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
            score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))
            hit = hit | (tf > 0)
        return found.where(hit).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(df)).select("id", "part", score.alias("score"))

    def phrase(self, query: str) -> DataFrame:
        """(id, part) of texts in which the query's tokens stand side by side, in order."""
        phrase = plain_tokens(query)
        if not phrase:
            return self.store.read(f"{self.name}.docs").select("id", "part").where(F.lit(False))
        return self._frequencies([phrase]).where("tf0 > 0").select("id", "part")

    def batch(self, queries: DataFrame, k: int, by_part: bool = False, kept: DataFrame | None = None) -> DataFrame:
        """(query_id, part, id, score, rank): the k best texts for each of queries(query_id, query), of all parts or of each.

        Queries are read as single words; a null or wordless one finds nothing.
        kept(id) limits what may be found, not the statistics. The terms of the
        queries go to all tasks, MOST_TERMS at a time, and every task keeps the k
        best of its texts for each query, so what is shuffled does not follow the
        frequency of a term.
        """
        stats = self.store.read(f"{self.name}.stats").first()
        docs = self.store.read(f"{self.name}.docs").select("id", "part", "length", "terms", "counts")
        return score_batch(docs, stats["n"], stats["total"] or 0, queries, k, by_part, kept)


def counted(index: DataFrame) -> DataFrame:
    """(id, part, length, terms, counts) of postings(id, tokens, length) that are not kept; part is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(tokens) for tokens in batch.column(1).to_pylist()]
            part = pa.array(np.zeros(batch.num_rows, dtype=np.int64))
            terms = pa.array([list(c) for c in found], pa.list_(pa.string()))
            counts = pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), part, batch.column(2), terms, counts], names=["id", "part", "length", "terms", "counts"])

    return index.select(F.col("id").cast("long"), "tokens", F.col("length").cast("int")).mapInArrow(run, "id long, part long, length int, terms array<string>, counts array<int>")


def score_batch(docs: DataFrame, n: int, total: int, queries: DataFrame, k: int, by_part: bool = False, kept: DataFrame | None = None) -> DataFrame:
    """See KeywordIndex.batch; docs(id, part, length, terms, counts) are n texts of `total` tokens."""
    terms = queries.select("query_id", F.explode(search_tokens(F.coalesce("query", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))
    blocks = max(1, -(-terms.count() // MOST_TERMS))
    if kept is not None:
        marked = docs.join(kept.select("id").distinct().withColumn("kept", F.lit(True)), "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    else:
        marked = docs.withColumn("kept", F.lit(True))
    found = None
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        one = _scored(rows.toPandas(), docs, marked, n, total, k, by_part)
        found = one if found is None else found.unionByName(one)
    return top(found, ["query_id", "part"] if by_part else ["query_id"], k)


def _scored(terms: pd.DataFrame, docs: DataFrame, marked: DataFrame, n: int, total: int, k: int, by_part: bool) -> DataFrame:
    """The k best of every task for each query of a block, by part or of all."""
    spark = docs.sparkSession
    names = {t: i for i, t in enumerate(sorted(set(terms["term"])))}
    shared = spark.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for listed in batch.column(0).to_pylist():
                n[[i for t in listed if (i := shared.value.get(t)) is not None]] += 1
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["t", "n"])

    df = np.zeros(len(names))
    for r in docs.select("terms").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():  # at most MOST_TERMS
        df[r["t"]] = r["n"]
    mean = total / max(1, n)
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    ids = np.array(sorted(set(terms["query_id"])), dtype=np.int64)
    t = terms["term"].map(names).to_numpy(dtype=np.int64) if len(terms) else np.zeros(0, dtype=np.int64)
    order = np.argsort(t, kind="stable")
    start = np.searchsorted(t[order], np.arange(len(names) + 1))
    query = np.searchsorted(ids, terms["query_id"].to_numpy(dtype=np.int64)[order]) if len(terms) else t
    weight = terms["weight"].to_numpy(dtype=np.float64)[order] * idf[t[order]] if len(terms) else idf
    asked = spark.sparkContext.broadcast((ids, start, query, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_, start_, query_, weight_ = asked.value
        held: list[np.ndarray] = []
        size = 0
        step = int(max(64, min(DOCS_AT_ONCE, MOST_CELLS // max(1, len(ids_)))))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                best = one(batch.slice(lo, step), ids_, start_, query_, weight_)
                held.append(best)
                size += len(best)
                if size > 500_000:
                    held = [leading(np.concatenate(held))]
                    size = len(held[0])
        if held:
            rows = leading(np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(ids_[rows["q"]]), pa.array(rows["part"]), pa.array(rows["id"]), pa.array(rows["score"])], names=["query_id", "part", "id", "score"])

    kind = np.dtype([("q", np.int64), ("part", np.int64), ("id", np.int64), ("score", np.float64)])

    def leading(rows: np.ndarray) -> np.ndarray:
        """The k best of each query, or query and part; ties to the smaller id."""
        part = rows["part"] if by_part else np.zeros(len(rows), dtype=np.int64)
        order = np.lexsort((rows["id"], -np.round(rows["score"], 9), part, rows["q"]))
        q, p = rows["q"][order], part[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (q[1:] != q[:-1]) | (p[1:] != p[:-1])
        at = np.arange(len(order))
        return rows[order[at - np.maximum.accumulate(np.where(fresh, at, 0)) < k]]

    def one(part: pa.RecordBatch, ids_: np.ndarray, start_: np.ndarray, query_: np.ndarray, weight_: np.ndarray) -> np.ndarray:
        lengths = part.column(2).to_numpy()
        docs_of: dict[int, list[int]] = {}
        tf_of: dict[int, list[int]] = {}
        for d, (listed, counts, keep) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)):
            if keep:
                for w, c in zip(listed, counts, strict=True):
                    if (i := shared.value.get(w)) is not None:
                        docs_of.setdefault(i, []).append(d)
                        tf_of.setdefault(i, []).append(c)
        score = np.zeros((len(ids_), part.num_rows))
        longer = BM25_K1 * (1 - BM25_B + BM25_B * lengths / max(mean, 1e-9))
        for i, listed in docs_of.items():
            at = np.array(listed)
            tf = np.array(tf_of[i], dtype=np.float64)
            lo, hi = start_[i], start_[i + 1]
            score[query_[lo:hi, None], at[None]] += weight_[lo:hi, None] * (tf * (BM25_K1 + 1) / (tf + longer[at]))[None]
        if not by_part and part.num_rows > k:
            # What is behind the k-th of its query cannot be among the best.
            last = np.partition(np.round(score, 9), -k, axis=1)[:, -k]
            q, d = np.nonzero((score > 0) & (np.round(score, 9) >= last[:, None]))
        else:
            q, d = np.nonzero(score > 0)
        out = np.empty(len(q), dtype=kind)
        out["q"], out["part"], out["id"], out["score"] = q, part.column(1).to_numpy()[d], part.column(0).to_numpy()[d], score[q, d]
        return leading(out)

    return marked.select("id", "part", "length", "terms", "counts", "kept").mapInArrow(run, "query_id long, part long, id long, score double")
