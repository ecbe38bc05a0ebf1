"""Golden sets: which chunks answer an entry, and the metrics of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.functions.text import collapsed, search_tokens
from normlake.plans.runtime import cut


def run_metrics(results: DataFrame) -> DataFrame:
    """(run_id, n, skipped, hit5, hit10, mrr): skipped entries count only as skipped; no rank counts 0."""
    r = results.select("id", "run_id", "first_rank", "hit5", "hit10", "skipped").distinct()
    used = ~F.col("skipped")
    mean = lambda c: F.round(F.avg(F.when(used, c)), 4)
    return r.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("skipped").cast("long")).alias("skipped"),
        mean(F.col("hit5").cast("int")).alias("hit5"),
        mean(F.col("hit10").cast("int")).alias("hit10"),
        mean(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
    )


def anchors(entries: DataFrame) -> DataFrame:
    """(entry_id, anchor) of entries(id, anchors_any), collapsed; a broken list has none."""
    listed = F.from_json("anchors_any", "array<string>")
    return entries.select(F.col("id").alias("entry_id"), F.explode(listed).alias("a")).select("entry_id", collapsed(F.col("a")).alias("anchor")).where("anchor <> ''").distinct()


#: Letters in a row by which short anchors find words.
GRAM = 3


def _grams(word: Column, n: int | Column) -> Column:
    """All runs of n letters of a word; none if it is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(word) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, n))).otherwise(F.array().cast("array<string>"))


def anchor_hits(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entry_id, chunk_id): the chunk holds an anchor of the entry, without regard to case and spacing.

    Anchors and chunks meet by the anchor's rarest inner word, so no anchor is
    held against every chunk. An anchor's first and last word may be parts of
    words; anchors without an inner word find the words that contain theirs by a
    rare run of its letters.
    """
    wanted = anchors(entries)
    texts = chunks.select(F.col("id").alias("chunk_id"), collapsed(F.col("text")).alias("t"))
    words = cut(texts.select("chunk_id", F.explode(F.array_distinct(search_tokens(F.col("t")))).alias("w")))
    frequency = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    tokens = search_tokens(F.col("anchor"))
    inner = wanted.withColumn("tokens", tokens).withColumn("inner", F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(0))))
    by_word = inner.where(F.size("inner") > 0).select("entry_id", "anchor", F.explode(F.array_distinct("inner")).alias("w")).join(frequency, "w", "left")
    rarest = by_word.groupBy("entry_id", "anchor").agg(F.min_by("w", F.struct(F.coalesce("df", F.lit(0)), "w")).alias("w"))
    met = rarest.join(words, "w").select("entry_id", "anchor", "chunk_id")
    # Short anchors: a word of the chunk contains the anchor's longest word. They meet by letters: of that
    # word the three in a row that fewest words of the vocabulary have, or the whole word if it is shorter.
    short = inner.where((F.size("inner") == 0) & (F.size("tokens") > 0)).select("entry_id", "anchor", F.array_max(F.transform("tokens", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"].alias("part"))
    short = cut(short)
    lengths = [r[0] for r in short.select(F.least(F.length("part"), F.lit(GRAM)).alias("n")).distinct().collect()]  # at most GRAM
    if not lengths:
        near = met.limit(0)
    else:
        vocabulary = words.select("w").distinct()
        grams = vocabulary.select("w", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("w"), n) for n in sorted(lengths)])))).alias("g"))
        frequency = grams.groupBy("g").agg(F.count(F.lit(1)).alias("gf"))
        own = short.select("entry_id", "anchor", "part", F.explode(F.array_distinct(_grams(F.col("part"), F.least(F.length("part"), F.lit(GRAM))))).alias("g"))
        rare = own.join(frequency, "g").groupBy("entry_id", "anchor", "part").agg(F.min_by("g", F.struct("gf", "g")).alias("g"))
        holds = rare.join(grams, "g").where(F.col("w").contains(F.col("part")))
        near = holds.join(words, "w").select("entry_id", "anchor", "chunk_id")
    candidates = met.unionByName(near).distinct()
    return candidates.join(texts, "chunk_id").where(F.col("t").contains(F.col("anchor"))).select("entry_id", "chunk_id").distinct()
