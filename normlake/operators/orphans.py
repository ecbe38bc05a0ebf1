"""References to records that do not exist, or exist only later.

A Bloom filter over the parent keys is built distributed and has a fixed upper
size, so it may be broadcast whatever the number of parents. A key it denies is
an orphan for certain and needs no join. Only keys it affirms are verified by an
exact join, which also finds parents created after the reference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.plans.runtime import MIN_HOT_ROWS, hot_keys, lookup_join

#: Filter bits a parent key; four hash positions a key.
BITS_PER_KEY = 12
#: Bounds of the filter: 64 Kibit to 256 Mibit (32 MiB), the most that is ever broadcast. It is worth its
#: place up to some 4 * 10 ** 7 parents; with more it denies ever fewer keys, and the exact join does the rest.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28


@dataclass(frozen=True)
class Reference:
    """A referring column and the column it points to."""

    table: str
    field: str
    parent: str
    row_id: str = "id"
    parent_id: str = "id"
    at: str = "created_at"


#: The references of this project's tables.
REFERENCES = (
    Reference("ontology_edges", "source_id", "ontology_nodes"),
    Reference("ontology_edges", "target_id", "ontology_nodes"),
    Reference("chunk_refs", "chunk_id", "chunks"),
    Reference("eval_run_results", "entry_id", "eval_golden_entries"),
)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit(77))]


def _positions(key: Column, bits: int) -> list[Column]:
    mask = F.lit(bits - 1)
    return [x for h in _hashes(key) for x in (h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))]


def bloom_words(parents: DataFrame, key: str) -> tuple[np.ndarray, int]:
    """The filter as 64-bit words. At most MAX_BITS / 64 rows reach the driver."""
    keys = parents.where(F.col(key).isNotNull())
    n = keys.count()
    bits = min(MAX_BITS, max(MIN_BITS, 1 << int(np.ceil(np.log2(max(1, n * BITS_PER_KEY))))))
    position = F.explode(F.array(*_positions(F.col(key), bits))).alias("p")
    words = (
        keys.select(position)
        .select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    got = words.toPandas()
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out, bits


def might_contain(df: DataFrame, key: str, words: np.ndarray, bits: int) -> Column:
    """Column that is false only where the key is certainly not among the parents."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = shared.value
        for pair in it:
            hit = np.ones(len(pair[0]), dtype=bool)
            for h in pair:
                h = h.to_numpy(dtype=np.int64)
                for p in (h & (bits - 1), (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) & (bits - 1)):
                    hit &= (table[p >> 6] >> (p & 63)) & 1 == 1
            yield pd.Series(hit)

    return probe(*_hashes(F.col(key)))


def orphans_of_one_parent(refs: DataFrame, parents: DataFrame, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Orphans among refs(table_name, field_name, row_id, key, at) against parents(key, at).

    Null keys are no references. A reference without a date is an orphan only if
    its key is missing; a parent without a date counts as always there. Repeated
    rows of either side count once: the earliest parent row decides, and each
    referring row comes out once. Empty tables give no rows, or all as orphans.
    """
    refs = refs.where(F.col("key").isNotNull())
    words, bits = bloom_words(parents, "key")
    probed = refs.withColumn("maybe", might_contain(refs, "key", words, bits))
    keyed = parents.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.lit(True).alias("there"),
        F.when(F.count("at") == F.count(F.lit(1)), F.min("at")).alias("parent_at"),
    )
    denied = probed.where(~F.col("maybe")).drop("maybe")
    # Hot keys are looked for before the probe, so that it runs once.
    affirmed = lookup_join(probed.where("maybe").drop("maybe"), keyed, "key", hot=hot_keys(refs, "key", min_hot_rows))
    failed = affirmed.where(F.col("there").isNull() | (F.col("parent_at") > F.col("at"))).select(*denied.columns)
    return denied.unionByName(failed)


def find_orphans(tables: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """(table_name, field_name, row_id, at) of every orphan reference, each once.

    All columns that point to one parent table share its filter and one pass over
    each referring table. Extra columns of the inputs are ignored.
    """
    found = None
    for parent in dict.fromkeys(r.parent for r in references):
        own = [r for r in references if r.parent == parent]
        parts = []
        for name in dict.fromkeys(r.table for r in own):
            here = [r for r in own if r.table == name]
            each = F.explode(F.array(*[F.struct(F.lit(r.field).alias("f"), F.col(r.field).cast("long").alias("k")) for r in here])).alias("e")
            parts.append(
                tables[name]
                .select(F.col(here[0].row_id).cast("long").alias("row_id"), F.col(here[0].at).alias("at"), each)
                .select(F.lit(name).alias("table_name"), F.col("e.f").alias("field_name"), "row_id", F.col("e.k").alias("key"), "at")
            )
        refs = parts[0]
        for p in parts[1:]:
            refs = refs.unionByName(p)
        r = own[0]
        parents = tables[parent].select(F.col(r.parent_id).cast("long").alias("key"), F.col(r.at).alias("at"))
        one = orphans_of_one_parent(refs, parents)
        found = one if found is None else found.unionByName(one)
    # Orphans are few; repeated rows are dropped here and not before the join.
    return found.groupBy("table_name", "field_name", "row_id").agg(F.min("at").alias("at"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field and month of the referring row; undated ones under null."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return orphans.groupBy("table_name", "field_name", month).agg(F.count(F.lit(1)).alias("orphans"))
