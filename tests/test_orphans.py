from __future__ import annotations

from datetime import datetime as D

import numpy as np

from normlake.operators.orphans import Reference, bloom_words, find_orphans, might_contain, orphan_report
from normlake.plans.runtime import hot_keys, lookup_join
from pyspark.sql import functions as F

from tests.conftest import rows

REF = (Reference("child", "ref", "parent"),)
CHILD = "id long, ref long, created_at timestamp, key string, at string"


def _tables(spark, child, parent):
    return {"child": spark.createDataFrame(child, CHILD), "parent": spark.createDataFrame(parent, "id long, created_at timestamp, key int")}


def test_missing_late_null_and_repeated(spark):
    day = D(2024, 3, 5)
    child = [(1, 10, day, "x", "y"), (1, 10, day, "x", "y"), (2, None, day, "x", "y"), (3, 11, day, "x", "y"), (4, 12, day, None, None), (5, 13, None, "x", "y"), (6, 99, None, "x", "y")]
    parent = [(10, D(2024, 1, 1), 1), (11, D(2024, 4, 1), 1), (13, D(2024, 1, 1), 1), (13, D(2024, 1, 1), 1)]
    found = find_orphans(_tables(spark, child, parent), REF)
    assert rows(found.select("row_id")) == {(3,), (4,), (6,)}
    assert rows(orphan_report(found)) == {("child", "ref", "2024-03", 2), ("child", "ref", None, 1)}


def test_empty_tables(spark):
    day = D(2024, 1, 1)
    assert rows(find_orphans(_tables(spark, [(1, 5, day, "", "")], []), REF).select("row_id")) == {(1,)}
    assert rows(find_orphans(_tables(spark, [], [(1, day, 1)]), REF)) == set()


def test_filter_has_no_false_negatives(spark):
    parents = spark.range(5000).select((F.col("id") * 7).alias("key"))
    words, bits = bloom_words(parents, "key")
    assert words.dtype == np.int64
    probe = spark.range(35000).select(F.col("id").alias("key"))
    hit = probe.withColumn("maybe", might_contain(probe, "key", words, bits))
    assert hit.where("key % 7 = 0 and not maybe").count() == 0
    assert hit.where("key % 7 <> 0 and maybe").count() < 600


def test_hot_keys_give_the_same_join(spark):
    facts = spark.createDataFrame([(1, i) for i in range(50)] + [(i, i) for i in range(2, 20)] + [(None, 0)], "k long, v long")
    keyed = spark.createDataFrame([(i, i * 10) for i in range(0, 20, 2)] + [(1, 7)], "k long, w long")
    assert hot_keys(facts, "k", 20) == [1]
    plain, split = (sorted(map(repr, lookup_join(facts, keyed, "k", n).collect())) for n in (10**6, 20))
    assert plain == split
