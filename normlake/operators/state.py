"""Keyed state: the effect of a batch of changes on a snapshot, as plans.

A snapshot is replaced as a whole; a change batch carries `seq`, its order.
Every rule is one grouping by key: values are picked with max_by / min_by and
combine map-side, without a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rest(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in (*keys, "seq")]


def last_write(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT OR REPLACE: the whole last row of each key."""
    rest = _rest(changes, keys)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")


def first_write(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT OR IGNORE: the whole first row of each key."""
    rest = _rest(changes, keys)
    return changes.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")


def last_non_null(changes: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """ON CONFLICT with COALESCE(new, old) for the columns in `kept`, plain last for the others."""
    out = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) if c in kept else F.max_by(F.struct(c), "seq")[c].alias(c)
        for c in _rest(changes, keys)
    ]
    return changes.groupBy(*keys).agg(*out)


def latch(changes: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """ON CONFLICT where `flag` only ever turns true; other columns take the last value."""
    rest = [c for c in _rest(changes, keys) if c != flag]
    return changes.groupBy(*keys).agg(*[F.max_by(F.struct(c), "seq")[c].alias(c) for c in rest], F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag))


def counted(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert of a counter: attempts, and the last value of every other column."""
    rest = _rest(changes, keys)
    return changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), *[F.max_by(F.struct(c), "seq")[c].alias(c) for c in rest])


def keep_last_n(rows: DataFrame, keys: Sequence[str], n: int, *order: str) -> DataFrame:
    """Retention: the n newest rows of each key; the limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def prune(rows: DataFrame, run: str, keep: Sequence[str], run_column: str = "run_id", key_column: str = "row_uid") -> DataFrame:
    """Delete the rows of one run that are not listed; an empty list deletes the whole run; null keys go too."""
    listed = F.col(key_column).isin(list(keep)) if keep else F.lit(False)
    return rows.where(~F.col(run_column).eqNullSafe(run) | F.coalesce(listed, F.lit(False)))


def delete_cascade(child: DataFrame, parent_left: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is still there; null references stay (SET NULL semantics have no parent)."""
    left = parent_left.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNull()).unionByName(child.join(left, key, "left_semi").select(*child.columns))


def symmetric(cache: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """A pair cache that answers in both orientations."""
    flipped = cache.select(*[F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in cache.columns])
    return cache.unionByName(flipped).distinct()


def checked_members(members: DataFrame, single: str, kind: str = "kind", pool: str = "pool_id") -> DataFrame:
    """The new members of each pool, as given; more than one of the kind `single` in a pool is an error."""
    many = members.where(F.col(kind) == single).groupBy(pool).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not many.isEmpty():
        raise ValueError(f"a pool has more than one member of kind {single}")
    return members


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Delete-then-insert: parents named in `new` take its rows, all others keep theirs."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*old.columns))
