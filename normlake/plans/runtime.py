"""Session helpers: table access, durable lineage cuts and key-skew handling.

Nothing here collects data whose size follows the input, except where a bound
is stated beside the call.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can be hot at once: a hot key holds more than
#: 1 / MAX_HOT_KEYS of the rows, so the list of hot keys has a proven bound.
MAX_HOT_KEYS = 10_000
#: A key below this many rows is never worth splitting.
MIN_HOT_ROWS = 100_000
#: The setting by which an execution drops its shuffle files as it ends.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors reach.

    The one that is set, else the one the cluster names in spark.checkpoint.dir.
    A temporary folder serves only a session that runs in one process; on a
    cluster without a named folder this is an error.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="normlake-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage durably: a reliable checkpoint that survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder; later reads take only the columns they need."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def settled(df: DataFrame) -> DataFrame:
    """As `stored`; what the write shuffled is dropped as it ends, and not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_RELEASE, None)
    conf.set(_RELEASE, "true")
    try:
        return stored(df)
    finally:
        conf.unset(_RELEASE) if before is None else conf.set(_RELEASE, before)


def discard(df: DataFrame) -> None:
    """Delete the stored tables that a frame reads; it and what is made of it cannot be read again."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks of a shuffle of so many rows, `each` in one: the session's number of partitions or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def hot_keys(df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> list:
    """Keys that hold more than max(min_rows, rows / MAX_HOT_KEYS) rows.

    The count is combined map-side, so a hot key costs one partial row a task.
    Two keys cannot each hold more than half, and so on: the list has at most
    MAX_HOT_KEYS entries whatever the input. Null keys are never hot. A table
    that has no more rows than one hot key needs is not grouped at all.
    """
    if df.select(key).limit(min_rows + 1).count() <= min_rows:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # 'total' is one row; only keys over both limits travel to the driver.
    large = counts.where(F.col("n") > min_rows)
    total = counts.agg(F.sum("n").alias("total"))
    rows = (
        large.crossJoin(F.broadcast(total))  # one row
        .where(F.col("n") > F.col("total") / MAX_HOT_KEYS)
        .select(key)
        .collect()
    )
    return [r[0] for r in rows]


def lookup_join(facts: DataFrame, keyed: DataFrame, key: str, min_hot_rows: int = MIN_HOT_ROWS, hot: list | None = None) -> DataFrame:
    """Left join of facts with a table that is unique by `key`, safe against hot keys.

    Rows of hot keys (a bounded list) meet a broadcast of the at most
    MAX_HOT_KEYS matching rows of `keyed`; all others meet it by a shuffle join.
    Null keys find no match and stay. The hot keys are looked for in the facts,
    unless they are given.
    """
    hot = hot_keys(facts, key, min_hot_rows) if hot is None else hot
    if not hot:
        return facts.join(keyed, key, "left")
    spark = facts.sparkSession
    kind = facts.schema[key].dataType
    listed = F.broadcast(spark.createDataFrame([(k,) for k in hot], f"{key} {kind.simpleString()}"))
    few = keyed.join(listed, key, "left_semi")  # unique by key: at most MAX_HOT_KEYS rows
    warm = facts.join(listed, key, "left_semi").join(F.broadcast(few), key, "left")
    cold = facts.join(listed, key, "left_anti").join(keyed, key, "left")
    return cold.unionByName(warm)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column, *columns: str) -> DataFrame:
    """One row a key, the one with the smallest order; combined map-side, no sort."""
    packed = F.min_by(F.struct(*columns), order).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
