"""Upserts from a stream into a table of a store.

A micro-batch is folded with the same rules as a batch of changes, then put over
the snapshot by key. The table lies in buckets of its keys, and only those that a
batch touches are read and written again. A batch that is delivered again changes
nothing, since the last write of a key is told by `seq` and not by arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from normlake.operators.state import last_write
from normlake.sources.store import Store


#: Rows of a bucket, about; a table that outgrows its buckets is laid out anew with twice as many.
BUCKET_ROWS = 1_000_000


def upsert(store: Store, name: str, changes: DataFrame, keys: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> None:
    """Put changes(keys, seq, ...) over the table, which keeps seq; the greatest seq of a key wins.

    A commit of somebody else in between is a Conflict, and nothing is changed.
    """
    base = store.manifest()["number"]
    held = store.buckets(name)
    rows = store.read(name).count() if held else changes.count()
    count = max(1, len(held))
    while count * bucket_rows < rows:
        count *= 2
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int").alias("_bucket")
    if count == len(held):
        touched = sorted(r[0] for r in changes.select(bucket).distinct().collect())  # at most `count`
        old = store.read_buckets(name, touched)
    else:
        touched = list(range(count))
        old = store.read(name) if held else None
    both = changes if old is None else old.unionByName(changes)
    folded = last_write(both.withColumn("seq_", both["seq"]), keys).withColumnRenamed("seq_", "seq").select(*changes.columns, bucket)
    store.commit_buckets(name, folded, "_bucket", touched, count, base)


def upsert_stream(changes: DataFrame, store: Store, name: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Run the upsert for every micro-batch of what is there, then stop."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(store, name, batch, keys)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
