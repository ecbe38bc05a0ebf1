"""A folder of table snapshots that change together.

Every write makes new files; a numbered manifest names the current version of
each table. A commit creates the manifest of the next number, which fails if
somebody else has created it meanwhile, and nothing is ever replaced or deleted
on the way: a reader sees the old manifest or the new one, a crash leaves the old
one, and of two commits at once one is told to start again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Names of manifests; the highest number counts.
MANIFEST = "manifest-{:010d}.json"
_NUMBER = re.compile(r"manifest-(\d{10})\.json$")


class Conflict(OSError):
    """Another commit came first."""


class Store:
    """Tables under a root path, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str, schema_version: int = 1) -> None:
        self.spark, self.root, self.schema_version = spark, root.rstrip("/"), schema_version
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _latest(self) -> int:
        at = self._path(self.root)
        if not self._fs.exists(at):
            return 0
        return max((int(m[1]) for f in self._fs.listStatus(at) if (m := _NUMBER.search(f.getPath().getName()))), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self._latest() if number is None else number
        if not number:
            return {"schema_version": self.schema_version, "tables": {}, "schemas": {}, "number": 0}
        stream = self._fs.open(self._path(f"{self.root}/{MANIFEST.format(number)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": number}
        finally:
            stream.close()

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, name: str) -> DataFrame:
        """The current snapshot of a table; an unknown name is an error."""
        found = self.manifest()
        place = found["tables"][name]
        return self._open(found, name, [place] if isinstance(place, str) else sorted(set(place.values())))

    def _open(self, found: dict, name: str, places: Sequence[str]) -> DataFrame:
        # The manifest knows the columns: a partitioned table without rows has no file that does.
        schema = StructType.fromJson(found["schemas"][name])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in places])

    def buckets(self, name: str) -> list[str]:
        """Where the buckets of a table lie, in order; a table that is not in buckets is one."""
        place = self.manifest()["tables"].get(name, {})
        return [place] if isinstance(place, str) else [place[str(b)] for b in range(len(place))]

    def read_buckets(self, name: str, wanted: Sequence[int]) -> DataFrame:
        """The rows of some buckets of a table."""
        own = self.buckets(name)
        return self._open(self.manifest(), name, [own[b] for b in wanted])

    def commit_buckets(self, name: str, df: DataFrame, bucket: str, written: Sequence[int], count: int, base: int | None = None) -> None:
        """Replace the buckets `written` of a table of `count` by the rows of df, told apart by its column `bucket`; the others stay as they are."""
        found = self.manifest()
        number = (found["number"] if base is None else base) + 1
        found.pop("number")
        place = f"{name}/{uuid.uuid4().hex}"
        df.repartition(len(written), bucket).write.partitionBy(bucket).parquet(f"{self.root}/{place}")
        # A bucket without rows has no folder: an empty one stands for it.
        made = {f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{place}"))}
        own = dict(enumerate(self.buckets(name))) if len(self.buckets(name)) == count else {}
        for b in written:
            folder = f"{bucket}={b}"
            if folder not in made:
                self._fs.mkdirs(self._path(f"{self.root}/{place}/{folder}"))
            own[b] = f"{place}/{folder}"
        found["tables"][name] = {str(b): p for b, p in own.items()}
        found["schemas"][name] = df.drop(bucket).schema.jsonValue()
        self._publish(number, found)

    def commit(self, changed: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, drop: Sequence[str] = (), schema_version: int | None = None, base: int | None = None) -> None:
        """Replace the given tables, and drop others, as one step. The plans may read the tables they replace.

        A commit of another writer since this one began, or since the manifest
        `base` that the plans were read from, is a Conflict; what this one has
        written is then no part of any snapshot.
        """
        found = self.manifest()
        number = (found["number"] if base is None else base) + 1
        found.pop("number")
        for name, df in changed.items():
            place = f"{name}/{uuid.uuid4().hex}"
            df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{self.root}/{place}")
            found["tables"][name] = place
            found["schemas"][name] = df.schema.jsonValue()
        for name in drop:
            found["tables"].pop(name, None)
            found["schemas"].pop(name, None)
        if schema_version is not None:
            found["schema_version"] = schema_version
        self._publish(number, found)

    def _publish(self, number: int, found: dict) -> None:
        # Complete under a name of its own first, then moved to its number: a reader never sees half of it.
        # Neither step overwrites what is there.
        fresh = self._path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self._fs.create(fresh, False)
        try:
            out.write(bytearray(json.dumps(found, sort_keys=True).encode()))
        finally:
            out.close()
        at = self._path(f"{self.root}/{MANIFEST.format(number)}")
        if self._latest() >= number or not self._rename(fresh, at):
            self._fs.delete(fresh, False)
            raise Conflict(f"{at} is there already")

    def _rename(self, fresh: object, at: object) -> bool:
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        array = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = none
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(fresh), context.makeQualified(at), array)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def migrate(self, steps: dict[int, Callable[[Store], dict[str, DataFrame]]]) -> int:
        """Bring the tables to this store's schema_version, one step a version; the number of steps taken.

        steps[v] gives the tables that version v changes, read from version v - 1:
        they are rebuilt under new files and take the old ones' place with the new
        number in one commit, so a store is never between two versions. A store of
        a later version than this program's is an error, as is a missing step.
        """
        taken = 0
        found = self.manifest()
        at = found["schema_version"] if found["number"] else self.schema_version
        if at > self.schema_version:
            raise ValueError(f"the store has version {at}, this program knows {self.schema_version}")
        while at < self.schema_version:
            at += 1
            if at not in steps:
                raise ValueError(f"no step to version {at}")
            self.commit(steps[at](self), schema_version=at)
            taken += 1
        return taken

    def vacuum(self) -> int:
        """Delete snapshots and manifests that the latest manifest does not need; the number of folders deleted."""
        found = self.manifest()
        places = [p for t in found["tables"].values() for p in ([t] if isinstance(t, str) else t.values())]
        current = {"/".join(p.split("/")[:2]) for p in places}
        gone = 0
        if not found["number"]:
            return gone
        for folder in self._fs.listStatus(self._path(self.root)):
            name = folder.getPath().getName()
            if folder.isFile():
                if (m := _NUMBER.search(name)) and int(m[1]) < found["number"]:
                    self._fs.delete(folder.getPath(), False)
                continue
            for s in self._fs.listStatus(folder.getPath()):
                if f"{name}/{s.getPath().getName()}" not in current:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def write_json(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
