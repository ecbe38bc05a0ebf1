"""The tables of a directory, or of memory, under their names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from normlake.plans.runtime import table


class Database:
    """Tables by name. SQL names them in braces, so that several databases can be open at once."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
        self.spark, self.tables = spark, dict(tables)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Database:
        """Every parquet table of a directory, read lazily."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        names = sorted(f.getPath().getName()[: -len(".parquet")] for f in found if f.getPath().getName().endswith(".parquet"))
        return cls(spark, {n: table(spark, path, n) for n in names})

    @classmethod
    def in_memory(cls, spark: SparkSession, rows: Mapping[str, tuple[list[tuple], str]]) -> Database:
        """Tables from (rows, schema) each."""
        return cls(spark, {n: spark.createDataFrame(r, schema) for n, (r, schema) in rows.items()})

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def sql(self, query: str) -> DataFrame:
        """A query over {name} for each table it uses."""
        used = {n: df for n, df in self.tables.items() if "{" + n + "}" in query}
        return self.spark.sql(query, **used)
