"""Queries on orphan references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from normlake.operators.orphans import REFERENCES, find_orphans, orphan_report
from normlake.plans.runtime import table


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = {r.table for r in REFERENCES} | {r.parent for r in REFERENCES}
    return {n: table(spark, sf_dir, n) for n in sorted(names)}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_orphans(_tables(spark, sf_dir)).select("table_name", "field_name", "row_id")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(find_orphans(_tables(spark, sf_dir)))


_FOUND = " UNION ALL ".join(
    f"""SELECT '{r.table}' AS table_name, '{r.field}' AS field_name, e.id AS row_id, min(e.created_at) AS ts
    FROM {r.table} e LEFT JOIN {r.parent} p ON e.{r.field} = p.id
    WHERE e.{r.field} IS NOT NULL AND (p.id IS NULL OR p.created_at > e.created_at) GROUP BY e.id"""
    for r in REFERENCES
)
QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": f"SELECT table_name, field_name, row_id FROM ({_FOUND})",
    "p5_report": f"""SELECT table_name, field_name, strftime(ts, '%Y-%m') AS month, count(*) AS orphans
    FROM ({_FOUND}) GROUP BY ALL""",
}
