"""Declared schemas of the service tables, and their creation as managed Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPOSITORIES = "id string, url string, branch string, status string, file_count int, error string, created_at timestamp, updated_at timestamp"
INGESTION_JOBS = "id string, repository_id string, status string, error string, started_at timestamp, finished_at timestamp"
USERS = "id string, email string, name string, provider string, provider_user_id string, is_active boolean, created_at timestamp"
QUERY_LOGS = "id string, user_id string, repository_id string, query string, category string, latency_ms int, details string, created_at timestamp"
TABLES = {"repositories": REPOSITORIES, "ingestion_jobs": INGESTION_JOBS, "users": USERS, "query_logs": QUERY_LOGS}
JOB_STATES = ("pending", "running", "completed", "failed")
#: Columns that hold one row per value, and references from a column to a table's id.
UNIQUE = {"repositories": ["url", "branch"], "users": ["email"]}
REFERENCES = {"ingestion_jobs": {"repository_id": "repositories"}, "query_logs": {"user_id": "users", "repository_id": "repositories"}}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def violations(table: str, rows: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, key, n) for values that break a table's uniqueness or reference rules; Parquet tables enforce neither."""
    out = rows.sparkSession.createDataFrame([], "rule string, key string, n long")
    if keys := UNIQUE.get(table):
        twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(twice.select(F.lit("unique").alias("rule"), F.concat_ws(" ", *keys).alias("key"), "n"))
    for column, parent in REFERENCES.get(table, {}).items():
        if parents and parent in parents:
            ids = parents[parent].select(F.col("id").alias("_id"))
            lost = rows.where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_id"), "left_anti")
            out = out.unionByName(lost.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{column} -> {parent}").alias("rule"), "key", "n"))
    return out


def validated_request(repo_url: str | None, local_path: str | None) -> str:
    """The one source of an ingestion request; a ValueError unless exactly one is given."""
    given = [x for x in (repo_url, local_path) if x]
    if len(given) != 1:
        raise ValueError("exactly one of repo_url and local_path must be given")
    return given[0]
