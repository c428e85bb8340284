"""Service-side dataflow: rate limiting, request log, job states, file tree."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW = 60, 60.0


def rate_limited(events: DataFrame, key: str, ts: str, tie: str, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """Events with ``allowed``: at most ``limit`` accepted ones per key in any ``window`` seconds; denied ones do not
    count.  ``ts`` is in seconds (double).

    A decision depends on earlier decisions, so a key's events are streamed in order past the times of its accepted
    ones: at most ``limit`` values are held, however many events a key has.  An event without a time cannot be placed: it is
    denied and does not count.  Events without a key are one key.
    """
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, accepted = object(), deque()
        for b in batches:
            allowed = []
            for k, t in zip(b.column(names.index(key)).to_pylist(), b.column(names.index(ts)).to_pylist()):
                if k != current:
                    current, accepted = k, deque()
                if t is None:
                    allowed.append(False)
                    continue
                while accepted and accepted[0] <= t - window:
                    accepted.popleft()
                allowed.append(len(accepted) < limit)
                if allowed[-1]:
                    accepted.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(allowed)], names=[*names, "allowed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", allowed boolean"
    return events.repartition(key).sortWithinPartitions(key, ts, tie).mapInArrow(run, schema)


def limit_key(user: str = "user_id", host: str = "host"):
    return F.when(F.col(user).isNotNull(), F.concat(F.lit("user:"), F.col(user))).otherwise(F.concat(F.lit("ip:"), F.col(host)))


def request_log(requests: DataFrame) -> DataFrame:
    """One JSON record per request; a request without an id gets one."""
    given = F.coalesce(F.nullif("request_id", F.lit("")), F.uuid())
    return requests.select(F.to_json(F.struct(F.lit("request").alias("event"), given.alias("request_id"), "method", "path", "status", "duration_ms")).alias("record"))


def latest_state(events: DataFrame, job: str, status: str, ts: str, tie: str) -> DataFrame:
    """The newest status of each job and how many changes it had."""
    return events.groupBy(job).agg(F.max_by(status, F.struct(ts, tie)).alias("status"), F.count(F.lit(1)).alias("changes"), F.max(ts).alias("updated_at"))


def file_tree(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Every directory and file of the paths: path, parent, name, is_dir, depth; directories sort first, then names."""
    parts = F.split(path, "/")
    rows = files.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), F.element_at(parts, n).alias("name"), (n < F.size(parts)).alias("is_dir"), n.alias("depth")),
    )).alias("x"))
    return rows.select("x.*").groupBy("path").agg(F.first("parent").alias("parent"), F.first("name").alias("name"), F.bool_or("is_dir").alias("is_dir"), F.first("depth").alias("depth"))


def merged_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Accounts after logins: matched by (provider, provider_user_id), else by email, else new.

    Both tables have email, provider, provider_user_id, name; users also have id.  New accounts get id = email.
    """
    u = users.select("id", F.col("email").alias("u_email"), F.col("provider").alias("u_provider"), F.col("provider_user_id").alias("u_pid"))
    by_id = logins.join(
        u.select("u_provider", "u_pid", F.col("id").alias("id1")),
        (F.col("provider") == F.col("u_provider")) & (F.col("provider_user_id") == F.col("u_pid")), "left",
    ).drop("u_provider", "u_pid")
    both = by_id.join(u.select("u_email", F.col("id").alias("id2")), F.col("email") == F.col("u_email"), "left").drop("u_email")
    new = both.select(F.coalesce("id1", "id2", "email").alias("id"), "email", "provider", "provider_user_id", "name")
    kept = users.join(new.select("id"), "id", "left_anti").select("id", "email", "provider", "provider_user_id", "name")
    return kept.unionByName(new)


def listed_repositories(repositories: DataFrame) -> DataFrame:
    """All repositories, the oldest first."""
    return repositories.orderBy("created_at", "id")


def health(environment: str, components: dict[str, bool]) -> dict:
    """The state of a deployment: ok if every component is."""
    parts = {name: {"status": "ok" if up else "failed"} for name, up in components.items()}
    return {"status": "ok" if all(components.values()) else "degraded", "environment": environment, "components": parts}


def error_envelope(code: str, message: str, request_id: str | None = None, details: object = None) -> dict:
    """The one shape in which failures are told to clients."""
    body = {"code": code, "message": message, "request_id": request_id}
    return {"error": body | ({"details": details} if details is not None else {})}


def request_faults(requests: DataFrame) -> DataFrame:
    """Question requests (query, start_line, end_line of their context) with ``fault``: what is wrong, or null."""
    blank = F.coalesce(F.col("query"), F.lit("")) == ""
    low = (F.col("start_line") < 1) | (F.col("end_line") < 1)
    return requests.withColumn("fault", F.when(blank, "empty query").when(low, "line below 1"))
