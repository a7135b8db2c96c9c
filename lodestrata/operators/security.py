"""Row visibility: tenants, sandboxes, sessions and roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"read": 1, "write": 2, "admin": 3}


def for_tenant(df: DataFrame, tenant, column: str = "tenant_id") -> DataFrame:
    return df.where(F.col(column) == tenant)


def soft_scope(queries: list[dict], path: str, created: str, kind: str) -> Column:
    """Union of saved queries: each a dict of like (wildcard path), since, until, kind; a query's own parts must all hold."""

    def one(q: dict) -> Column:
        parts = []
        if "like" in q:
            parts.append(F.col(path).like(q["like"].replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")))
        if "since" in q:
            parts.append(F.col(created) >= F.lit(q["since"]).cast("timestamp"))
        if "until" in q:
            parts.append(F.col(created) < F.lit(q["until"]).cast("timestamp"))
        if "kind" in q:
            parts.append(F.col(kind) == q["kind"])
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    return F.coalesce(reduce(lambda a, b: a | b, [one(q) for q in queries], F.lit(False)), F.lit(False))


def visible(df: DataFrame, key: str, hard: DataFrame | None, soft: Column) -> DataFrame:
    """Rows that a soft predicate or the list of explicit keys admits, once each."""
    if hard is None:
        return df.where(soft)
    listed = hard.select(key).distinct().withColumn("_listed", F.lit(True))
    return df.join(listed, key, "left").where(soft | F.col("_listed").isNotNull()).drop("_listed")


def row_policy(df: DataFrame, tenant, key: str, hard: DataFrame | None, soft: Column, column: str = "tenant_id") -> DataFrame:
    """Row-level security: rows of the session's tenant that its sandbox admits."""
    return visible(for_tenant(df, tenant, column), key, hard, soft)


def sessions(session: DataFrame, principal: DataFrame, now: Column) -> DataFrame:
    """Sessions that haven't expired (null never does) of active principals."""
    live = session.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return live.join(principal.where("active").select("principal_id"), "principal_id", "left_semi")


def may(role: Column, capabilities: Column, operation: str) -> Column:
    """admin includes write includes read; null capabilities limit nothing."""
    rank = F.coalesce(*(F.when(role == r, n) for r, n in ROLES.items()), F.lit(0))
    return (rank >= ROLES[operation]) & (capabilities.isNull() | F.array_contains(capabilities, operation))
