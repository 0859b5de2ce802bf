"""Listings over accounts, roles, sessions and removal requests, as table functions.

Secrets are made and checked in the driver's own code, not here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.hashes import strip

#: Roles, each holding all before it.
ROLES = ("reader", "contributor", "curator", "admin")


def user_name(c: Column) -> Column:
    """Trimmed and lower-cased; blank is null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def status() -> Column:
    """Of an account with ``is_active``, ``registered_at`` and ``activated_at``."""
    return F.when(F.col("activated_at").isNotNull() & ~F.col("is_active"), "inactive").when(F.col("registered_at").isNull(), "invited").when(~F.col("is_active"), "pending_activation").otherwise("active")


def roles_of(user_roles: DataFrame) -> DataFrame:
    """(user_id, roles): a user's known roles, each once, in alphabetical order."""
    r = user_roles.select("user_id", F.lower(strip(F.col("role"))).alias("role")).where(F.col("role").isin(*ROLES))
    return r.groupBy("user_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def has_role(roles: Column, role: str) -> Column:
    """True if any of the roles is, or holds, the one asked for."""
    return F.arrays_overlap(roles, F.array(*[F.lit(r) for r in ROLES[ROLES.index(role) :]]))


def latest_request(requests: DataFrame, state: str | None = None) -> DataFrame:
    """A user's last removal request (of a state): by time, then id."""
    rows = requests if state is None else requests.where(F.col("status") == state)
    rest = [c for c in rows.columns if c != "user_id"]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*rest), F.struct("requested_at", "id")).alias("r")).select("user_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def list_users(accounts: DataFrame, user_roles: DataFrame, requests: DataFrame) -> DataFrame:
    """Accounts by name with roles (none is an empty list), status and the last request."""
    last = latest_request(requests).select(F.col("user_id").alias("id"), F.struct(F.col("id").alias("request_id"), "status", "requested_at").alias("removal_request"))
    roles = roles_of(user_roles).withColumnRenamed("user_id", "id")
    out = accounts.withColumn("user_status", status()).join(roles, "id", "left").join(last, "id", "left")
    return out.withColumn("roles", F.coalesce("roles", F.array().cast("array<string>"))).orderBy("username", "id")


def live_sessions(sessions: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """Sessions that are not revoked nor over, of accounts that are active."""
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now)).join(accounts.where("is_active").select(F.col("id").alias("user_id"), "username"), "user_id")


def revoke(sessions: DataFrame, user_id: int, now: Column, keep_token: str | None = None) -> DataFrame:
    """A user's open sessions ended now, but for the one kept."""
    hit = (F.col("user_id") == user_id) & F.col("revoked_at").isNull()
    if keep_token is not None:
        hit = hit & (F.col("token_hash") != keep_token)
    return sessions.withColumn("revoked_at", F.when(hit, now).otherwise(F.col("revoked_at")))


def set_roles(user_roles: DataFrame, user_id: int, roles: list[str]) -> DataFrame:
    """The table after a user's roles are replaced; unknown ones are an error."""
    names = list(dict.fromkeys(r.strip().lower() for r in roles))
    if bad := [r for r in names if r not in ROLES]:
        raise ValueError(f"unknown roles: {', '.join(bad)}")
    new = user_roles.sparkSession.createDataFrame([(user_id, r) for r in names], "user_id long, role string")
    return user_roles.where(F.col("user_id") != user_id).select("user_id", "role").unionByName(new)
