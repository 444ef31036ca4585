"""Batches of changes applied to stored tables.

Changes of one key are folded with partial aggregates, never by collecting
them, so a key with very many changes costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwell import catalog as cat

SALTS = 16
POLICY_FIELDS = ("name", "policy_type", "rules_json", "tags_json", "enabled")


def last_change(changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Newest change of every key; numbers of changes are unique within a key."""
    rest = [c for c in changes.columns if c not in (key, seq)]
    return changes.groupBy(key).agg(F.max(seq).alias(seq), *[F.max_by(c, seq).alias(c) for c in rest])


def apply_policy_changes(base: DataFrame, changes: DataFrame, key: str = "policy_id") -> DataFrame:
    """Base table after creates, updates, toggles and deletes.

    `changes`: key, user_id, seq, op, and the policy fields (used by create and update).
    A change reaches its own user's policies only; another user's changes of the same id are void.
    Every update raises the version by one; a toggle flips `enabled` without
    that; a delete removes the row and makes later changes of it void.
    """
    ids = [key, "user_id"]
    others = base.select(key, F.col("user_id").alias("_owner"))
    # a create of an id that somebody else owns is void, too
    own = changes.join(others, key, "left").filter(F.col("_owner").isNull() | F.col("_owner").eqNullSafe(F.col("user_id"))).drop("_owner")
    is_write = F.col("op").isin("create", "update")
    seq_of_write = F.when(is_write, F.col("seq"))
    folded = own.groupBy(*ids).agg(
        F.count_if(F.col("op") == "update").alias("n_updates"), F.max(seq_of_write).alias("write_seq"),
        *[F.max_by(c, seq_of_write).alias(f"w_{c}") for c in POLICY_FIELDS],
        F.count_if(F.col("op") == "toggle").alias("n_toggles"),
        F.bool_or(F.col("op") == "create").alias("created"), F.bool_or(F.col("op") == "delete").alias("deleted"),
        F.max("changed_at").alias("changed_at"))
    # toggles before the last write are void; a busy key meets its write in SALTS parts
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    writes = folded.filter(F.col("write_seq").isNotNull() & (F.col("n_toggles") > 0)).select(
        *ids, "write_seq", F.explode(salts).alias("_salt"))
    toggles = own.filter(F.col("op") == "toggle").select(
        *ids, "seq", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int").alias("_salt"))
    void = (toggles.join(writes, [*ids, "_salt"]).filter(F.col("seq") < F.col("write_seq"))
            .groupBy(*ids, "_salt").agg(F.count("*").alias("n")).groupBy(*ids).agg(F.sum("n").alias("n_void")))
    net = folded.join(void, ids, "left").withColumn("flips", F.col("n_toggles") - F.coalesce("n_void", F.lit(0)))
    joined = base.withColumn("_stored", F.lit(True)).join(net, ids, "full_outer")
    stored, created = F.coalesce("_stored", F.lit(False)), F.coalesce("created", F.lit(False))
    live = ~F.coalesce("deleted", F.lit(False)) & (stored | created)
    was_written = F.col("write_seq").isNotNull()
    current = {c: F.when(was_written, F.coalesce(f"w_{c}", c)).otherwise(F.col(c)) for c in POLICY_FIELDS}
    flip = (F.coalesce("flips", F.lit(0)) % 2) == 1
    return joined.filter(live).select(
        *ids, *[current[c].alias(c) for c in POLICY_FIELDS if c != "enabled"],
        F.when(flip, ~current["enabled"]).otherwise(current["enabled"]).alias("enabled"),
        (F.coalesce("version", F.lit(1)) + F.coalesce("n_updates", F.lit(0))).cast("int").alias("version"),
        F.coalesce("created_at", "changed_at").alias("created_at"))


def set_incident_status(incidents: DataFrame, updates: DataFrame, key: str = "content_id", seq: str = "seq") -> DataFrame:
    """Incidents after status updates; the last valid status of an incident counts, unknown ones are refused."""
    valid = updates.filter(F.col("status").isin(*cat.INCIDENT_STATUSES)).groupBy(key).agg(
        F.max_by("status", seq).alias("_status"))
    return incidents.join(valid, key, "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def upsert_defaults(writes: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Key/map store after partial writes: per entry the newest non-null value stays."""
    entries = writes.select(key, seq, F.explode("value").alias("name", "v")).filter(F.col("v").isNotNull())
    return entries.groupBy(key, "name").agg(F.max_by("v", seq).alias("value"))


def deactivate_keys(keys: DataFrame, removed: DataFrame) -> DataFrame:
    """Soft delete: removed keys of their own user become inactive."""
    gone = removed.select("id", "user_id").distinct().withColumn("_gone", F.lit(True))
    out = keys.join(gone, ["id", "user_id"], "left")
    return out.withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def latest_provider_key(writes: DataFrame) -> DataFrame:
    """One stored key per user and provider; the newest write wins, the first sets created_at."""
    rest = [c for c in writes.columns if c not in ("user_id", "provider", "seq")]
    return writes.groupBy("user_id", "provider").agg(
        *[F.max_by(c, "seq").alias(c) for c in rest], F.min("written_at").alias("created_at"))
