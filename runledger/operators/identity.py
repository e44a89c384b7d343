"""Source identities: canonical parents, records that several identities own, and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(rows: DataFrame, identities: DataFrame, identity: str = "identity_id") -> DataFrame:
    """rows with canonical_id: the identity's parent if it has one (one step only), else itself."""
    parents = identities.select(F.col("identity_id").alias(identity), "canonical_parent_id")
    return rows.join(parents, identity, "left").withColumn("canonical_id", F.coalesce("canonical_parent_id", identity)).drop("canonical_parent_id")


def unresolved(identities: DataFrame) -> DataFrame:
    """Identities without a canonical parent."""
    return identities.where("canonical_parent_id is null")


def overlaps(owned: DataFrame, identities: DataFrame) -> DataFrame:
    """identity_id, other_id, shared: how many records two unresolved identities of one client both own.

    owned: client_id, identity_id, source_record_id. The owners of a record are collected once and paired, so the join
    goes over records, of which each has as many owners as there are identities at most."""
    single = owned.join(unresolved(identities).select("identity_id"), "identity_id", "left_semi").select("client_id", "source_record_id", "identity_id").distinct()
    pairs = single.join(single.withColumnRenamed("identity_id", "other_id"), ["client_id", "source_record_id"]).where("identity_id <> other_id")
    return pairs.groupBy("identity_id", "other_id").agg(F.count("*").alias("shared"))


def first_owner(owned: DataFrame, arrival: str = "arrival_seq") -> DataFrame:
    """The identity that delivered a client's record first."""
    return owned.groupBy("client_id", "source_record_id").agg(F.min(F.struct(arrival, "identity_id")).alias("o")).select("client_id", "source_record_id", F.col("o.identity_id").alias("owner_id"))


def quarantined(batches: DataFrame, owned: DataFrame, identities: DataFrame, active: DataFrame) -> DataFrame:
    """batches (identity_id, client_id, source_record_id, batch) with quarantined and the reason.

    A batch is stopped as a whole where its identity is in quarantine already, or any of its records belongs to
    another identity of the client that isn't resolved."""
    others = owned.join(unresolved(identities).select("identity_id"), "identity_id", "left_semi").select("client_id", "source_record_id", F.col("identity_id").alias("_owner")).distinct()
    hit = (batches.join(others, ["client_id", "source_record_id"]).where("_owner <> identity_id").select("batch", "identity_id").distinct().withColumn("_hit", F.lit(True)))
    held = active.select("identity_id").distinct().withColumn("_held", F.lit(True))
    rows = batches.join(held, "identity_id", "left").join(hit, ["batch", "identity_id"], "left")
    reason = F.when(F.col("_held"), "Record quarantined — source identity has active quarantine").when(F.col("_hit"), "Record quarantined — source identity overlap detected")
    return rows.withColumn("reason", reason).withColumn("quarantined", F.col("reason").isNotNull()).drop("_held", "_hit")


def cross_identity_conflicts(records: DataFrame, owned: DataFrame, identities: DataFrame) -> DataFrame:
    """Records that another unresolved identity of the client owns."""
    others = owned.join(unresolved(identities).select("identity_id"), "identity_id", "left_semi").select("client_id", "source_record_id", F.col("identity_id").alias("_owner"))
    own = F.col("r.client_id").eqNullSafe(F.col("o.client_id")) & (F.col("r.source_record_id") == F.col("o.source_record_id")) & (F.col("r.identity_id") != F.col("o._owner"))
    return records.alias("r").join(others.alias("o"), own, "left_semi")


def lift_quarantine(quarantines: DataFrame, identities: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarantines without those resolved, and identities with the parents that the resolutions name."""
    kept = quarantines.join(resolutions.select("identity_id").distinct(), "identity_id", "left_anti")
    parents = resolutions.groupBy("identity_id").agg(F.max_by("parent_id", "resolved_at").alias("_parent"))
    return kept, identities.join(parents, "identity_id", "left").withColumn("canonical_parent_id", F.coalesce("_parent", "canonical_parent_id")).drop("_parent")
