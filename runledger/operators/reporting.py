"""Deliveries of a code forge: first delivery wins, payloads merge forward by key, resources are what deliveries name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .merge import keep_first

RESOURCE = ["provider", "repository", "resource_type", "number"]


def identified(deliveries: DataFrame, url: str = "repository_url", kind: str = "resource_kind") -> DataFrame:
    """Deliveries with repository and resource_type, where they name a resource."""
    rows = deliveries.withColumn("repository", C.repository(F.col(url))).withColumn("resource_type", C.resource_type(F.col(kind)))
    return rows.where("repository is not null and resource_type is not null and number is not null")


def payload_identity(payload: str = "payload") -> dict[str, Column]:
    """repository, resource_type and number of the resource that a delivery's payload names; all null where it names none in full.

    Producers say type and number; deliveries written back say resource_type and resource_number. A number is text or a
    whole number, and not a truth value."""
    part = lambda *names: F.coalesce(*[F.when(F.trim(x) != "", F.trim(x)) for x in (F.get_json_object(payload, f"$.resource.{n}") for n in names)])
    repo, kind, number = C.repository(part("repository_url")), C.resource_type(part("type", "resource_type")), part("number", "resource_number")
    number = F.when(~number.isin("true", "false"), number)
    whole = repo.isNotNull() & kind.isNotNull() & number.isNotNull()
    return {"repository": F.when(whole, repo), "resource_type": F.when(whole, kind), "number": F.when(whole, number)}


def by_payload(deliveries: DataFrame, payload: str = "payload") -> DataFrame:
    """Deliveries with the identity that their payload names; those that name none are left out, as facts without a resource."""
    return deliveries.withColumns(payload_identity(payload)).where("repository is not null")


def first_deliveries(deliveries: DataFrame, order: list[str]) -> DataFrame:
    """Deliveries are immutable: of each provider and id the first stays."""
    return keep_first(deliveries, ["provider", "delivery_id"], [F.col(c) for c in order])


def newest(at: str = "occurred_at", delivery: str = "delivery_id") -> list[Column]:
    """Later times win; of equal ones the smaller delivery id does."""
    return [(-F.unix_micros(at)).alias("_late"), F.col(delivery).alias("_id")]


def forward_merge(deliveries: DataFrame, payload: str = "payload", key: list[str] = RESOURCE) -> DataFrame:
    """Each resource's merged payload (JSON, keys in order), by key the newest value that isn't null, and the last delivery.

    Keys are merged on their own, so the result hangs on no order of arrival. The newest value of a key is an
    aggregate that combines before the shuffle."""
    pairs = deliveries.select(*key, "occurred_at", "delivery_id", F.explode(F.from_json(payload, "map<string,string>")).alias("k", "v")).where("v is not null")
    best = pairs.groupBy(*key, "k").agg(F.min(F.struct(*newest(), F.col("v"))).alias("b")).select(*key, "k", F.col("b.v").alias("v"))
    merged = best.groupBy(*key).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))).alias("merged"))
    last = deliveries.groupBy(*key).agg(F.max("occurred_at").alias("last_occurred_at"), F.min(F.struct(*newest()))["_id"].alias("last_delivery_id"))
    return last.join(merged, key, "left").withColumn("merged", F.coalesce("merged", F.lit("{}")))


def forward_state(deliveries: DataFrame, payload: str = "payload", key: list[str] = RESOURCE) -> DataFrame:
    """What is stored of each resource: by JSON key the value with the time and delivery that wrote it, the last delivery, and how many there were."""
    part = F.from_json(payload, "map<string,string>")
    writer = F.transform_values(F.map_filter(part, lambda k, v: v.isNotNull()), lambda k, v: F.struct(v.alias("value"), F.col("occurred_at"), F.col("delivery_id")))
    none = F.expr("cast(map() as map<string,struct<value:string,occurred_at:timestamp,delivery_id:string>>)")
    return merged_states(deliveries.select(*key, F.coalesce(writer, none).alias("parts"), F.col("occurred_at").alias("last_occurred_at"), F.col("delivery_id").alias("last_delivery_id"), F.lit(1).cast("long").alias("deliveries")), key)


def merged_states(states: DataFrame, key: list[str] = RESOURCE) -> DataFrame:
    """One state of several of a resource, in whatever order they come: by JSON key the newest writer, none of which a null erases.

    The merge is associative and commutative, so states of any sets of different deliveries can be put together, and it
    combines before the shuffle."""
    pairs = states.select(*key, F.explode("parts").alias("k", "w"))
    best = pairs.groupBy(*key, "k").agg(F.min(F.struct((-F.unix_micros("w.occurred_at")).alias("late"), F.col("w.delivery_id").alias("id"), F.col("w"))).alias("b"))
    parts = best.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", F.col("b.w").alias("w"))))).alias("parts"))
    last = states.groupBy(*key).agg(F.max("last_occurred_at").alias("last_occurred_at"), F.min(F.struct(*newest("last_occurred_at", "last_delivery_id")))["_id"].alias("last_delivery_id"), F.sum("deliveries").alias("deliveries"))
    none = F.expr("cast(map() as map<string,struct<value:string,occurred_at:timestamp,delivery_id:string>>)")
    return last.join(parts, key, "left").select(*key, F.coalesce("parts", none).alias("parts"), "last_occurred_at", "last_delivery_id", "deliveries")


def merge_into(stored: DataFrame, new: DataFrame, key: list[str] = RESOURCE) -> DataFrame:
    """The state of resources after new ones: what `Snapshot.upsert` takes as its merge."""
    return merged_states(stored.unionByName(new), key)


def rendered(states: DataFrame, key: list[str] = RESOURCE) -> DataFrame:
    """Each resource's merged payload as JSON, who wrote each key, and its last delivery."""
    writers = F.transform_values("parts", lambda k, w: F.struct(F.date_format(w["occurred_at"], "yyyy-MM-dd'T'HH:mm:ssXXX").alias("occurred_at"), w["delivery_id"].alias("delivery_id")))
    return states.select(*key, "last_occurred_at", "last_delivery_id", "deliveries", F.to_json(F.transform_values("parts", lambda k, w: w["value"])).alias("merged"), F.to_json(writers).alias("key_provenance"))


def resources(deliveries: DataFrame, key: list[str] = RESOURCE) -> DataFrame:
    """Each resource's newest delivery and number of deliveries."""
    best = F.min(F.struct(*newest())).alias("b")
    return deliveries.groupBy(*key).agg(best, F.max("occurred_at").alias("last_occurred_at"), F.count("*").alias("deliveries")).withColumn("last_delivery_id", F.col("b._id")).drop("b")


def with_delivery_count(deliveries: DataFrame, key: list[str] = RESOURCE) -> DataFrame:
    return deliveries.withColumn("deliveries", F.count("*").over(W.partitionBy(*key)))


def trail(deliveries: DataFrame, key: list[str] = RESOURCE) -> DataFrame:
    """States of each resource in order, those of one time and state once."""
    return deliveries.select(*key, "occurred_at", "state").distinct().groupBy(*key).agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("occurred_at", "state"))), lambda x: x["state"])).alias("states"))


def resource_details(deliveries: DataFrame, key: list[str] = RESOURCE, created: str = "created_at") -> DataFrame:
    """Each resource's last delivery (of equal times that with the greatest id), number of deliveries, and trail of states in order of time and arrival."""
    last = F.max(F.struct("occurred_at", "delivery_id"))
    steps = F.sort_array(F.collect_list(F.struct("occurred_at", created, "state", "delivery_id")))
    return deliveries.groupBy(*key).agg(F.count("*").alias("deliveries"), last["delivery_id"].alias("last_delivery_id"), F.max("occurred_at").alias("last_occurred_at"), steps.alias("state_trail"))


def resource_count(deliveries: DataFrame, key: list[str] = RESOURCE) -> DataFrame:
    return deliveries.select(*key).distinct().agg(F.count("*").alias("resources"))


def exact_associations(references: DataFrame, key: list[str], fields: str = "source_field", session: str = "session_id", order: str = "external_session_id") -> DataFrame:
    """References grouped by key: distinct source fields in order, and the first session id that isn't null."""
    return references.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(fields)), ",").alias("source_fields"),
                                        F.min_by(session, F.when(F.col(session).isNotNull(), F.struct(order, session))).alias(session))
