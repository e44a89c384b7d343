"""The ingest path as one operator: validation, identity, quarantine, first-wins records with replay fill, canonical events, and what they book.

Deliveries come in batches: client_id, source_database_id, batch, seq (orders a client's batches; one batch a number),
idx (the row's place in its batch), source_record_id, session_id and the values of a usage record, tokens as text or
numbers. Every step sees what the ones before it decided, and the state that is stored: a rejected or quarantined row is
never accounted, a quarantined batch's records don't make later batches overlap.

Whether a batch is stopped hangs on earlier batches of its client, which may themselves be stopped. An identity once in
quarantine stays there, so all that matters of an identity is when it was stopped first, and of a record that it shares
with another one the first batch that had it. So records are joined once, on their own key, and come down to one edge
for each batch and other identity; a client's edges are folded in order of time. Batches, not records, meet in a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stage
from ..sources.tables import having
from . import merge as M

RECORD = ["client_id", "source_database_id", "source_record_id"]
EVENT = ["identity", "source_record_id"]
TEXTS = ("provider", "mode", "finish_reason")
FILLED = (*TEXTS, *M.EXTRA_TOKENS)
#: What a row is told.
OVERLAP = "Record quarantined — source identity overlap detected"
HELD = "Record quarantined — source identity has active quarantine"
FILLS = M.IDEMPOTENT + " — enrichment applied"
#: Statuses that a batch counts as accepted.
TAKEN = ("accepted", "duplicate", "updated")


@dataclass
class State:
    """What is stored: records by RECORD, events by EVENT, identities in quarantine (identity), and the parents of resolved ones (identity, parent)."""
    records: DataFrame | None = None
    events: DataFrame | None = None
    held: DataFrame | None = None
    parents: DataFrame | None = None


@dataclass
class Ingested:
    """outcomes: batch, idx, status, reason. records: new ones, as stored (filled by later replays). fills: of stored records, their session and the fields that
    replays filled. credits: session_id and the cache tokens that fills add to it. events: rows booked to events, with outcome. quarantines: identity and seq of the batch that stopped it."""
    outcomes: DataFrame
    records: DataFrame
    fills: DataFrame
    credits: DataFrame
    events: DataFrame
    quarantines: DataFrame


def identified(deliveries: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Deliveries with identity (client/database, or its parent where it has one)."""
    own = F.concat_ws("/", "client_id", "source_database_id")
    if parents is None:
        return deliveries.withColumn("identity", own)
    named = parents.select(F.col("identity").alias("_own"), "parent")
    return deliveries.withColumn("_own", own).join(named, "_own", "left").withColumn("identity", F.coalesce("parent", "_own")).drop("_own", "parent")


def stopped(rows: DataFrame, state: State) -> DataFrame:
    """client_id, identity, since: from which batch on an identity of valid rows is in quarantine (-1: before all of them).

    One shuffle by record: a window tells the records that several identities have, and only those become arrays, from which pairs are made in place."""
    key = ["client_id", "source_record_id"]
    resolved = state.parents.select("identity").distinct() if state.parents is not None else None
    known = rows.select("client_id", "identity").distinct()
    seen = rows.select(*key, "identity", "seq", F.lit(False).alias("old"))
    if state.events is not None:  # a stored event counts whatever becomes of its owner
        seen = seen.unionByName(state.events.select(*key, "identity", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("old")))
    of_record = W.partitionBy(*key)
    several = seen.where("source_record_id is not null").withColumns({"_low": F.min("identity").over(of_record), "_high": F.max("identity").over(of_record)}).where("_low < _high")
    lists = several.groupBy(*key).agg(F.collect_set(F.struct("identity", "old", "seq")).alias("every"))
    owner = lambda o: F.struct(o["identity"].alias("other"), F.array_min(F.transform(F.filter("every", lambda x: (x["identity"] == o["identity"]) & (x["old"] == o["old"])), lambda x: x["seq"])).alias("since"), F.when(~o["old"], o["identity"]).alias("by"))
    names = F.array_distinct(F.transform("every", lambda x: F.struct(x["identity"].alias("identity"), x["old"].alias("old"))))
    owners = lists.select("client_id", "every", F.inline(F.transform(names, owner)))
    if resolved is not None:
        owners = owners.join(resolved.withColumnRenamed("identity", "other"), "other", "left_anti")
    met = owners.select("client_id", "other", "since", "by", F.inline("every")).where("not old and other <> identity and since < seq")
    edges = met.groupBy("client_id", "by", "since", "identity").agg(F.min("seq").alias("seq")).groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("seq", "since", "by", "identity"))).alias("edges"))
    held = having(known, state.held, ["identity"]) if state.held is not None else known.limit(0)
    start = held.groupBy("client_id").agg(F.map_from_entries(F.collect_list(F.struct("identity", F.lit(-1).cast("long")))).alias("start"))
    free = F.lit((1 << 63) - 1)

    def step(since: Column, e: Column) -> Column:
        at = lambda who: F.coalesce(F.try_element_at(since, who), free)
        hit = (e["by"].isNull() | (e["since"] < at(e["by"]))) & (e["seq"] < at(e["identity"]))
        return F.when(hit, F.map_concat(F.map_filter(since, lambda k, v: k != e["identity"]), F.map_from_arrays(F.array(e["identity"]), F.array(e["seq"])))).otherwise(since)

    none = F.expr("cast(map() as map<string,bigint>)")
    return (edges.join(start, "client_id", "full_outer").select("client_id", F.aggregate(F.coalesce("edges", F.expr("cast(array() as array<struct<seq:bigint,since:bigint,by:string,identity:string>>)")), F.coalesce("start", none), step).alias("since"))
            .select("client_id", F.explode("since").alias("identity", "since")))


def rated(kept: DataFrame, state: State) -> DataFrame:
    """Deliveries that count and the stored rows (seq -1), each held against its record and its event, by windows that share one shuffle.

    All deliveries of a record and of an event name one source_record_id, so rows are dealt by that alone. stored: null for deliveries,
    else record or event. head: the first row of its record; it alone carries first_ (the record's values) and fill_ (what replays
    fill of them). is_first, same, fills and outcome (null where nothing is booked to an event) are said of deliveries."""
    values = [*M.BASE_TOKENS, "estimated_cost_usd", "session_id", *FILLED]
    rows = kept.select(*RECORD, "identity", "batch", "seq", "idx", *values, F.lit(None).cast("string").alias("stored"))
    before = {"seq": F.lit(-1).cast("long"), "idx": F.lit(-1).cast("long")}
    if state.records is not None:
        rows = rows.unionByName(state.records.select(*RECORD, *values).withColumns(before | {"stored": F.lit("record")}), allowMissingColumns=True)
    if state.events is not None:
        rows = rows.unionByName(state.events.select(*EVENT, "client_id", "session_id", *M.DELTA_FIELDS).withColumns(before | {"stored": F.lit("event")}), allowMissingColumns=True)
    rows = rows.repartition("source_record_id").withColumn("_event", F.coalesce(F.col("stored") == "event", F.lit(False)))
    delivery = F.col("stored").isNull()

    # records: the first wins, equal ones fill what it lacks
    by = W.partitionBy(*RECORD, "_event").orderBy("seq", "idx")
    first = {c: F.first(c).over(by.rowsBetween(W.unboundedPreceding, 0)) for c in values}
    rows = rows.withColumns({"head": (F.row_number().over(by) == 1) & ~F.col("_event"), "replays_stored": F.first("seq").over(by.rowsBetween(W.unboundedPreceding, 0)) < 0, **{f"first_{c}": v for c, v in first.items()}})
    same = M.same_cost(F.col("estimated_cost_usd"), F.col("first_estimated_cost_usd"))
    for c in M.BASE_TOKENS:
        same = same & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    rows = rows.withColumn("is_first", F.col("head") & delivery).withColumn("same", delivery & (F.col("is_first") | same))
    gives = {c: F.when(F.col("same") & ~F.col("is_first") & F.col(f"first_{c}").isNull(), F.col(c)) for c in FILLED}
    rows = rows.withColumns({f"fill_{c}": F.first(v, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for c, v in gives.items()}
                            | {f"_late_{c}": F.count(v).over(by.rowsBetween(W.unboundedPreceding, -1)) > 0 for c, v in gives.items()})
    fills = F.lit(False)
    for c, v in gives.items():
        fills = fills | (v.isNotNull() & ~F.col(f"_late_{c}"))
    only = {c: F.when(F.col("head"), F.col(c)) for c in [f"first_{c}" for c in values] + [f"fill_{c}" for c in FILLED]}
    rows = rows.withColumns({"fills": fills, **only}).drop(*[f"_late_{c}" for c in FILLED])

    # events: winners, and replays of records that have none yet; where there is one, records alone account for a replay
    step = F.col("_event") | F.col("is_first") | (F.col("same") & F.col("replays_stored"))
    of_event = W.partitionBy(*EVENT).orderBy("seq", "idx").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_step", step).withColumn("_counts", F.col("_step") & (F.col("is_first") | (F.count(F.when(F.col("_step"), 1)).over(of_event) == 0)))
    return M.delta_outcomes(rows, EVENT, arrival=["seq", "idx"], counts=F.col("_counts")).drop("_step", "_counts", "_event", "replays_stored")


def ingest(deliveries: DataFrame, state: State, keep: bool = True) -> Ingested:
    """What becomes of each delivery, and what is to be stored of all. deliveries are read four times, so they should be stored.

    keep: what several results hang on is staged; without it each result is made anew, which is right for a caller of one of them."""
    rows = M.validate_tokens(identified(deliveries, state.parents))
    numbers = {c: F.col(c).try_cast("long") for c in (*M.BASE_TOKENS, *M.EXTRA_TOKENS)}
    valid = rows.where("reason is null").withColumns(numbers).withColumns({c: C.blank_to_null(F.col(c)) for c in TEXTS})
    valid = valid.withColumn("cached_tokens", C.cached_tokens(F.col("cache_read_tokens"), F.col("cache_write_tokens"), F.col("cached_tokens")))
    since = stage(stopped(valid, state), "stopped")
    kept = valid.join(since, ["client_id", "identity"], "left").where("since is null or seq < since").drop("since")
    bad = F.col("reason").isNotNull()
    told = rows.join(since, ["client_id", "identity"], "left").where(bad | (F.col("seq") >= F.col("since"))).select(
        "batch", "idx", F.when(bad, "rejected").otherwise("quarantined").alias("status"), F.when(bad, F.col("reason")).when(F.col("seq") == F.col("since"), OVERLAP).otherwise(HELD).alias("reason"))
    every = rated(kept, state)
    every = stage(every, "rated") if keep else every

    heads = every.where("head")
    filled = F.lit(False)
    for c in FILLED:
        filled = filled | F.col(f"fill_{c}").isNotNull()
    new = heads.where("is_first").select(*RECORD, *[F.col(f"first_{c}").alias(c) for c in ("session_id", *M.BASE_TOKENS, "estimated_cost_usd")], *[F.coalesce(f"first_{c}", f"fill_{c}").alias(c) for c in FILLED])
    late = heads.where(filled)
    add = lambda c: F.sum(F.greatest(F.coalesce(f"fill_{c}", F.lit(0)), F.lit(0))).alias(c)
    credits_ = late.groupBy(F.col("first_session_id").alias("session_id")).agg(add("cache_read_tokens"), add("cache_write_tokens")).where("session_id is not null and cache_read_tokens + cache_write_tokens > 0")
    fills = late.where("stored = 'record'").select(*RECORD, F.col("first_session_id").alias("session_id"), *[F.col(f"fill_{c}").alias(c) for c in FILLED])
    own = every.where("stored is null")
    events = own.where("outcome is not null").select(*EVENT, "batch", "idx", F.struct("seq", "idx").alias("arrival"), "client_id", "session_id", *M.DELTA_FIELDS, "outcome")
    status = F.when(F.col("outcome") == "created", "accepted").otherwise(F.coalesce("outcome", F.when(F.col("same"), "accepted").otherwise("conflict")))
    accounted = own.select("batch", "idx", status.alias("status"), F.when(F.col("is_first"), F.lit(None)).when(~F.col("same"), M.DIVERGENT).when(F.col("fills"), FILLS).otherwise(M.IDEMPOTENT).alias("reason"))
    return Ingested(told.unionByName(accounted), new, fills, credits_, events, since.where("since >= 0").select("identity", F.col("since").alias("seq")))


def ledger(outcomes: DataFrame) -> DataFrame:
    """Each batch's number of records, and how many were taken or not."""
    taken = F.col("status").isin(*TAKEN)
    return outcomes.groupBy("batch").agg(F.count("*").alias("records"), F.count(F.when(taken, 1)).alias("accepted"), F.count(F.when(~taken, 1)).alias("rejected"))


def advance(state: State, done: Ingested) -> State:
    """The state after a call: its tables as DataFrames, for the caller to store."""
    records = done.records
    if state.records is not None:
        fills = done.fills.select(*RECORD, *[F.col(c).alias(f"_{c}") for c in FILLED])
        records = state.records.join(fills, RECORD, "left").select(*RECORD, "session_id", *M.BASE_TOKENS, "estimated_cost_usd", *[F.coalesce(c, f"_{c}").alias(c) for c in FILLED]).unionByName(records)
    last = done.events.groupBy(*EVENT).agg(F.min_by("client_id", "arrival").alias("client_id"), F.min_by("session_id", "arrival").alias("session_id"), *[M.latest(c, "arrival").alias(c) for c in M.DELTA_FIELDS])
    events = last
    if state.events is not None:
        both = state.events.select(*EVENT, "client_id", "session_id", *M.DELTA_FIELDS, F.lit(0).alias("_n")).unionByName(last.withColumn("_n", F.lit(1)))
        events = both.groupBy(*EVENT).agg(F.min_by("client_id", "_n").alias("client_id"), F.min_by("session_id", "_n").alias("session_id"), *[M.latest(c, "_n").alias(c) for c in M.DELTA_FIELDS])
    held = done.quarantines.select("identity")
    return State(records, events, held if state.held is None else state.held.select("identity").unionByName(held), state.parents)
