"""The periodic reconciliation: one bounded window of the forge and of the sessions is fetched again, resolved and saved.

A run is a batch job that a scheduler starts; it fetches first and writes last. What it saves goes to versioned snapshots by
key, so a window that is run again, or overlaps the last one, leaves the same rows: a run's row is enriched and never
erased, its links are replaced together, events are added once. A job that breaks off leaves the versions before it; the
next run repairs what is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import outcomes as O
from ..session import drop, stage
from ..sources.tables import Snapshot

RUN = "run_id string, scope string, session_id long, title string, started_at timestamp, finished_at timestamp, seen_at timestamp"
LINK = "scope string, run_id string, entity_id string, entity_type string, confidence double, method string, role string"
EVENT = "scope string, entity_id string, event_id string, event_type string, occurred_at timestamp, payload string"


@dataclass
class Stores:
    """What the reconciliation brings up to date."""
    runs: Snapshot
    links: Snapshot
    events: Snapshot

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int = 64) -> Stores:
        path = path.rstrip("/")
        return cls(Snapshot(spark, f"{path}/runs", RUN, ["run_id"], buckets), Snapshot(spark, f"{path}/links", LINK, ["run_id"], buckets), Snapshot(spark, f"{path}/events", EVENT, ["scope", "event_id"], buckets))


def enriched(old: DataFrame, new: DataFrame) -> DataFrame:
    """Runs after a window's: start and scope stay as first known, title and end follow the last that is known."""
    rows = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return rows.groupBy("run_id").agg(*[M.earliest(c, "_n").alias(c) for c in ("scope", "session_id", "started_at")], *[M.latest(c, "_n").alias(c) for c in ("title", "finished_at", "seen_at")])


def reconcile(stores: Stores, sessions: DataFrame, contexts: DataFrame, scope: Column, fetch_entities: Callable[[datetime, datetime], DataFrame], fetch_events: Callable[[datetime, datetime], DataFrame],
              now: datetime, seconds: int = 86_400, dry_run: bool = False) -> DataFrame:
    """One window: the report of its links (explicit, high, inferred, ambiguous, unmatched), after they are saved.

    fetch_*: entities (as correlation takes them) and events of a window. dry_run: the report alone."""
    since, until = O.last_window(now, seconds)
    entities, events = stage(fetch_entities(since, until), "entities"), stage(fetch_events(since, until), "events")
    runs = stage(O.window_runs(sessions, contexts, since, until, scope), "runs")
    known = stores.links.read()
    links, report = O.backfill(runs, entities, events, known)
    links, report = stage(links, "links"), stage(report, "report")
    if not dry_run:
        kind = F.substring_index("entity_id", ":", 1)
        stores.events.upsert(events.dropDuplicates(["scope", "event_id"]), lambda old, new: old.unionByName(new.select(*old.columns)).dropDuplicates(["scope", "event_id"]))
        stores.runs.upsert(runs.withColumn("seen_at", F.lit(now).cast("timestamp")).select(*stores.runs.schema.names), enriched)
        fresh = links.withColumn("entity_type", kind).select(*stores.links.schema.names)
        stores.links.replace(fresh.select("run_id").distinct(), fresh.distinct())
    drop(entities, events, runs, links)
    return report
