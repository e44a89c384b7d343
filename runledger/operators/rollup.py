"""Rollups by client, project and day, their verification and repair, and the reconciliation of duplicate events."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from . import usage as U
from .usage import one_project

KEY = ["client_id", "project_id", "day"]
SUMS = ["input_tokens", "output_tokens", "estimated_cost_usd", "message_count"]


def build(facts: DataFrame) -> DataFrame:
    """Additive measures by client, project and UTC day; facts without project don't count, unknown cost is 0."""
    return facts.where("project_id is not null").groupBy("client_id", "project_id", F.to_date("reported_at").alias("day")).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.coalesce("estimated_cost_usd", F.lit(0).cast("decimal(18,6)"))).alias("estimated_cost_usd"), F.count("*").alias("message_count"))


def _labels(clients: DataFrame, projects: DataFrame, rows: DataFrame) -> DataFrame:
    p = one_project(projects).select(F.col("client_id"), F.col("external_project_id").alias("project_id"), "display_name", "name", "worktree")
    c = clients.select("client_id", F.coalesce("canonical_name", "name").alias("client_name"))
    label = C.project_label(F.col("display_name"), F.col("name"), F.col("worktree"), F.col("project_id"))
    return rows.join(p, ["client_id", "project_id"], "left").join(c, "client_id", "left").withColumn("group_value", F.concat("client_name", F.lit("|"), label)).drop("display_name", "name", "worktree")


def client_project(rollup: DataFrame, facts: DataFrame, clients: DataFrame, projects: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Usage by client and project: sums from the rollup, distinct counts from the facts; whole days, both ends included."""
    def days(df: DataFrame, c: Column) -> DataFrame:
        df = df.where(c >= F.lit(start)) if start else df
        return df.where(c <= F.lit(end)) if end else df

    sums = _labels(clients, projects, days(rollup, F.col("day"))).groupBy("group_value").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.lit(0).cast("long").alias("cached_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"))
    seen = days(facts.where("project_id is not null"), F.to_date("reported_at"))
    counts = _labels(clients, projects, seen).groupBy("group_value").agg(F.countDistinct("session_id").alias("session_count"), F.countDistinct("model_name").alias("model_count"))
    return sums.join(counts, "group_value", "left").fillna(0, ["session_count", "model_count"])


def from_rollup(group_by: list[str], model: str | None = None, session_id=None) -> bool:
    """Whether the rollup answers: it has clients, projects and days, and neither models nor sessions to filter by."""
    return set(group_by) == {"client", "project"} and model is None and session_id is None


def aggregates(rollup: DataFrame, facts: DataFrame, group_by: list[str], clients: DataFrame, projects: DataFrame, sessions: DataFrame, start: date | None = None, end: date | None = None,
               client_id=None, model: str | None = None, session_id=None) -> DataFrame:
    """Usage by dimensions, filtered; whole days, both ends included. The stored rollup is read where it can answer, else the facts."""
    if from_rollup(group_by, model, session_id):
        of = (lambda df: df) if client_id is None else lambda df: df.where(F.col("client_id") == client_id)
        return client_project(of(rollup), of(facts), clients, projects, start, end)
    rows = U.window(facts, datetime.combine(start, time.min) if start else None, datetime.combine(end, time.max) if end else None, client_id=client_id, model_name=model, session_id=session_id)
    return U.aggregates(rows, group_by, clients=clients, sessions=sessions, projects=projects)


def disagreements(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """Keys where the stored rollup and the facts differ, with the action that repairs them: insert, update or delete."""
    a = stored.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in SUMS], F.lit(True).alias("_old"))
    b = build(facts).withColumn("_new", F.lit(True))
    both = a.join(b, KEY, "full_outer")
    same = F.lit(True)
    for c in SUMS:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(c))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~same, "update")
    return both.withColumn("action", action).where("action is not null").drop("_old", "_new")


def repair(stored: DataFrame, facts: DataFrame, limit: int | None = None) -> DataFrame:
    """The rollup as it should be: groups that agree stay, the others are rebuilt or go. limit: of those to be rebuilt so many, the first by key; the rest stay as they are."""
    wrong = disagreements(stored, facts)
    if limit is not None:
        now = wrong.where("action <> 'delete'").orderBy(*KEY).limit(limit)
        wrong = now.unionByName(wrong.where("action = 'delete'"))
    kept = stored.select(*KEY, *SUMS).join(wrong.select(*KEY), KEY, "left_anti")
    return kept.unionByName(wrong.where("action <> 'delete'").select(*KEY, *SUMS))


def ranked(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Events with their rank among those of the same key (1: canonical) and how many there are."""
    return events.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).withColumn("members", F.count("*").over(W.partitionBy(*key)))


def duplicate_groups(events: DataFrame, key: list[str]) -> DataFrame:
    return events.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1")


def preview(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row: what dropping all but the first of each group would change."""
    extra = ranked(events, key, order).where("rank > 1")
    return extra.agg(F.count("*").alias("events_to_merge"), F.countDistinct("session_id").alias("affected_sessions"),
                     (-F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0))).alias("token_change"), (-F.coalesce(F.sum("estimated_cost_usd"), F.lit(0))).alias("cost_change"))


def canonical(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The events that stay: the first of each group."""
    return ranked(events, key, order).where("rank = 1").drop("rank", "members")


def detached(attempts: DataFrame, kept: DataFrame, event: str = "event_id") -> DataFrame:
    """Attempts, whose event is null where it went."""
    there = kept.select(event).distinct().withColumn("_there", F.lit(True))
    return attempts.join(there, event, "left").withColumn(event, F.when(F.col("_there"), F.col(event))).drop("_there")


def rebuild_sessions(events: DataFrame) -> DataFrame:
    """Session sums from events; the message count isn't rebuilt."""
    names = ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")
    return events.groupBy("session_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names], F.sum("estimated_cost_usd").alias("estimated_cost_usd"))


def sum_mismatches(stored: DataFrame, events: DataFrame, column: str) -> DataFrame:
    """Sessions whose stored sum isn't that of their events."""
    again = events.groupBy("session_id").agg(F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("recomputed"))
    return stored.select("session_id", F.col(column).alias("stored")).join(again, "session_id").where("stored <> recomputed")
