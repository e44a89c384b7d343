"""The store of runs: upserts that enrich and never erase, the lists over it, and the backfill of a window's sessions.

Upserts take all saves of a key with their arrival number and give the stored row; each is one aggregate that combines
before the shuffle. Lists take the stored tables.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stage
from . import correlation as N
from .merge import earliest, latest
from .usage import checked

ENTITY_LISTS = {"issue": "issues", "change_request": "change_requests", "review": "reviews", "commit": "commits", "merge_event": "merge_events"}
STATUS = ("running", "completed", "failed")
PROVIDERS = ("github", "gitlab")
REASONS = ("ambiguous", "unmatched")


def upsert(saves: DataFrame, key: list[str], arrival: str = "arrival_seq", first=(), last=(), earliest_=(), latest_=(), greatest=(), appended=(), seen: str | None = None) -> DataFrame:
    """One row for each key. first and last: the first and last save's value, null too; earliest_, latest_: the first and last that isn't null;
    greatest: the greatest; appended: all, in order of arrival; seen: a time, of which first_seen and last_seen are given."""
    texts = [F.transform(F.sort_array(F.collect_list(F.struct(F.col(arrival).alias("a"), F.col(c).alias("v")))), lambda x: x["v"]).alias(c) for c in appended]
    times = [F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at")] if seen else []
    return saves.groupBy(*key).agg(
        *[F.min_by(c, arrival).alias(c) for c in first], *[F.max_by(c, arrival).alias(c) for c in last], *[earliest(c, arrival).alias(c) for c in earliest_],
        *[latest(c, arrival).alias(c) for c in latest_], *[F.max(c).alias(c) for c in greatest], *texts, *times)


def run_upsert(saves: DataFrame) -> DataFrame:
    """A run's status is the last one told; its start the first, its end, title and outcome the last that is known."""
    return upsert(saves, ["run_id"], first=["provider"], last=["status"], earliest_=["started_at"], latest_=["title", "finished_at", "outcome_status"], seen="seen_at")


def session_link_upsert(saves: DataFrame) -> DataFrame:
    return upsert(saves, ["run_id", "external_session_id"], earliest_=["started_at"], latest_=["session_id", "finished_at"], seen="seen_at")


def unresolved_upsert(saves: DataFrame) -> DataFrame:
    """Open questions: the confidence rises, evidence is added to, reason, candidates and version are the last that are known."""
    key = ["provider", "repository", "entity_type", "external_id", "run_id", "method"]
    return upsert(saves, key, greatest=["confidence"], appended=["evidence"], latest_=["reason", "candidates", "resolver_version"], seen="seen_at").drop("last_seen_at").withColumnRenamed("first_seen_at", "created_at")


def association_upsert(saves: DataFrame) -> DataFrame:
    """A resource and a session: the session's own id is filled in once it's known, and then stays."""
    return upsert(saves, ["provider", "repository", "resource_type", "resource_number", "external_session_id"], first=["source_reference"], earliest_=["session_id"], seen="seen_at")


def between(rows: DataFrame, column: str, start: datetime | None, end: datetime | None) -> DataFrame:
    """Rows whose time is known and lies between start and end, both included; None is no bound."""
    if start and end and start > end:
        raise ValueError("start is after end")
    if start:
        rows = rows.where(F.col(column) >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col(column) <= F.lit(end).cast("timestamp"))
    return rows


def runs(stored: DataFrame, links: DataFrame, repository: str | None = None, status: str | None = None, outcome: str | None = None, origin: str | None = None,
         started: tuple = (None, None), finished: tuple = (None, None), seen: tuple = (None, None)) -> DataFrame:
    """Stored runs; of a repository those that any link names it for."""
    if status is not None:
        stored = stored.where(F.col("status") == checked(status, STATUS, "status"))
    if outcome is not None:
        stored = stored.where(F.col("outcome_status") == outcome)
    if origin is not None:
        stored = stored.where(F.col("provider") == checked(origin, PROVIDERS, "origin"))
    for column, bounds in (("started_at", started), ("finished_at", finished), ("last_seen_at", seen)):
        stored = between(stored, column, *bounds)
    if repository is not None:
        stored = stored.join(links.where(F.col("repository") == repository).select("run_id").distinct(), "run_id", "left_semi")
    return stored


def entities(links: DataFrame) -> DataFrame:
    """Links with the entity's id as shown, and whether they are provisional."""
    return links.withColumn("entity_id", C.entity_display(F.col("entity_type"), F.col("external_id"))).withColumn("provisional", C.provisional(F.col("role")))


def correlations(unresolved: DataFrame, reason: str | None = None) -> DataFrame:
    rows = unresolved.withColumn("entity_id", C.entity_display(F.col("entity_type"), F.col("external_id"))).withColumn("provisional", F.lit(True))
    return rows if reason is None else rows.where(F.col("reason") == checked(reason, REASONS, "reason"))


def run_details(stored: DataFrame, links: DataFrame, run_sessions: DataFrame, sessions: DataFrame, totals: DataFrame) -> DataFrame:
    """Runs with a list for each kind of entity (links that aren't superseded), their sessions in order of start, agents and sums."""
    shown = entities(links.where("not superseded"))
    item = F.struct("external_id", "entity_id", "role", "provisional", "repository")
    lists = shown.groupBy("run_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("entity_type") == k, item))).alias(v) for k, v in ENTITY_LISTS.items()])
    rows = run_sessions.join(sessions.select("session_id", "agent"), "session_id", "left").join(totals, "session_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = F.struct(F.col("started_at").isNull().alias("open"), "started_at", "external_session_id", "session_id", "finished_at", "agent")
    used = rows.groupBy("run_id").agg(
        F.sort_array(F.collect_list(one)).alias("sessions"), F.array_sort(F.collect_set(F.nullif("agent", F.lit("")))).alias("agents"), F.count("*").alias("session_count"), zero("message_count").alias("message_count"),
        *[zero(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")], F.sum("estimated_cost_usd").alias("estimated_cost_usd"))
    return stored.join(lists, "run_id", "left").join(used, "run_id", "left").withColumn("active_tokens", F.col("input_tokens") + F.col("output_tokens"))


def session_links(run_sessions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Links between runs and sessions, all provisional, with the session's agent."""
    return run_sessions.join(sessions.select("session_id", "agent"), "session_id", "left").withColumn("provisional", F.lit(True))


def read_back(links: DataFrame, stored_entities: DataFrame, events: DataFrame, run_sessions: DataFrame) -> DataFrame:
    """Runs as stored: of the links that aren't superseded, numbers of links, distinct entities, links with a method, events of linked entities, and sessions."""
    live = links.where("not superseded").select("run_id", "entity_id", "method").distinct()
    there = live.join(stored_entities.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("run_id").agg(F.countDistinct("entity_id").alias("entities"))
    seen = live.select("run_id", "entity_id").distinct().join(events.groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id").groupBy("run_id").agg(F.sum("n").alias("events"))
    counts = live.groupBy("run_id").agg(F.count("*").alias("links"), F.count("method").alias("correlations"))
    own = run_sessions.groupBy("run_id").agg(F.count("*").alias("sessions"))
    return counts.join(there, "run_id", "left").join(seen, "run_id", "left").join(own, "run_id", "left").fillna(0, ["entities", "events", "sessions"])


ENTITY_KEY = ["provider", "repository", "entity_type", "external_id"]


def run_documents(stored: DataFrame, links: DataFrame, events: DataFrame, run_sessions: DataFrame) -> DataFrame:
    """Each run as one nested row: its own columns, entities, entity_links, correlations, events, session_links and the outcome.

    Links that are superseded don't count. An entity is there once, a link for each row, a correlation for each link with a
    method, the events of all linked entities by provider, repository, type and id. All parts of a run meet in one shuffle by
    run; events come to their runs by a join on the entity's key before."""
    name = C.entity_display(F.col("entity_type"), F.col("external_id"))
    live = links.where("not superseded").withColumn("entity_id", name)
    entity = F.struct("entity_id", *ENTITY_KEY, "owning_change_request_id")
    link = F.struct("entity_id", "role", "confidence", "source")
    found = F.when(F.col("method").isNotNull(), F.struct(F.concat_ws(":", "run_id", "entity_id").alias("correlation_id"), "entity_id", "confidence", "method", "evidence"))
    parts = {"entities": entity, "entity_links": link, "correlations": found}
    of_links = live.select("run_id", *[v.alias(k) for k, v in parts.items()])
    happened = events.join(live.select("run_id", *ENTITY_KEY).distinct(), ENTITY_KEY).withColumn("entity_id", name)
    of_events = happened.select("run_id", F.struct("occurred_at", F.concat_ws(":", "entity_id", "event_type").alias("event_id"), "event_type", "provider", "entity_id", "actor", "payload").alias("events"))
    of_sessions = run_sessions.select("run_id", F.struct("external_session_id", "session_id", "started_at", "finished_at").alias("session_links"))
    own = stored.select("run_id", F.struct(*[c for c in stored.columns if c != "run_id"]).alias("run"))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [own, of_links, of_events, of_sessions])
    lists = [F.sort_array(F.collect_set("entities")).alias("entities"), *[F.sort_array(F.collect_list(c)).alias(c) for c in ("entity_links", "correlations", "events", "session_links")]]
    return every.groupBy("run_id").agg(F.max("run").alias("run"), *lists).where("run is not null").select("run_id", "run.*", "entities", "entity_links", "correlations", "events", "session_links")


def bindings_by_job(bindings: DataFrame, jobs: DataFrame) -> DataFrame:
    """The stored binding of each requested job; ids must be numbers."""
    return jobs.where(F.col("job_id").rlike(r"^\d+$")).select("job_id").distinct().join(bindings, "job_id")


def bindings_for_resource(bindings: DataFrame, provider: str | None = None, repository_url: str | None = None, resource_type: str = "change_request") -> DataFrame:
    """Bindings of change requests with their place in the resource's history, earliest first."""
    checked(resource_type, {"change_request"}, "resource_type")
    rows = bindings.withColumn("repository", C.repository(F.col("repository_url"))).where(F.col("resource_type") == resource_type)
    if provider is not None:
        rows = rows.where(F.col("provider") == checked(provider, PROVIDERS, "provider"))
    if repository_url is not None:
        rows = rows.where(F.col("repository") == C.repository(F.lit(repository_url)))
    per = F.sort_array(F.collect_list(F.struct("created_at", "binding_id", "job_id", "outcome")))
    return rows.groupBy("provider", "repository", "resource_type", "resource_number").agg(per.alias("history"))


def collector_health(credentials: DataFrame, clients: DataFrame, batches: DataFrame, now: datetime, limit_seconds: int = 300) -> DataFrame:
    """Credentials that aren't revoked: client, last batch, records taken in, state."""
    sums = batches.groupBy("credential_id").agg(F.max("ingested_at").alias("last_heartbeat"), F.sum("record_count").alias("records"))
    rows = credentials.where("revoked_at is null").join(clients.select("client_id", F.col("name").alias("client_name")), "client_id").join(sums, "credential_id", "left")
    return rows.select("credential_id", "client_name", "last_heartbeat", F.coalesce("records", F.lit(0)).alias("records"), C.health(F.col("last_heartbeat"), now, limit_seconds).alias("health"))


def client_list(clients: DataFrame, credentials: DataFrame) -> DataFrame:
    """Clients with their numbers of valid and revoked tokens."""
    n = credentials.groupBy("client_id").agg(F.count(F.when(F.col("revoked_at").isNull(), 1)).alias("tokens"), F.count("revoked_at").alias("revoked_tokens"))
    return clients.join(n, "client_id", "left").fillna(0, ["tokens", "revoked_tokens"])


def source_cursors(databases: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is known of each source database asked for; found is false for unknown ones."""
    return wanted.select("source_database_id").distinct().join(databases.withColumn("_there", F.lit(True)), "source_database_id", "left").withColumn("found", F.col("_there").isNotNull()).drop("_there")


def window_runs(sessions: DataFrame, contexts: DataFrame, since: datetime, until: datetime, scope: Column) -> DataFrame:
    """A run to resolve for each session whose messages meet the window, titled by its context; scope: the repository searched for it."""
    a, b = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    rows = sessions.where((F.col("first_message_at") <= b) & (F.col("last_message_at") >= a)).join(contexts.select("source_database_id", "external_session_id", "title"), ["source_database_id", "external_session_id"], "left")
    ms = F.unix_millis(F.coalesce("first_message_at", a))
    return rows.select(scope.alias("scope"), C.ulid(ms, F.col("session_id").cast("string")).alias("run_id"), "session_id", "title", F.col("first_message_at").alias("started_at"), F.col("last_message_at").alias("finished_at"))


def remapped(links: DataFrame, stored_links: DataFrame) -> DataFrame:
    """Links re-keyed to the stored run (of the smallest id) that already resolved the same change request, where there is one."""
    claimed = stored_links.where("role = 'resolved' and entity_type = 'change_request'").groupBy("entity_id").agg(F.min("run_id").alias("_claimed"))
    own = links.where((F.col("role") == "resolved") & F.col("entity_id").startswith("change_request:")).join(claimed, "entity_id").groupBy("scope", "run_id").agg(F.min("_claimed").alias("_claimed"))
    return links.join(own, ["scope", "run_id"], "left").withColumn("run_id", F.coalesce("_claimed", "run_id")).drop("_claimed")


def backfill(runs_: DataFrame, entities_: DataFrame, events: DataFrame, stored_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A window's runs resolved like live ones: their links, re-keyed where a stored run has their change request, and the report's counts.

    What is found is staged, as links and report read it twice each; runs_, entities_ and events are read many times too."""
    found = stage(N.correlate(runs_, entities_, events), "found")
    links = remapped(found.withColumn("role", N.role(F.col("confidence"))), stored_links)
    open_ = N.unresolved(runs_, entities_, found)
    n = lambda r: F.count(F.when(F.col("reason") == r, 1)).alias(r)
    key = F.lit(1).alias("_one")
    report = N.match_buckets(found).withColumn("_one", key).join(open_.agg(n("ambiguous"), n("unmatched")).withColumn("_one", key), "_one").drop("_one")
    return links, report


def last_window(now: datetime, seconds: int = 86_400) -> tuple[datetime, datetime]:
    """The window that the periodic reconciliation fetches again."""
    return now - timedelta(seconds=seconds), now
