"""Usage accounting: totals, groupings, record lists, sessions and runs over the fact table.

Facts are one row for each accepted usage record; sessions, clients, models, contexts and projects are dimensions.
Sizes of dimensions aren't assumed: joins are left to the optimiser, which broadcasts what its size check allows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

TOKENS = ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")
DIMENSIONS = ("client", "model", "session", "day", "week", "month", "project", "agent")
SORTS = {"reported_at", "ingested_at", "source_created_at"}


def checked(value: str, allowed, what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(sorted(allowed))}")
    return value


def window(facts: DataFrame, start: datetime | None = None, end: datetime | None = None, half_open: bool = False, **equal) -> DataFrame:
    """Rows reported between start and end, both included (half_open: without end itself), that have the given values; None filters nothing."""
    if start and end and start > end:
        raise ValueError("start is after end")
    if start:
        facts = facts.where(F.col("reported_at") >= F.lit(start).cast("timestamp"))
    if end:
        last = F.lit(end).cast("timestamp")
        facts = facts.where(F.col("reported_at") < last if half_open else F.col("reported_at") <= last)
    for name, value in equal.items():
        if value is not None:
            facts = facts.where(F.col(name) == value)
    return facts


def preset(name: str, now: datetime, start: str | None = None, end: str | None = None) -> tuple[datetime, datetime]:
    """Start and end of a named range of days; "custom" goes from the first moment of start to the last second of end. What isn't known is this month."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    first = day.replace(day=1)
    if name == "custom" and start and end:
        try:
            return datetime.fromisoformat(start), datetime.fromisoformat(end).replace(hour=23, minute=59, second=59)
        except ValueError:
            return first, now
    if name == "last-month":
        return (first - timedelta(days=1)).replace(day=1), first
    if name in ("last-30-days", "last-7-days"):
        return day - timedelta(days=30 if name == "last-30-days" else 7), now
    return first, now


def measured(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's sums, cost, numbers of records, sessions and models, records by provider as JSON, and the share of input read from cache.

    Rows are read once: each counts for its provider, its session and its model, and what these have in common is combined
    before the shuffle. Without keys there is one row, also for no rows."""
    kind = lambda k, value: F.struct(F.lit(k).alias("kind"), value.cast("string").alias("value"))
    kinds = F.array(kind(0, C.provider_key(F.col("provider"))), kind(1, F.col("session_id")), kind(2, F.col("model_name")))
    tagged = rows.select(*keys, *TOKENS, "estimated_cost_usd", F.inline(kinds))
    own = F.col("kind") == 0
    per = tagged.groupBy(*keys, "kind", "value").agg(*[F.sum(F.when(own, F.col(c))).alias(c) for c in (*TOKENS, "estimated_cost_usd")], F.count(F.when(own, 1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.when(own, F.struct(F.col("value").alias("p"), "n"))))
    seen = lambda k: F.count(F.when(F.col("kind") == k, F.col("value")))
    out = per.groupBy(*keys).agg(
        *[F.coalesce(F.sum(t), F.lit(0)).cast("long").alias(t) for t in TOKENS], F.sum("estimated_cost_usd").alias("estimated_cost_usd"), F.coalesce(F.sum("n"), F.lit(0)).alias("message_count"),
        seen(1).alias("session_count"), seen(2).alias("model_count"), F.to_json(F.map_from_entries(entries)).alias("provider_breakdown"))
    return out.withColumn("cache_hit_ratio", C.cache_hit_ratio(F.col("cache_read_tokens"), F.col("input_tokens")))


def one_project(projects: DataFrame) -> DataFrame:
    """One row for each client and project id, that of the smallest source database."""
    w = W.partitionBy("client_id", "external_project_id").orderBy("source_database_id")
    return projects.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "source_database_id")


def with_project_label(rows: DataFrame, projects: DataFrame, project_id: str = "project_id") -> DataFrame:
    p = one_project(projects).withColumnRenamed("client_id", "p_client").withColumnRenamed("external_project_id", "p_id").withColumnRenamed("name", "p_name")
    joined = rows.join(p, (F.col("client_id") == F.col("p_client")) & (F.col(project_id) == F.col("p_id")), "left")
    return joined.withColumn("project_label", C.project_label(F.col("display_name"), F.col("p_name"), F.col("worktree"), F.col(project_id))).drop(
        "p_client", "p_id", "p_name", "display_name", "worktree")


def dimensions(facts: DataFrame, parts: list[str], clients: DataFrame | None = None, sessions: DataFrame | None = None, projects: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """Facts with only the joins that the dimensions need, and a column for each dimension."""
    out = []
    for part in parts:
        checked(part, DIMENSIONS, "group_by")
        if part == "client":
            facts = facts.join(clients.select("client_id", F.col("name").alias("client_name")), "client_id", "left")
            out.append(F.col("client_name"))
        elif part == "agent":
            facts = facts.join(sessions.select("session_id", "agent"), "session_id", "left")
            out.append(F.coalesce("agent", F.lit(C.UNKNOWN)))
        elif part == "project":
            facts = with_project_label(facts, projects)
            out.append(F.col("project_label"))
        elif part == "model":
            out.append(F.col("model_name"))
        elif part == "session":
            out.append(F.col("session_id").cast("string"))
        else:
            out.append(C.bucket(F.col("reported_at"), part))
    return facts, out


def group_value(columns: list[Column]) -> Column:
    """Parts joined by a pipe; null if any is."""
    value = columns[0]
    for c in columns[1:]:
        value = F.concat(value, F.lit("|"), c)
    return value


def total(facts: DataFrame) -> DataFrame:
    """One row, also for no facts: sums, cost (null if no record has one), counts, providers."""
    return measured(facts, []).select(F.lit("total").alias("group_value"), "*")


def aggregates(facts: DataFrame, group_by: list[str], **dims: DataFrame) -> DataFrame:
    """The measures for each combination of dimensions, named by group_value; projects' labels, and agents among several, have a column too."""
    facts, parts = dimensions(facts, group_by, **dims)
    shown = [c.alias(n) for p, n, c in (("project", "project_label", F.col("project_label") if "project" in group_by else None),
                                        ("agent", "agent", F.coalesce("agent", F.lit(C.UNKNOWN)) if "agent" in group_by and len(group_by) > 1 else None)) if c is not None]
    keyed = facts.withColumn("_group", group_value(parts)).select(F.col("_group").alias("group_value"), *shown, *TOKENS, "estimated_cost_usd", "provider", "session_id", "model_name")
    return measured(keyed, [c for c in keyed.columns if c in ("group_value", "project_label", "agent")])


def provider_breakdown(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Records for each key and provider, as one JSON object for each key (providers in order)."""
    per = facts.groupBy(*keys, C.provider_key(F.col("provider")).alias("p")).agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("p", "n")))
    return per.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("provider_breakdown"))


def session_totals(facts: DataFrame) -> DataFrame:
    """Each session's sums and last message, and its provider with most records: ties go to the first name, empty names don't count.

    Facts are read once and combined before each of two shuffles."""
    per = facts.groupBy("session_id", "provider").agg(F.max("reported_at").alias("last"), F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TOKENS], F.sum("estimated_cost_usd").alias("cost"))
    best = F.min(F.when(F.col("provider") != "", F.struct((-F.col("n")).alias("n"), F.col("provider"))))
    return per.groupBy("session_id").agg(
        F.max("last").alias("last_message_at"), F.sum("n").alias("message_count"), *[F.coalesce(F.sum(t), F.lit(0)).cast("long").alias(t) for t in TOKENS],
        F.sum("cost").alias("estimated_cost_usd"), best["provider"].alias("primary_provider"))


def primary_provider(facts: DataFrame) -> DataFrame:
    """The sessions that have a provider, with the one of most records."""
    return session_totals(facts).select("session_id", "primary_provider").where("primary_provider is not null")


def of_page(facts: DataFrame, page_: DataFrame) -> DataFrame:
    """The facts of a page's sessions. A page has 1,000 rows at most (see `page`), which Spark sees by its limit and broadcasts; it doesn't broadcast a larger table."""
    return facts.join(page_.select("session_id"), "session_id", "left_semi")


def _in_context(sessions: DataFrame, contexts: DataFrame, *columns: str) -> DataFrame:
    """Sessions with their contexts' columns: joined before the facts are, which then go by session alone."""
    s = sessions.select("session_id", *columns, F.col("source_database_id").alias("session_database_id"), "external_session_id")
    return s.join(contexts, ["session_database_id", "external_session_id"], "left")


def records(facts: DataFrame, sessions: DataFrame, contexts: DataFrame, sort_by: str = "reported_at", sort_dir: str = "desc", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Record rows with the session's database and creation time, in a total order; a page of them where limit is given."""
    checked(sort_by, SORTS, "sort_by")
    checked(sort_dir, {"asc", "desc"}, "sort_dir")
    c = contexts.select(F.col("source_database_id").alias("session_database_id"), "external_session_id", F.timestamp_millis("source_created_at").alias("context_created_at"))
    rows = facts.join(_in_context(sessions, c), "session_id").withColumn("source_created_at", F.coalesce("context_created_at", "reported_at"))
    rows = rows.select("source_record_id", "client_id", F.col("session_database_id").alias("source_database_id"), "session_id", "model_name", *TOKENS,
                       F.nullif("provider", F.lit("")).alias("provider"), "mode", "estimated_cost_usd", "reported_at", F.col("first_ingested_at").alias("ingested_at"), "source_created_at")
    if limit is None:
        return rows
    key = F.col(sort_by)
    return rows.orderBy(key.desc_nulls_last() if sort_dir == "desc" else key.asc_nulls_last(), "source_record_id").offset(offset).limit(limit)


def overlapping(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows whose time from first to last message meets the window; an open end counts as lasting."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return rows.where((F.col("first_message_at") <= b) & ((F.col("last_message_at") >= a) | F.col("last_message_at").isNull()))


def sessions(sessions_: DataFrame, facts: DataFrame, projects: DataFrame) -> DataFrame:
    """Session summaries: totals, primary provider, project label."""
    return with_project_label(sessions_.join(session_totals(facts), "session_id", "left"), projects)


def todo_counts(todos: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return todos.groupBy("session_id").agg(F.count("*").alias("todos"), n("completed").alias("todos_completed"), n("blocked").alias("todos_blocked"))


def child_counts(sessions_: DataFrame) -> DataFrame:
    return sessions_.where("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("external_session_id")).agg(F.count("*").alias("children"))


def agent_runs(sessions_: DataFrame, facts: DataFrame, todos: DataFrame, contexts: DataFrame, now: datetime, status: str | None = None, **limits: int) -> DataFrame:
    """Runs with state, titles, todo and child counts, reasoning tokens and primary provider."""
    if status:
        checked(status, {"running", "completed", "blocked", "stale", C.UNKNOWN}, "status")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = sessions_.join(session_totals(facts), "session_id", "left").withColumn("message_count", zero("message_count"))
    rows = rows.withColumn("status", C.run_status(F.col("last_message_at"), F.col("message_count"), F.col("parent_session_id"), now, **limits))
    if status:
        rows = rows.where(F.col("status") == status)
    ctx = contexts.select("source_database_id", "external_session_id", F.col("title").alias("session_title"), C.model_display(F.col("session_model")).alias("session_model"))
    rows = (rows.join(todo_counts(todos), "session_id", "left").join(child_counts(sessions_), "external_session_id", "left")
            .join(ctx, ["source_database_id", "external_session_id"], "left"))
    return rows.select("session_id", "external_session_id", "client_id", "agent", "parent_session_id", "first_message_at", "last_message_at", "message_count", "status",
                       C.derived_title(F.col("agent"), F.col("external_session_id")).alias("title"), "session_title", "session_model",
                       *[zero(c).alias(c) for c in ("todos", "todos_completed", "todos_blocked", "children", "reasoning_tokens", "input_tokens", "output_tokens")],
                       "primary_provider", "estimated_cost_usd")


def agent_run_detail(runs: DataFrame, sessions_: DataFrame, todos: DataFrame, session_id: int | None = None) -> DataFrame:
    """Runs (or one) with their parent's id, the smallest of the sessions that carry the parent's external id, and their to-do list by position."""
    if session_id is not None:
        runs, todos = runs.where(F.col("session_id") == session_id), todos.where(F.col("session_id") == session_id)
    parents = sessions_.groupBy(F.col("external_session_id").alias("parent_session_id")).agg(F.min("session_id").alias("parent_id"))
    lists = todos.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("position", "status"))).alias("todo_list"))
    return runs.join(parents, "parent_session_id", "left").join(lists, "session_id", "left")


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000, offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def records_with_context(facts: DataFrame, sessions_: DataFrame, contexts: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Records with their session's agent and title, and their project's label where projects are given."""
    c = contexts.select(F.col("source_database_id").alias("session_database_id"), "external_session_id", F.col("title").alias("session_title"))
    rows = facts.join(_in_context(sessions_, c, "agent"), "session_id")
    return rows if projects is None else with_project_label(rows, projects)


def records_with_context_grouped(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Sums for each combination of project, session, agent and model; a session's title is the greatest of the group."""
    by = {"project": F.col("project_label"), "session": F.col("session_id").cast("string"), "agent": F.coalesce("agent", F.lit(C.UNKNOWN)), "model": F.col("model_name")}
    value = group_value([by[checked(p, by, "group_by")] for p in parts])
    return rows.withColumn("group_value", value).groupBy("group_value").agg(
        *[F.coalesce(F.sum(t), F.lit(0)).cast("long").alias(t) for t in TOKENS], F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
        F.count("*").alias("message_count"), F.max("session_title").alias("session_title"))


def client_summary(rows: DataFrame) -> DataFrame:
    """Second-level sums over (client, project, model) rows; distinct counts add up, as on the client's page."""
    return rows.groupBy("client").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("session_count").alias("session_count"), F.sum("model_count").alias("model_count"))


def client_agents(facts: DataFrame, sessions_: DataFrame) -> DataFrame:
    """Each client's agents with their tokens, those of the cache too; most input first within a client."""
    rows = facts.join(sessions_.select("session_id", "agent"), "session_id", "left").groupBy("client_id", F.coalesce("agent", F.lit(C.UNKNOWN)).alias("agent"))
    return rows.agg(*[F.coalesce(F.sum(t), F.lit(0)).cast("long").alias(t) for t in TOKENS], F.count("*").alias("message_count")).orderBy("client_id", F.desc("input_tokens"), "agent")


def model_mix(rows: DataFrame) -> DataFrame:
    """Each vendor's tokens and their share of the largest vendor's, in percent."""
    per = rows.groupBy(C.vendor(F.col("model_name")).alias("vendor")).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return per.withColumn("percent_of_most", F.round(F.col("tokens") * 100 / F.max("tokens").over(W.partitionBy()), 2))
