"""Transcripts: headers, keyset pages, tool calls and their repair, and the timeline over nested sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import NO_TIME_MS, cursor
from ..session import drop, stage


def header_counts(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Each session's messages, parts and tool calls, and its first and last part time; without any: 0 and null."""
    m = messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    p = parts.groupBy("session_id").agg(F.count("*").alias("parts"), F.count(F.when(F.col("part_type") == "tool", 1)).alias("tool_calls"),
                                        F.min("source_created_at").alias("first_part_at"), F.max("source_created_at").alias("last_part_at"))
    return sessions.select("session_id").join(m, "session_id", "left").join(p, "session_id", "left").fillna(0, ["messages", "parts", "tool_calls"])


def keyset_page(rows: DataFrame, row_id: str, after: tuple[int, str] | None = None, limit: int = 100, ms: str = "source_created_at") -> DataFrame:
    """The next rows after a cursor by (time, id), rows without time last; one more than limit tells that more follow."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    key = F.coalesce(ms, F.lit(NO_TIME_MS).cast("long"))
    if after:
        at = F.lit(after[0]).cast("long")
        rows = rows.where((key > at) | ((key == at) & (F.col(row_id) > F.lit(after[1]))))
    return rows.orderBy(key, row_id).limit(limit + 1)


def tool_calls(parts: DataFrame, tool: str | None = None, status: str | None = None) -> DataFrame:
    """Tool calls of tool parts, of one tool and status where given: name, status, input and output, from the state or else the top level."""
    at = lambda p: F.get_json_object("data", f"$.{p}")
    if tool is not None:
        parts = parts.where(at("tool") == tool)
    if status is not None:
        parts = parts.where(F.coalesce(at("state.status"), at("status")) == status)
    both = lambda k: F.coalesce(at(f"state.{k}"), at(k)).alias(f"tool_{k}")
    return parts.where("part_type = 'tool'").withColumn("tool_name", at("tool")).where("tool_name is not null").select(
        "session_id", "external_message_id", "external_part_id", "source_created_at", "tool_name", both("status"), both("input"), both("output"))


def tool_call_repair(stored: DataFrame, parts: DataFrame, limit: int | None = None) -> DataFrame:
    """Each stored or recomputed call with its state: unchanged, repaired, deferred (beyond limit) or skipped (no part any more)."""
    new = tool_calls(parts).select("external_part_id", F.struct("tool_name", "tool_status", "tool_input", "tool_output").alias("new"))
    old = stored.select("external_part_id", F.struct("tool_name", "tool_status", "tool_input", "tool_output").alias("old"))
    both = old.join(new, "external_part_id", "full_outer")
    state = F.when(F.col("new").isNull(), "skipped").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("repaired")
    rows = both.withColumn("state", state)
    if limit is None:
        return rows
    wrong = rows.where("state = 'repaired'").orderBy("external_part_id").limit(limit).select("external_part_id", F.lit(True).alias("_now"))
    return rows.join(wrong, "external_part_id", "left").withColumn("state", F.when((F.col("state") == "repaired") & F.col("_now").isNull(), "deferred").otherwise(F.col("state"))).drop("_now")


def session_edges(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """parent_id, child_id: distinct edges named by sessions and by messages."""
    s = sessions.where("parent_session_id is not null").select(F.col("parent_session_id").alias("parent_id"), F.col("session_id").alias("child_id"))
    m = messages.where("parent_session_id is not null").select(F.col("parent_session_id").alias("parent_id"), F.col("session_id").alias("child_id"))
    return s.unionByName(m).distinct()


def descendants(edges: DataFrame, roots: DataFrame, depth: int | None = 50) -> DataFrame:
    """root_id, session_id, depth: sessions below each root by the shortest way, itself at depth 0; depth None goes to the end.

    A frontier grows level by level, by a join on its sessions' key. What a root has reached before is taken out, so each
    session is met once for each root, whatever cycles and diamonds there are. Levels are staged tables: only whether one is
    empty reaches the driver."""
    if depth is not None and not 0 <= depth <= 200:
        raise ValueError("depth must be 0 to 200, or None")
    edges = stage(edges.select(F.col("parent_id").alias("session_id"), "child_id").distinct(), "edges")
    level = reached = stage(roots.select(F.col("session_id").alias("root_id"), "session_id", F.lit(0).alias("depth")).distinct(), "level")
    k = 0
    while depth is None or k < depth:
        k += 1
        found = level.join(edges, "session_id").select("root_id", F.col("child_id").alias("session_id")).distinct()
        level = stage(found.join(reached.select("root_id", "session_id"), ["root_id", "session_id"], "left_anti").select("root_id", "session_id", F.lit(k).alias("depth")), "level")
        if level.isEmpty():
            drop(level)
            break
        reached = reached.unionByName(level)
    drop(edges)
    return reached


def timeline(parts: DataFrame, edges: DataFrame, roots: DataFrame, depth: int | None = 50, sessions: DataFrame | None = None, agent: str | None = None,
             start_ms: int | None = None, end_ms: int | None = None, ms: str = "source_created_at") -> DataFrame:
    """Parts of each root session and those below it, each once, with the least depth.

    agent (of the part's session, from sessions) and times choose among the parts; parts without time meet no bound."""
    if start_ms is not None and end_ms is not None and start_ms > end_ms:
        raise ValueError("start is after end")
    below = descendants(edges, roots, depth)
    if agent is not None:
        below = below.join(sessions.where(F.col("agent") == agent).select("session_id"), "session_id", "left_semi")
    if start_ms is not None:
        parts = parts.where(F.col(ms) >= start_ms)
    if end_ms is not None:
        parts = parts.where(F.col(ms) <= end_ms)
    return parts.join(below, "session_id")


def page_end(fetched: DataFrame, row_id: str, limit: int, ms: str = "source_created_at") -> DataFrame:
    """One row for what keyset_page gave: has_more, and the cursor of the page's last row where more follow. It holds 1,001 rows at most."""
    key = F.coalesce(ms, F.lit(NO_TIME_MS).cast("long"))
    at = F.sort_array(F.collect_list(F.struct(key.alias("ms"), F.col(row_id).alias("id"))))
    more = F.size("at") > limit
    last = F.get("at", F.lit(limit - 1))
    return fetched.agg(at.alias("at")).select(more.alias("has_more"), F.when(more, cursor(last["ms"], last["id"])).alias("next_cursor"))


def retained(rows: DataFrame, cutoff_ms: int | Column, key: str | None = None, children: DataFrame | None = None, child_key: str | None = None, ms: str = "source_created_at") -> DataFrame:
    """Rows that stay: young, without time, or with children that stay."""
    old = F.coalesce(F.col(ms) < cutoff_ms, F.lit(False))
    if children is None:
        return rows.where(~old)
    held = children.select(F.col(child_key or key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("_held", F.lit(True))
    return rows.join(held, key, "left").where(~old | F.col("_held").isNotNull()).drop("_held")


#: The transcript's tables, children first, and of each one the children that hold its rows: (table, column that names the row).
HELD_BY = {"tool_calls": (), "parts": (("tool_calls", "part_id"),), "messages": (("parts", "message_id"), ("tool_calls", "message_id"))}


def expired(tables: dict[str, DataFrame], cutoffs: dict[str, int], ms: str = "source_created_at") -> dict[str, DataFrame]:
    """What a dry run finds: by table the rows older than its cutoff that no child holds which is there now. Tables have `id`."""
    out = {}
    for name, holders in HELD_BY.items():
        rows = tables[name].where(F.col(ms) < cutoffs[name]).select("id", ms)
        for child, column in holders:
            rows = rows.join(tables[child].select(F.col(column).alias("id")), "id", "left_anti")
        out[name] = rows
    return out


def dry_run(tables: dict[str, DataFrame], cutoffs: dict[str, int], limit: int | None = None) -> DataFrame:
    """table, eligible: how many rows of each a run would take, the limit being shared in order of the tables."""
    counts = [rows.agg(F.lit(k).alias("k"), F.lit(name).alias("table"), F.count("*").alias("n")) for k, (name, rows) in enumerate(expired(tables, cutoffs).items())]
    every = reduce(DataFrame.unionByName, counts)
    before = F.coalesce(F.sum("n").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # three rows
    left = F.greatest(F.lit(limit) - before, F.lit(0)) if limit is not None else F.col("n")
    return every.select("table", F.least("n", left).alias("eligible"))


def retention_plan(tables: dict[str, DataFrame], cutoffs: dict[str, int], limit: int | None = None, ms: str = "source_created_at") -> DataFrame:
    """table, id of the rows that a run deletes: tool calls, then parts, then messages, each without those that a child holds which
    stays; limit: so many over all tables, of each the oldest first. Deleting them leaves no child without its parent."""
    taken: dict[str, DataFrame] = {}
    left = limit
    for name, holders in HELD_BY.items():
        rows = tables[name].where(F.col(ms) < cutoffs[name]).select("id", ms)
        for child, column in holders:
            stays = tables[child].join(taken[child].select("id"), "id", "left_anti").select(F.col(column).alias("id"))
            rows = rows.join(stays, "id", "left_anti")
        if left is not None:
            rows = stage(rows.orderBy(ms, "id").limit(left), "expired")
            left -= rows.count()
        taken[name] = rows
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("table"), "id") for name, rows in taken.items()])


def newest_context(contexts: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by order."""
    return contexts.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
