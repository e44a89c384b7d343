"""Queries of replay-safe accounting: validation, deduplication, merges, identities, rollups, reconciliation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import identity as I
from ..operators import merge as M
from ..operators import rollup as R
from ..session import stage
from .registry import query
from .usage import CLIENT, LABEL, PROJECT_JOIN, measured, money

KEY = ["client_id", "source_database_id", "source_record_id"]
EVENT = ["identity_id", "source_record_id"]
FIELDS = list(M.DELTA_FIELDS)

RAW = "TRY_CAST({0} AS BIGINT)"


@query("ingest_validate", """WITH n AS (SELECT *, TRY_CAST(input_tokens AS BIGINT) AS a, TRY_CAST(output_tokens AS BIGINT) AS b, TRY_CAST(cached_tokens AS BIGINT) AS c FROM fx_raw),
 r AS (SELECT *, CASE WHEN a IS NULL THEN 'Non-numeric token value: invalid literal for int() with base 10: ''' || input_tokens || '''' WHEN b IS NULL THEN 'Non-numeric token value: invalid literal for int() with base 10: ''' || output_tokens || ''''
 WHEN c IS NULL THEN 'Non-numeric token value: invalid literal for int() with base 10: ''' || cached_tokens || '''' WHEN least(a, b, c, coalesce(reasoning_tokens, 0), coalesce(cache_read_tokens, 0), coalesce(cache_write_tokens, 0)) < 0 THEN 'Negative token value' END AS reason FROM n)
SELECT source_record_id, arrival_seq, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM r""")
def ingest_validate(t):
    return M.validate_tokens(t.fx_raw).select("source_record_id", "arrival_seq", "status", "reason")


FIRST = """d AS (SELECT *, first_value(struct_pack(a := input_tokens, b := output_tokens, c := cached_tokens, d := estimated_cost_usd)) OVER w AS f, row_number() OVER w = 1 AS won
 FROM fx_received WINDOW w AS (PARTITION BY client_id, source_database_id, source_record_id ORDER BY arrival_seq)),
 s AS (SELECT *, input_tokens = f.a AND output_tokens = f.b AND cached_tokens = f.c AND CASE WHEN estimated_cost_usd IS NULL OR f.d IS NULL THEN estimated_cost_usd IS NULL AND f.d IS NULL ELSE abs(estimated_cost_usd - f.d) < 0.0001 END AS same FROM d),
 v AS (SELECT * EXCLUDE (f, same), CASE WHEN won OR same THEN 'accepted' ELSE 'conflict' END AS status, CASE WHEN won THEN NULL WHEN same THEN 'Duplicate (idempotent)' ELSE 'Divergent duplicate: same dedup key but different values' END AS reason FROM s)"""


def received(t):
    return M.first_wins(t.fx_received, KEY)


@query("dedup_first_wins", f"WITH {FIRST} SELECT source_record_id, arrival_seq, won, status, reason FROM v")
def dedup_first_wins(t):
    return received(t).select("source_record_id", "arrival_seq", "won", "status", "reason")


FILL = ["reasoning_tokens", "cache_read_tokens", "cache_write_tokens"]


@query("replay_fill", "SELECT client_id, source_record_id, " + ", ".join(f"arg_min({c}, arrival_seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in FILL) + " FROM fx_received GROUP BY 1, 2")
def replay_fill(t):
    return M.replay_fill(t.fx_received, ["client_id", "source_record_id"], FILL)


@query("session_rollup", f"""WITH {FIRST} SELECT source_database_id, session_id, min(ingest_order) AS first_message_at, max(ingest_order) AS last_message_at, count(*) AS message_count,
 {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in FIELDS[:-1])}, CAST(sum(estimated_cost_usd) AS DOUBLE) AS estimated_cost_usd,
 arg_max(project_id, ingest_order * 10 + client_id % 10) FILTER (WHERE project_id IS NOT NULL) IS NOT NULL AS has_project FROM v WHERE won GROUP BY 1, 2""")
def session_rollup(t):
    kept = t.fx_received.select(*KEY, "session_id", "ingest_order", "project_id", "arrival_seq", *FIELDS)
    rows = M.session_rollup(M.keep_first(kept, KEY, [F.col("arrival_seq")]), ["source_database_id", "session_id"], ["project_id"], at="ingest_order")
    return money(rows.withColumn("has_project", F.col("project_id").isNotNull()).drop("project_id"))


DELTA = ", ".join(f"""CASE WHEN arg_min({c} IS NULL, arrival_seq) AND coalesce(max(abs({c})), 0) = 0 THEN NULL ELSE arg_max({c}, arrival_seq) FILTER (WHERE {c} IS NOT NULL) END AS {c}""" for c in FIELDS)
CANONICAL = f"""SELECT identity_id, source_record_id, arg_min(session_id, arrival_seq) AS session_id, arg_min(model_name, arrival_seq) AS model_name, arg_min_null(project_id, arrival_seq) AS project_id,
 arg_min(client_id, arrival_seq) AS client_id, arg_min(reported_at, arrival_seq) AS reported_at, {DELTA}, count(*) AS attempts FROM fx_received GROUP BY 1, 2"""


def canonical_rows(t):
    return M.delta_merge(t.fx_received, EVENT, ["session_id", "model_name", "project_id", "client_id", "reported_at"])


@query("canonical_events", CANONICAL.replace("AS estimated_cost_usd", "::DOUBLE AS estimated_cost_usd"))
def canonical_events(t):
    return money(canonical_rows(t))


@query("replay_delta", f"""WITH b AS (SELECT *, row_number() OVER w = 1 AS first_one, {', '.join(f'coalesce(last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o_{c}' for c in FIELDS)}
 FROM fx_received WINDOW w AS (PARTITION BY identity_id, source_record_id ORDER BY arrival_seq))
SELECT identity_id, CASE WHEN first_one THEN 'created' WHEN {' OR '.join(f'coalesce({c} <> o_{c}, false)' for c in FIELDS)} THEN 'updated' ELSE 'duplicate' END AS outcome, count(*) AS n FROM b GROUP BY 1, 2""")
def replay_delta(t):
    return M.delta_outcomes(t.fx_received, EVENT).groupBy("identity_id", "outcome").agg(F.count("*").alias("n"))


BOOKED = f"""b AS (SELECT identity_id, source_record_id, arrival_seq, {', '.join(f'first_value({c}) OVER w AS {c}' for c in ('session_id', 'client_id', 'project_id', 'reported_at'))},
 {', '.join(f'coalesce({c} - coalesce(last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS {c}' for c in FIELDS)}
 FROM fx_received WINDOW w AS (PARTITION BY identity_id, source_record_id ORDER BY arrival_seq))"""
KEPT = ["session_id", "client_id", "project_id", "reported_at"]


@query("replay_delta_rows", f"WITH {BOOKED} SELECT identity_id, source_record_id, arrival_seq, session_id, client_id, project_id, reported_at, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' if c == 'estimated_cost_usd' else c for c in FIELDS)} FROM b")
def replay_delta_rows(t):
    """What each delivery adds, and to what it is booked."""
    return money(M.replay_deltas(t.fx_received, EVENT, KEPT))


@query("replay_rollup", f"WITH {BOOKED} SELECT client_id, project_id, CAST(reported_at AS DATE) AS day, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(estimated_cost_usd) AS DOUBLE) AS estimated_cost_usd FROM b WHERE project_id IS NOT NULL GROUP BY 1, 2, 3")
def replay_rollup(t):
    rows = M.replay_deltas(t.fx_received, EVENT, KEPT).where("project_id is not null").withColumn("day", F.to_date("reported_at"))
    return money(rows.groupBy("client_id", "project_id", "day").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "estimated_cost_usd")]))


@query("replay_session_totals", f"""WITH {BOOKED}, r AS (SELECT session_id, sum(input_tokens) OVER w AS s, row_number() OVER w AS k FROM b WINDOW w AS (PARTITION BY session_id ORDER BY arrival_seq, identity_id, source_record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session_id, CAST(arg_max(s, k) - least(min(s), 0) AS BIGINT) AS input_tokens FROM r GROUP BY 1""")
def replay_session_totals(t):
    rows = M.replay_deltas(t.fx_received, EVENT, KEPT)
    return M.clamped_totals(rows, "session_id", ("input_tokens",), ["arrival_seq", *EVENT])


@query("latest_nonnull_upsert", """SELECT source_record_id, arg_max(project_id, arrival_seq) FILTER (WHERE project_id IS NOT NULL) AS project_id, arg_max(reasoning_tokens, arrival_seq) FILTER (WHERE reasoning_tokens IS NOT NULL) AS reasoning_tokens,
 arg_max_null(cache_read_tokens, arrival_seq) AS cache_read_tokens FROM fx_received GROUP BY 1""")
def latest_nonnull_upsert(t):
    return M.merge_nonnull(t.fx_received, ["source_record_id"], ["project_id", "reasoning_tokens"], overwrite=["cache_read_tokens"])


@query("rollup_upsert", """WITH d AS (SELECT client_id, project_id, CAST(reported_at AS DATE) AS day, input_tokens, output_tokens FROM fx_facts WHERE project_id IS NOT NULL),
 u AS (SELECT client_id, project_id, day, input_tokens, output_tokens FROM fx_rollup UNION ALL SELECT * FROM d)
SELECT client_id, project_id, day, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM u GROUP BY 1, 2, 3""")
def rollup_upsert(t):
    return M.add_up(t.fx_rollup, R.build(t.fx_facts), R.KEY, ["input_tokens", "output_tokens"])


@query("snapshot_replace_dirs", """WITH n AS (SELECT client_id, batch, directory, nullif(trim(directory), '') AS v FROM fx_directories),
 l AS (SELECT client_id, max(batch) AS batch FROM n WHERE v IS NOT NULL OR directory IS NULL GROUP BY 1)
SELECT DISTINCT n.client_id, n.v AS directory FROM n JOIN l USING (client_id, batch) WHERE v IS NOT NULL""")
def snapshot_replace_dirs(t):
    return M.replace_snapshots(t.fx_directories, ["client_id"], "directory")


@query("snapshot_replace_todos", """WITH s AS (SELECT session_id % 97 AS session_id, session_id AS batch, CASE WHEN session_id % 5 = 0 THEN NULL WHEN position % 3 = 0 THEN '  ' ELSE ' ' || position || ':' || status || ' ' END AS todo FROM fx_todos),
 l AS (SELECT session_id, max(batch) AS batch FROM s WHERE todo IS NULL OR trim(todo) <> '' GROUP BY 1) SELECT DISTINCT s.session_id, trim(todo) AS todo FROM s JOIN l USING (session_id, batch) WHERE trim(todo) <> ''""")
def snapshot_replace_todos(t):
    """The newest list of each session, of many that it sent; some were sent empty."""
    todo = F.when(F.col("session_id") % 5 == 0, None).when(F.col("position") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "position", F.lit(":"), "status", F.lit(" ")))
    return M.replace_snapshots(t.fx_todos.select((F.col("session_id") % 97).alias("session_id"), F.col("session_id").alias("batch"), todo.alias("todo")), ["session_id"], "todo")


@query("batch_ledger", f"""WITH {FIRST} SELECT batch, count(*) AS records, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'conflict') AS conflict, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM v GROUP BY 1""")
def batch_ledger(t):
    return M.batch_ledger(received(t))


@query("ingest_audit", f"WITH {FIRST} SELECT batch, source_record_id, ingest_order, status, reason FROM v")
def ingest_audit(t):
    return received(t).select("batch", "source_record_id", "ingest_order", "status", "reason")


@query("dim_upsert", f"WITH {FIRST} SELECT source_database_id, min(ingest_order) AS first_seen, max(ingest_order) AS last_seen, count(*) FILTER (WHERE won) AS record_count FROM v GROUP BY 1")
def dim_upsert(t):
    return M.dimension_upsert(received(t), ["source_database_id"], "ingest_order")


@query("entity_link_upsert", """WITH m AS (SELECT run_id, entity_id, max(confidence) AS confidence, string_agg(evidence, ',' ORDER BY arrival_seq) AS evidence, arg_max(method, arrival_seq) FILTER (WHERE method IS NOT NULL) AS method,
 arg_max(role, arrival_seq) AS role, arg_max(source, arrival_seq) AS source FROM fx_links GROUP BY 1, 2) SELECT *, confidence < max(confidence) OVER (PARTITION BY entity_id) AS superseded FROM m""")
def entity_link_upsert(t):
    return M.link_upsert(t.fx_links).withColumn("evidence", F.array_join("evidence", ","))


@query("event_record", """SELECT * EXCLUDE k FROM (SELECT repository, entity_type, external_id, event_type, occurred_at, event_id, row_number() OVER (PARTITION BY repository, entity_type, external_id, event_type, date_trunc('day', occurred_at) ORDER BY event_id) AS k FROM fx_events) WHERE k = 1""")
def event_record(t):
    rows = t.fx_events.select("repository", "entity_type", "external_id", "event_type", "occurred_at", "event_id").withColumn("day", F.date_trunc("day", "occurred_at"))
    return M.keep_first(rows, ["repository", "entity_type", "external_id", "event_type", "day"], [F.col("event_id")]).drop("day")


@query("binding_insert_once", """WITH b AS (SELECT event_id % 900 AS job, event_id AS arrival, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE entity_type END AS kind FROM fx_events),
 f AS (SELECT *, row_number() OVER w = 1 AS first_one, first_value(event_type) OVER w AS e, first_value(kind) OVER w AS k FROM b WINDOW w AS (PARTITION BY job ORDER BY arrival))
SELECT job, arrival, CASE WHEN first_one THEN 'inserted' WHEN event_type = e AND kind IS NOT DISTINCT FROM k THEN 'replayed' ELSE 'conflict' END AS outcome FROM f""")
def binding_insert_once(t):
    rows = t.fx_events.select((F.col("event_id") % 900).alias("job"), F.col("event_id").alias("arrival"), "event_type", F.when(F.col("event_id") % 4 != 0, F.col("entity_type")).alias("kind"))
    return M.insert_once(rows, ["job"], ["event_type", "kind"], "arrival").select("job", "arrival", "outcome")


@query("legacy_backfill", """SELECT source_record_id, arrival_seq FROM fx_received r WHERE NOT EXISTS (SELECT 1 FROM fx_facts f WHERE f.source_record_id = r.source_record_id AND f.mode = 'F')
 AND NOT EXISTS (SELECT 1 FROM fx_identities i WHERE i.identity_id = r.identity_id AND i.owner_id = 1)""")
def legacy_backfill(t):
    return M.new_events(t.fx_received, t.fx_facts.where("mode = 'F'"), t.fx_identities.where("owner_id = 1"), ["source_record_id"]).select("source_record_id", "arrival_seq")


@query("resolve_identity", "SELECT r.source_record_id, r.arrival_seq, coalesce(i.canonical_parent_id, r.source_database_id) AS canonical_id FROM fx_received r LEFT JOIN fx_identities i ON i.identity_id = r.source_database_id")
def resolve_identity(t):
    return I.resolve(t.fx_received.select("source_record_id", "arrival_seq", F.col("source_database_id").alias("identity_id")), t.fx_identities).select("source_record_id", "arrival_seq", "canonical_id")


def owned(t):
    return t.fx_received.select("client_id", F.col("source_database_id").alias("identity_id"), "source_record_id", "arrival_seq", "batch")


OWNED = "o AS (SELECT client_id, source_database_id AS identity_id, source_record_id, arrival_seq, batch FROM fx_received), x AS (SELECT DISTINCT o.client_id, o.identity_id, o.source_record_id FROM o JOIN fx_identities i USING (identity_id) WHERE i.canonical_parent_id IS NULL)"


@query("identity_overlap", f"WITH {OWNED} SELECT a.identity_id, b.identity_id AS other_id, count(*) AS shared FROM x a JOIN x b ON a.client_id = b.client_id AND a.source_record_id = b.source_record_id AND a.identity_id <> b.identity_id GROUP BY 1, 2")
def identity_overlap(t):
    return I.overlaps(owned(t), t.fx_identities)


@query("quarantine_batch", f"""WITH {OWNED}, h AS (SELECT DISTINCT o.batch, o.identity_id FROM o JOIN x ON x.client_id = o.client_id AND x.source_record_id = o.source_record_id AND x.identity_id <> o.identity_id)
SELECT o.batch, o.source_record_id, o.arrival_seq, o.identity_id = 9 OR h.batch IS NOT NULL AS quarantined,
 CASE WHEN o.identity_id = 9 THEN 'Record quarantined — source identity has active quarantine' WHEN h.batch IS NOT NULL THEN 'Record quarantined — source identity overlap detected' END AS reason FROM o LEFT JOIN h ON h.batch = o.batch AND h.identity_id = o.identity_id""")
def quarantine_batch(t):
    rows = owned(t)
    return I.quarantined(rows, rows, t.fx_identities, t.fx_identities.where("identity_id = 9")).select("batch", "source_record_id", "arrival_seq", "quarantined", "reason")


@query("cross_identity_conflict", f"WITH {OWNED} SELECT source_record_id, arrival_seq, identity_id FROM o WHERE EXISTS (SELECT 1 FROM x WHERE x.client_id = o.client_id AND x.source_record_id = o.source_record_id AND x.identity_id <> o.identity_id)")
def cross_identity_conflict(t):
    rows = owned(t)
    return I.cross_identity_conflicts(rows, rows, t.fx_identities).select("source_record_id", "arrival_seq", "identity_id")


@query("resolve_quarantine", "SELECT identity_id, CASE WHEN identity_id % 2 = 0 THEN identity_id + 100 ELSE canonical_parent_id END AS canonical_parent_id FROM fx_identities")
def resolve_quarantine(t):
    done = t.fx_identities.where("identity_id % 2 = 0").select("identity_id", (F.col("identity_id") + 100).alias("parent_id"), F.lit(1).alias("resolved_at"))
    return I.lift_quarantine(t.fx_identities, t.fx_identities, done)[1].select("identity_id", "canonical_parent_id")


@query("quarantines", "SELECT identity_id, owner_id FROM fx_identities WHERE identity_id % 2 <> 0")
def quarantines(t):
    done = t.fx_identities.where("identity_id % 2 = 0").select("identity_id", F.col("owner_id").alias("parent_id"), F.lit(1).alias("resolved_at"))
    return I.lift_quarantine(t.fx_identities.select("identity_id", "owner_id"), t.fx_identities, done)[0]


BUILD = """SELECT client_id, project_id, CAST(reported_at AS DATE) AS day, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 sum(coalesce(estimated_cost_usd, 0)) AS estimated_cost_usd, count(*) AS message_count FROM fx_facts WHERE project_id IS NOT NULL GROUP BY 1, 2, 3"""


@query("rollup_build", f"SELECT * REPLACE (CAST(estimated_cost_usd AS DOUBLE) AS estimated_cost_usd) FROM ({BUILD})")
def rollup_build(t):
    return money(R.build(t.fx_facts))


CLIENT_LABEL = f"coalesce(c.canonical_name, c.name) || '|' || {LABEL}"


@query("usage_client_project", f"""WITH s AS (SELECT {CLIENT_LABEL} AS group_value, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(estimated_cost_usd) AS DOUBLE) AS estimated_cost_usd, CAST(sum(message_count) AS BIGINT) AS message_count
  FROM ({BUILD}) r {PROJECT_JOIN} LEFT JOIN fx_clients c ON c.client_id = r.client_id WHERE day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 1),
 n AS (SELECT {CLIENT_LABEL} AS group_value, count(DISTINCT session_id) AS session_count, count(DISTINCT model_name) AS model_count FROM fx_facts r {PROJECT_JOIN} LEFT JOIN fx_clients c ON c.client_id = r.client_id
  WHERE r.project_id IS NOT NULL AND CAST(reported_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 1)
SELECT s.*, CAST(0 AS BIGINT) AS cached_tokens, CAST(0 AS BIGINT) AS reasoning_tokens, coalesce(session_count, 0) AS session_count, coalesce(model_count, 0) AS model_count FROM s LEFT JOIN n USING (group_value)""")
def usage_client_project(t):
    facts = stage(t.fx_facts.select("client_id", "project_id", "reported_at", "session_id", "model_name", "input_tokens", "output_tokens", "estimated_cost_usd"), "facts")  # read twice
    return money(R.client_project(R.build(facts), facts, t.fx_clients, t.fx_projects, date(1995, 1, 1), date(1998, 12, 31)))


def routed(t, group_by, **filters):
    return money(R.aggregates(t.fx_rollup, t.fx_facts, group_by, t.fx_clients, t.fx_projects, t.fx_sessions, date(1995, 1, 1), date(1998, 12, 31), **filters))


DAYS = "CAST(reported_at AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"


@query("usage_routed_rollup", f"""WITH s AS (SELECT {CLIENT_LABEL} AS group_value, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(estimated_cost_usd) AS DOUBLE) AS estimated_cost_usd, CAST(sum(message_count) AS BIGINT) AS message_count
  FROM fx_rollup r {PROJECT_JOIN} LEFT JOIN fx_clients c ON c.client_id = r.client_id WHERE day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 1),
 n AS (SELECT {CLIENT_LABEL} AS group_value, count(DISTINCT session_id) AS session_count, count(DISTINCT model_name) AS model_count FROM fx_facts r {PROJECT_JOIN} LEFT JOIN fx_clients c ON c.client_id = r.client_id
  WHERE r.project_id IS NOT NULL AND {DAYS} GROUP BY 1)
SELECT s.*, CAST(0 AS BIGINT) AS cached_tokens, CAST(0 AS BIGINT) AS reasoning_tokens, coalesce(session_count, 0) AS session_count, coalesce(model_count, 0) AS model_count FROM s LEFT JOIN n USING (group_value)""")
def usage_routed_rollup(t):
    """By project and client, in whatever order: the stored rollup answers, with what it has stored (some of which disagrees with the facts)."""
    return routed(t, ["project", "client"])


@query("usage_routed_facts", measured(f"{LABEL} AS project_label, client_name || '|' || {LABEL}", f"{CLIENT} {PROJECT_JOIN}", f"WHERE {DAYS} AND r.model_name = 'Brand#13'", "project_label"))
def usage_routed_facts(t):
    """The same dimensions with a model to filter by, which the rollup doesn't have: the facts answer."""
    return routed(t, ["client", "project"], model="Brand#13")


@query("rollup_verify", f"""WITH b AS ({BUILD}) SELECT coalesce(o.client_id, b.client_id) AS client_id, coalesce(o.project_id, b.project_id) AS project_id, coalesce(o.day, b.day) AS day,
 CASE WHEN o.client_id IS NULL THEN 'insert' WHEN b.client_id IS NULL THEN 'delete' ELSE 'update' END AS action FROM fx_rollup o FULL JOIN b ON b.client_id = o.client_id AND b.project_id = o.project_id AND b.day = o.day
WHERE o.client_id IS NULL OR b.client_id IS NULL OR o.input_tokens <> b.input_tokens OR o.output_tokens <> b.output_tokens OR o.estimated_cost_usd <> b.estimated_cost_usd OR o.message_count <> b.message_count""")
def rollup_verify(t):
    return R.disagreements(t.fx_rollup, t.fx_facts).select("client_id", "project_id", "day", "action")


@query("rollup_repair", f"SELECT * REPLACE (CAST(estimated_cost_usd AS DOUBLE) AS estimated_cost_usd) FROM ({BUILD})")
def rollup_repair(t):
    return money(R.repair(t.fx_rollup, t.fx_facts))


@query("rollup_repair_limited", f"""WITH b AS ({BUILD}), w AS (SELECT coalesce(o.client_id, b.client_id) AS client_id, coalesce(o.project_id, b.project_id) AS project_id, coalesce(o.day, b.day) AS day, b.client_id IS NULL AS gone FROM fx_rollup o FULL JOIN b ON b.client_id = o.client_id AND b.project_id = o.project_id AND b.day = o.day
  WHERE o.client_id IS NULL OR b.client_id IS NULL OR o.input_tokens <> b.input_tokens OR o.output_tokens <> b.output_tokens OR o.estimated_cost_usd <> b.estimated_cost_usd OR o.message_count <> b.message_count),
 n AS (SELECT client_id, project_id, day FROM w WHERE NOT gone ORDER BY 1, 2, 3 LIMIT 5), d AS (SELECT client_id, project_id, day FROM n UNION ALL SELECT client_id, project_id, day FROM w WHERE gone)
SELECT client_id, project_id, day, input_tokens, output_tokens, CAST(estimated_cost_usd AS DOUBLE) AS estimated_cost_usd, message_count FROM (SELECT o.* FROM fx_rollup o ANTI JOIN d USING (client_id, project_id, day) UNION ALL BY NAME SELECT b.* FROM b JOIN n USING (client_id, project_id, day))""")
def rollup_repair_limited(t):
    return money(R.repair(t.fx_rollup, t.fx_facts, 5))


@query("late_binding", """SELECT c.source_database_id, c.external_session_id, c.title, coalesce(CASE WHEN s.session_id % 4 = 0 THEN s.session_id + 1000000 END, s.session_id) AS session_id FROM fx_contexts c LEFT JOIN fx_sessions s ON s.source_database_id = c.source_database_id AND s.external_session_id = c.external_session_id""")
def late_binding(t):
    number = F.regexp_extract("external_session_id", r"(\d+)", 1).cast("long")
    rows = t.fx_contexts.select("source_database_id", "external_session_id", "title", F.when(number % 4 == 0, number + 1_000_000).alias("session_id"))
    return M.bind_external(rows, t.fx_sessions)


@query("normalised_fields", """SELECT source_record_id, arrival_seq, CASE WHEN cache_read_tokens IS NOT NULL AND cache_write_tokens IS NOT NULL THEN cache_read_tokens + cache_write_tokens ELSE 7 END AS cached,
 coalesce(CASE WHEN arrival_seq = 1 THEN reported_at END, make_timestamp(946684800000000 + input_tokens * 1000)) AS at, CASE WHEN trim(provider) <> '' THEN provider END AS provider FROM fx_usage""")
def normalised_fields(t):
    return t.fx_usage.select("source_record_id", "arrival_seq", C.cached_tokens(F.col("cache_read_tokens"), F.col("cache_write_tokens"), F.lit(7).cast("long")).alias("cached"),
                             C.time_of(F.when(F.col("arrival_seq") == 1, F.col("reported_at")), F.col("input_tokens") + 946_684_800_000).alias("at"), C.blank_to_null(F.col("provider")).alias("provider"))


@query("split_entities", "SELECT entity_id, run_id, split_part(entity_id, ':', 1) AS entity_type, split_part(entity_id, ':', 2) AS external_id FROM fx_links")
def split_entities(t):
    kind, external = C.split_entity(F.col("entity_id"))
    return t.fx_links.select("entity_id", "run_id", kind.alias("entity_type"), external.alias("external_id"))


DUP, ORDER = ["source_record_id"], ["arrival_seq"]


@query("duplicate_groups", "SELECT source_record_id, count(*) AS members FROM fx_received GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(t):
    return R.duplicate_groups(t.fx_received, DUP)


@query("reconcile_preview", """SELECT count(*) AS events_to_merge, count(DISTINCT session_id) AS affected_sessions, CAST(-coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS token_change, CAST(-coalesce(sum(estimated_cost_usd), 0) AS DOUBLE) AS cost_change
FROM fx_received WHERE arrival_seq > 1""")
def reconcile_preview(t):
    return money(R.preview(t.fx_received, DUP, ORDER))


SESSION_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in FIELDS[:-1])


@query("reconcile_apply", f"SELECT session_id, {SESSION_SUMS}, CAST(sum(estimated_cost_usd) AS DOUBLE) AS estimated_cost_usd FROM fx_received WHERE arrival_seq = 1 GROUP BY 1")
def reconcile_apply(t):
    return money(R.rebuild_sessions(R.canonical(t.fx_received, DUP, ORDER)))


@query("reconcile_attempts", "SELECT source_record_id, arrival_seq, CASE WHEN arrival_seq = 1 THEN source_record_id || '/1' END AS event_id FROM fx_received")
def reconcile_attempts(t):
    rows = t.fx_received.withColumn("event_id", F.concat("source_record_id", F.lit("/"), "arrival_seq"))
    return R.detached(rows.select("source_record_id", "arrival_seq", "event_id"), R.canonical(rows, DUP, ORDER)).select("source_record_id", "arrival_seq", "event_id")


@query("session_rebuild", f"SELECT session_id, {SESSION_SUMS}, CAST(sum(estimated_cost_usd) AS DOUBLE) AS estimated_cost_usd FROM fx_facts GROUP BY 1")
def session_rebuild(t):
    return money(R.rebuild_sessions(t.fx_facts))


@query("sum_mismatches", """WITH s AS (SELECT session_id, CAST(coalesce(sum(cache_write_tokens), 0) AS BIGINT) AS stored FROM fx_received GROUP BY 1), r AS (SELECT session_id, CAST(coalesce(sum(cache_write_tokens), 0) AS BIGINT) AS recomputed FROM fx_facts GROUP BY 1)
SELECT session_id, stored, recomputed FROM s JOIN r USING (session_id) WHERE stored <> recomputed""")
def sum_mismatches(t):
    stored = t.fx_received.groupBy("session_id").agg(F.coalesce(F.sum("cache_write_tokens"), F.lit(0)).alias("cache_write_tokens"))
    return R.sum_mismatches(stored, t.fx_facts, "cache_write_tokens")
