"""Queries of the store of runs: upserts, lists, details, bindings, collectors, and the backfill of a window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import closure as E
from ..operators import merge as M
from ..operators import outcomes as O
from ..operators import reporting as G
from ..operators import usage as U
from ..session import stage
from ..sources.fixtures import NOW
from .activity import CORRELATE, EPISODES, FIRST, LINK_STATES, RES, closure_facts, delivered
from .registry import query
from .usage import TOTALS, money

CLOCK = datetime.fromisoformat(NOW)


def first(c, null=True):
    return f"arg_min{'_null' if null else ''}({c}, arrival_seq)" + ("" if null else f" FILTER (WHERE {c} IS NOT NULL)") + f" AS {c}"


def last(c, null=False):
    return f"arg_max{'_null' if null else ''}({c}, arrival_seq)" + ("" if null else f" FILTER (WHERE {c} IS NOT NULL)") + f" AS {c}"


RUNS = f"""ru AS (SELECT run_id, {first('provider')}, {last('status', True)}, {first('started_at', False)}, {last('title')}, {last('finished_at')}, {last('outcome_status')},
 min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM fx_run_saves GROUP BY 1)"""
LINKS = """li AS (SELECT *, split_part(entity_id, ':', 1) AS entity_type, split_part(entity_id, ':', 2) AS external_id, 'repo-' || CAST(split_part(entity_id, ':', 2) AS INTEGER) % 5 AS repository, confidence < max(confidence) OVER (PARTITION BY entity_id) AS superseded
 FROM (SELECT run_id, entity_id, max(confidence) AS confidence, arg_max(method, arrival_seq) FILTER (WHERE method IS NOT NULL) AS method, arg_max(role, arrival_seq) AS role FROM fx_links GROUP BY 1, 2))"""
SESSIONS = f"rs AS (SELECT run_id, external_session_id, {first('started_at', False)}, {last('session_id')}, {last('finished_at')}, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM fx_session_saves GROUP BY 1, 2)"
OPEN = f"""op AS (SELECT provider, repository, entity_type, external_id, run_id, method, max(confidence) AS confidence, string_agg(evidence, ',' ORDER BY arrival_seq) AS evidence, {last('reason')}, {last('candidates')}, {last('resolver_version')}, min(seen_at) AS created_at
 FROM fx_open_saves GROUP BY 1, 2, 3, 4, 5, 6)"""


def stored_links(t):
    kind, external = C.split_entity(F.col("entity_id"))
    rows = M.link_upsert(t.fx_links).drop("evidence", "source").withColumn("entity_type", kind).withColumn("external_id", external)
    return rows.withColumn("repository", F.concat(F.lit("repo-"), (F.col("external_id").cast("int") % 5).cast("string")))


def stored_open(t):
    return O.unresolved_upsert(t.fx_open_saves).withColumn("evidence", F.array_join("evidence", ","))


@query("run_upsert", f"WITH {RUNS} SELECT * FROM ru")
def run_upsert(t):
    return O.run_upsert(t.fx_run_saves)


@query("session_link_upsert", f"WITH {SESSIONS} SELECT * FROM rs")
def session_link_upsert(t):
    return O.session_link_upsert(t.fx_session_saves)


@query("unresolved_upsert", f"WITH {OPEN} SELECT * FROM op")
def unresolved_upsert(t):
    return stored_open(t)


@query("association_upsert", f"""SELECT provider, repository, 'change_request' AS resource_type, external_id AS resource_number, run_id AS external_session_id, arg_min_null(evidence, arrival_seq) AS source_reference,
 arg_min(candidates, arrival_seq) FILTER (WHERE candidates IS NOT NULL) AS session_id, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM fx_open_saves GROUP BY 1, 2, 4, 5""")
def association_upsert(t):
    rows = t.fx_open_saves.select("provider", "repository", F.lit("change_request").alias("resource_type"), F.col("external_id").alias("resource_number"), F.col("run_id").alias("external_session_id"),
                                  F.col("evidence").alias("source_reference"), F.col("candidates").alias("session_id"), "arrival_seq", "seen_at")
    return O.association_upsert(rows)


@query("afk_runs", f"WITH {RUNS} SELECT * FROM ru ORDER BY last_seen_at DESC")
def afk_runs(t):
    return O.runs(O.run_upsert(t.fx_run_saves), stored_links(t))


@query("afk_runs_of_repository", f"""WITH {RUNS}, {LINKS} SELECT * FROM ru WHERE EXISTS (SELECT 1 FROM li WHERE li.run_id = ru.run_id AND li.repository = 'repo-3') AND status = 'completed' AND provider = 'github'
 AND last_seen_at >= TIMESTAMP '1998-01-01' AND started_at <= TIMESTAMP '2000-01-01'""")
def afk_runs_of_repository(t):
    return O.runs(O.run_upsert(t.fx_run_saves), stored_links(t), "repo-3", "completed", origin="github", seen=(datetime(1998, 1, 1), None), started=(None, datetime(2000, 1, 1)))


@query("afk_entities", f"WITH {LINKS} SELECT run_id, entity_id, entity_type, external_id, repository, role, method, confidence, superseded, role <> 'resolved' AS provisional FROM li")
def afk_entities(t):
    return O.entities(stored_links(t))


@query("afk_correlations", f"WITH {OPEN} SELECT *, entity_type || ':' || external_id AS entity_id, true AS provisional FROM op WHERE reason = 'ambiguous'")
def afk_correlations(t):
    return O.correlations(stored_open(t), "ambiguous")


LISTED = ", ".join(f"coalesce(string_agg(external_id || ' ' || role, ',' ORDER BY external_id) FILTER (WHERE entity_type = '{k}'), '') AS {v}" for k, v in O.ENTITY_LISTS.items())
USED = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"))


@query("afk_run_detail", f"""WITH {RUNS}, {LINKS}, {SESSIONS}, el AS (SELECT run_id, {LISTED} FROM li WHERE NOT superseded GROUP BY 1),
 us AS (SELECT rs.run_id, string_agg(rs.external_session_id, ',' ORDER BY started_at NULLS LAST, rs.external_session_id) AS sessions, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents, count(*) AS session_count, CAST(coalesce(sum(messages), 0) AS BIGINT) AS message_count, {USED}, sum(estimated_cost_usd) AS estimated_cost_usd
  FROM rs LEFT JOIN (SELECT session_id, agent FROM fx_sessions) s ON s.session_id = rs.session_id LEFT JOIN {TOTALS} u ON u.sid = rs.session_id GROUP BY 1)
SELECT ru.*, {", ".join(O.ENTITY_LISTS.values())}, us.* EXCLUDE (run_id), input_tokens + output_tokens AS active_tokens FROM ru LEFT JOIN el USING (run_id) LEFT JOIN us USING (run_id)""")
def afk_run_detail(t):
    rows = O.run_details(O.run_upsert(t.fx_run_saves), stored_links(t), O.session_link_upsert(t.fx_session_saves), t.fx_sessions, U.session_totals(t.fx_facts))
    shown = {v: F.array_join(F.transform(v, lambda x: F.concat_ws(" ", x["external_id"], x["role"])), ",") for v in O.ENTITY_LISTS.values()}
    shown |= {"sessions": F.array_join(F.transform("sessions", lambda x: x["external_session_id"]), ","), "agents": F.nullif(F.array_join("agents", ","), F.lit(""))}
    return money(rows.withColumns(shown))


@query("reporting_session_links", f"WITH {SESSIONS} SELECT rs.*, agent, true AS provisional FROM rs LEFT JOIN (SELECT session_id, agent FROM fx_sessions) s ON s.session_id = rs.session_id")
def reporting_session_links(t):
    return O.session_links(O.session_link_upsert(t.fx_session_saves), t.fx_sessions)


@query("reporting_resource_detail", f"""WITH {FIRST} SELECT {RES}, count(*) AS deliveries, arg_max(delivery_id, (occurred_at, delivery_id)) AS last_delivery_id, max(occurred_at) AS last_occurred_at,
 string_agg(delivery_id || ' ' || state, ',' ORDER BY occurred_at, event_id, state) AS state_trail FROM d GROUP BY {RES}""")
def reporting_resource_detail(t):
    return G.resource_details(delivered(t), created="event_id").withColumn("state_trail", F.array_join(F.transform("state_trail", lambda x: F.concat_ws(" ", x["delivery_id"], x["state"])), ","))


@query("run_read_back", f"""WITH {LINKS}, {SESSIONS}, l AS (SELECT DISTINCT run_id, entity_id, method FROM li WHERE NOT superseded), ev AS (SELECT entity_type || ':' || number AS entity_id, count(*) AS n FROM (SELECT entity_type, CAST(event_id % 500 AS VARCHAR) AS number FROM fx_events) GROUP BY 1),
 en AS (SELECT DISTINCT entity_type || ':' || (l_orderkey % 300) AS entity_id FROM lineitem, (SELECT DISTINCT entity_type FROM li)), ss AS (SELECT run_id, count(*) AS n FROM rs GROUP BY 1)
SELECT l.run_id, count(*) AS links, count(method) AS correlations, count(en.entity_id) AS entities, CAST(coalesce(sum(ev.n), 0) AS BIGINT) AS events, coalesce(any_value(ss.n), 0) AS sessions FROM l LEFT JOIN en USING (entity_id) LEFT JOIN ev USING (entity_id) LEFT JOIN ss ON ss.run_id = l.run_id GROUP BY 1""")
def run_read_back(t):
    links = stored_links(t)
    kinds = links.select("entity_type").distinct().withColumn("_j", F.lit(1))
    numbers = t.lineitem.select((F.col("l_orderkey") % 300).cast("string").alias("n")).distinct().withColumn("_j", F.lit(1))
    known = kinds.join(numbers, "_j").select(C.entity_display(F.col("entity_type"), F.col("n")).alias("entity_id"))
    events = t.fx_events.select(C.entity_display(F.col("entity_type"), (F.col("event_id") % 500).cast("string")).alias("entity_id"))
    return O.read_back(links, known, events, O.session_link_upsert(t.fx_session_saves))


@query("run_documents", f"""WITH {RUNS}, {LINKS}, {SESSIONS}, fe AS (SELECT run_id, entity_id, string_agg(evidence, ',' ORDER BY arrival_seq) AS evidence, arg_max(source, arrival_seq) AS source FROM fx_links GROUP BY 1, 2),
 l AS (SELECT li.*, fe.evidence, fe.source FROM li JOIN fe USING (run_id, entity_id) WHERE NOT superseded), ev AS (SELECT event_type, occurred_at, entity_type || ':' || (event_id % 500) AS entity_id, 'repo-' || (event_id % 500 % 5) AS repository, external_id AS actor FROM fx_events),
 a AS (SELECT run_id, string_agg(entity_id || '|' || repository, ',' ORDER BY entity_id) AS entities, string_agg(entity_id || '|' || role, ',' ORDER BY entity_id) AS entity_links, string_agg(run_id || ':' || entity_id || '|' || method || '|' || evidence, ',' ORDER BY run_id || ':' || entity_id) FILTER (WHERE method IS NOT NULL) AS correlations FROM l GROUP BY 1),
 h AS (SELECT run_id, string_agg(l.entity_id || ':' || event_type || '|' || actor, ',' ORDER BY occurred_at, l.entity_id || ':' || event_type, actor) AS events FROM l JOIN ev USING (entity_id) GROUP BY 1),
 w AS (SELECT run_id, string_agg(external_session_id || '|' || coalesce(session_id, -1), ',' ORDER BY external_session_id) AS session_links FROM rs GROUP BY 1)
SELECT ru.*, coalesce(entities, '') AS entities, coalesce(entity_links, '') AS entity_links, coalesce(correlations, '') AS correlations, coalesce(events, '') AS events, coalesce(session_links, '') AS session_links
FROM ru LEFT JOIN a USING (run_id) LEFT JOIN h USING (run_id) LEFT JOIN w USING (run_id)""")
def run_documents(t):
    """Runs with all that hangs on them, shown as text."""
    links = M.link_upsert(t.fx_links)
    kind, external = C.split_entity(F.col("entity_id"))
    links = links.withColumns({"entity_type": kind, "external_id": external, "provider": F.lit("github"), "owning_change_request_id": F.lit(None).cast("string")}).drop("entity_id")
    links = links.withColumn("repository", F.concat(F.lit("repo-"), (F.col("external_id").cast("int") % 5).cast("string")))
    number = F.col("event_id") % 500
    events = t.fx_events.select(F.lit("github").alias("provider"), F.concat(F.lit("repo-"), (number % 5).cast("string")).alias("repository"), "entity_type", number.cast("string").alias("external_id"), "event_type", "occurred_at",
                                F.col("external_id").alias("actor"), F.lit(None).cast("string").alias("payload"))
    rows = O.run_documents(O.run_upsert(t.fx_run_saves), links, events, O.session_link_upsert(t.fx_session_saves))
    text = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[F.array_join(x[p], ",") if p == "evidence" else x[p] for p in parts])), ",")
    sessions = F.array_join(F.transform("session_links", lambda x: F.concat_ws("|", x["external_session_id"], F.coalesce(x["session_id"], F.lit(-1)).cast("string"))), ",")
    return rows.withColumns({"entities": text("entities", "entity_id", "repository"), "entity_links": text("entity_links", "entity_id", "role"), "correlations": text("correlations", "correlation_id", "method", "evidence"),
                             "events": text("events", "event_id", "actor"), "session_links": sessions})


BINDINGS = "bi AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY arrival_seq) AS k FROM fx_binding_saves) WHERE k = 1)"


def bindings(t):
    return M.keep_first(t.fx_binding_saves, ["job_id"], [F.col("arrival_seq")])


@query("binding_by_job", f"WITH {BINDINGS} SELECT * FROM bi")
def binding_by_job(t):
    jobs = t.fx_binding_saves.select("job_id").unionByName(t.spark.range(1).select(F.lit("x1").alias("job_id")))
    return O.bindings_by_job(bindings(t), jobs)


@query("bindings_for_resource", f"""WITH {BINDINGS} SELECT provider, 'host.example/org/repo-' || regexp_extract(repository_url, 'repo-(\\d+)', 1) AS repository, resource_type, resource_number,
 string_agg(job_id || ' ' || outcome, ',' ORDER BY created_at, binding_id) AS history FROM bi GROUP BY 1, 2, 3, 4""")
def bindings_for_resource(t):
    return O.bindings_for_resource(bindings(t)).withColumn("history", F.array_join(F.transform("history", lambda x: F.concat_ws(" ", x["job_id"], x["outcome"])), ","))


@query("collector_health", f"""SELECT credential_id, c.name AS client_name, last_heartbeat, CAST(coalesce(records, 0) AS BIGINT) AS records, CASE WHEN last_heartbeat IS NULL THEN 'unknown' WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_heartbeat) <= 900000000 THEN 'healthy' ELSE 'stale' END AS health
FROM fx_credentials k JOIN fx_clients c USING (client_id) LEFT JOIN (SELECT credential_id, max(ingested_at) AS last_heartbeat, sum(record_count) AS records FROM fx_batches GROUP BY 1) b USING (credential_id) WHERE revoked_at IS NULL""")
def collector_health(t):
    return O.collector_health(t.fx_credentials, t.fx_clients, t.fx_batches, CLOCK, 900)


@query("clients", "SELECT c.*, coalesce(tokens, 0) AS tokens, coalesce(revoked_tokens, 0) AS revoked_tokens FROM fx_clients c LEFT JOIN (SELECT client_id, count(*) FILTER (WHERE revoked_at IS NULL) AS tokens, count(revoked_at) AS revoked_tokens FROM fx_credentials GROUP BY 1) k USING (client_id)")
def clients(t):
    return O.client_list(t.fx_clients, t.fx_credentials)


@query("tokens", "SELECT client_id, name, credential_id, revoked_at FROM fx_credentials JOIN fx_clients USING (client_id)")
def tokens(t):
    return t.fx_credentials.join(t.fx_clients.select("client_id", "name"), "client_id")


@query("cursor", "SELECT c.c_custkey AS source_database_id, last_seen_at, record_count, is_active, d.source_database_id IS NOT NULL AS found FROM customer c LEFT JOIN fx_databases d ON d.source_database_id = c.c_custkey")
def cursor(t):
    return O.source_cursors(t.fx_databases, t.customer.select(F.col("c_custkey").alias("source_database_id")))


@query("project_names", "SELECT client_id, source_database_id, external_project_id, CASE WHEN name IS NULL AND worktree IS NOT NULL AND worktree NOT IN ('', '/') THEN regexp_replace(worktree, '^.*[\\\\/]', '') ELSE name END AS name FROM fx_projects")
def project_names(t):
    return t.fx_projects.select("client_id", "source_database_id", "external_project_id", C.project_name(F.col("name"), F.col("worktree")).alias("name"))


SINCE, UNTIL = datetime(1996, 1, 1), datetime(1996, 3, 31)
TITLED = "'Change ' || CAST(regexp_extract(title, '#(\\d+)', 1) AS INTEGER) % 17"
WINDOW = f"""bf_runs AS (SELECT 'c' || s.client_id AS scope, CAST(s.session_id AS VARCHAR) AS run_id, CASE WHEN c.title IS NOT NULL THEN {TITLED} END AS title, first_message_at AS started_at, u.last_message_at AS finished_at, NULL AS client FROM fx_sessions s JOIN {TOTALS} u ON u.sid = s.session_id
 LEFT JOIN fx_contexts c ON c.source_database_id = s.source_database_id AND c.external_session_id = s.external_session_id WHERE first_message_at <= TIMESTAMP '{UNTIL}' AND u.last_message_at >= TIMESTAMP '{SINCE}')"""


def window_runs(t):
    """The window's runs, which many steps read, written once: they come from all facts."""
    rows = t.fx_sessions.join(U.session_totals(t.fx_facts).select("session_id", "last_message_at"), "session_id")
    number = F.regexp_extract("title", r"#(\d+)", 1).try_cast("int") % 17
    contexts = t.fx_contexts.withColumn("title", F.concat(F.lit("Change "), number.cast("string")))
    return stage(O.window_runs(rows, contexts, SINCE, UNTIL, F.concat(F.lit("c"), F.col("client_id").cast("string"))), "runs")


@query("backfill_report", f"""WITH {WINDOW}, {CORRELATE.replace('fx_runs', 'bf_runs')}, un AS (SELECT count(*) AS n FROM bf_runs r WHERE NOT EXISTS (SELECT 1 FROM tm WHERE tm.scope = r.scope AND tm.run_id = r.run_id) AND NOT EXISTS (SELECT 1 FROM cor WHERE cor.scope = r.scope AND cor.run_id = r.run_id))
SELECT count(*) FILTER (WHERE method = 'explicit_run_id') AS explicit, count(*) FILTER (WHERE method <> 'explicit_run_id' AND confidence >= 0.5) AS high, count(*) FILTER (WHERE method <> 'explicit_run_id' AND confidence < 0.5) AS inferred,
 (SELECT count(*) FROM (SELECT DISTINCT scope, run_id FROM tm WHERE matches > 1)) AS ambiguous, any_value(un.n) AS unmatched FROM cor, un""")
def backfill_report(t):
    return O.backfill(window_runs(t), t.fx_entities, t.fx_run_events, no_links(t))[1]


def no_links(t):
    return stored_links(t).where("false").select("run_id", "entity_id", "entity_type", "role")


@query("backfill_links", f"""WITH {WINDOW}, {CORRELATE.replace('fx_runs', 'bf_runs')}, own_cr AS (SELECT scope, run_id, min(entity_id) AS entity_id FROM cor WHERE entity_id LIKE 'change_request:%' AND confidence >= 0.5 GROUP BY 1, 2)
SELECT cor.scope, CASE WHEN own_cr.entity_id IS NOT NULL AND ascii(right(own_cr.entity_id, 1)) % 2 = 0 THEN 'stored ' || own_cr.entity_id END AS stored_run, cor.entity_id, confidence, method, CASE WHEN confidence >= 0.5 THEN 'resolved' ELSE 'referenced' END AS role FROM cor LEFT JOIN own_cr USING (scope, run_id)""")
def backfill_links(t):
    claims = t.fx_entities.where("entity_type = 'change_request'").where(F.ascii(F.substring("entity_id", -1, 1)) % 2 == 0).select("entity_id").distinct()
    stored = claims.select(F.concat(F.lit("stored "), "entity_id").alias("run_id"), "entity_id", F.lit("change_request").alias("entity_type"), F.lit("resolved").alias("role"))
    links = O.backfill(window_runs(t), t.fx_entities, t.fx_run_events, stored)[0]
    return links.select("scope", F.when(F.col("run_id").startswith("stored "), F.col("run_id")).alias("stored_run"), "entity_id", "confidence", "method", "role")


@query("closure_history", f"""WITH {EPISODES}, h AS (SELECT repository, issue_id, string_agg(CASE WHEN latest THEN found ELSE 'superseded' END, ',' ORDER BY closed_at NULLS LAST, opened_at NULLS LAST, segment) AS episodes,
  coalesce(string_agg(found || ':' || CASE WHEN found = 'ambiguous' THEN names ELSE '' END, ';' ORDER BY closed_at, found) FILTER (WHERE found IN ('ambiguous', 'unmatched')), '') AS unresolved FROM ep GROUP BY 1, 2),
 v AS (SELECT repository, issue_id, string_agg(cr_id || ' ' || state, ',' ORDER BY cr_id) AS evidence FROM ls GROUP BY 1, 2)
SELECT h.*, coalesce(evidence, '') AS evidence FROM h LEFT JOIN v USING (repository, issue_id)""")
def closure_history(t):
    facts = closure_facts(t)
    rows = E.histories(E.episodes(facts), E.link_states(facts))
    both = F.transform("unresolved", lambda x: F.concat(x["reason"], F.lit(":"), x["candidates"]))
    return rows.select(*E.ISSUE, F.array_join(F.transform("episodes", lambda x: x["status"]), ",").alias("episodes"), F.array_join(both, ";").alias("unresolved"),
                       F.array_join(F.transform("evidence", lambda x: F.concat_ws(" ", x["cr_id"], x["state"])), ",").alias("evidence"))


@query("closure_reverse_links", f"WITH {LINK_STATES} SELECT repository, cr_id, string_agg(issue_id || ' ' || state, ',' ORDER BY issue_id) AS issues FROM ls GROUP BY 1, 2")
def closure_reverse_links(t):
    rows = E.link_states(closure_facts(t)).groupBy("repository", "cr_id").agg(F.sort_array(F.collect_list(F.struct("issue_id", "state"))).alias("issues"))
    return rows.withColumn("issues", F.array_join(F.transform("issues", lambda x: F.concat_ws(" ", x["issue_id"], x["state"])), ","))
