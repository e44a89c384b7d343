"""Queries of usage accounting."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import usage as U
from ..sources.fixtures import NOW
from .registry import query

START, END = datetime(1995, 1, 1), datetime(1998, 12, 31, 23, 59, 59)
CLOCK = datetime.fromisoformat(NOW)
T = U.TOKENS
SUMS = ", ".join(f"CAST(coalesce(sum({t}), 0) AS BIGINT) AS {t}" for t in T)
MEASURES = SUMS + (", CAST(sum(estimated_cost_usd) AS DOUBLE) AS estimated_cost_usd, count(*) AS message_count, "
                   "count(DISTINCT session_id) AS session_count, count(DISTINCT model_name) AS model_count")
ONE_PROJECT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, external_project_id ORDER BY source_database_id) AS k FROM fx_projects) WHERE k = 1)"
#: The label cascade over p (a project) and r (a row with project_id).
LABEL = r"""coalesce(nullif(regexp_replace(p.display_name, '-\d+$', ''), ''), nullif(regexp_replace(p.name, '-\d+$', ''), ''),
 CASE WHEN p.worktree IS NULL OR p.worktree IN ('', '/') THEN NULL ELSE nullif(regexp_replace(regexp_extract(p.worktree, '([^/]+)$', 1), '-\d+$', ''), '') END,
 CASE WHEN length(r.project_id) > 12 THEN substring(r.project_id, 1, 12) || '…' ELSE nullif(regexp_replace(r.project_id, '-\d+$', ''), '') END, 'unknown')"""
PROJECT_JOIN = f"LEFT JOIN {ONE_PROJECT} p ON p.client_id = r.client_id AND p.external_project_id = r.project_id"
BUCKET = "strftime(date_trunc('{}', reported_at), '%Y-%m-%d 00:00:00+00')"
STATUS = f"""CASE WHEN message_count = 0 OR last_message_at IS NULL THEN 'unknown' WHEN last_message_at > TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE THEN 'running'
 WHEN last_message_at > TIMESTAMP '{NOW}' - INTERVAL 2 HOUR AND parent_session_id IS NULL THEN 'completed' WHEN last_message_at > TIMESTAMP '{NOW}' - INTERVAL 2 HOUR THEN 'blocked'
 WHEN last_message_at > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR THEN 'stale' ELSE 'unknown' END"""
PRIMARY = """(SELECT session_id, provider AS primary_provider FROM (SELECT session_id, provider, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, provider) AS k
 FROM fx_facts WHERE provider <> '' GROUP BY session_id, provider) WHERE k = 1)"""


def money(df):
    """Costs as doubles for comparison; sums themselves are decimal."""
    return df.withColumns({c: F.col(c).cast("double") for c, kind in df.dtypes if kind.startswith("decimal")})


PROVIDERS = """pc AS (SELECT group_value, coalesce(nullif(provider, ''), 'unknown') AS p, count(*) AS n FROM g GROUP BY 1, 2),
 pb AS (SELECT group_value AS pg, '{' || string_agg('"' || p || '":' || n, ',' ORDER BY p) || '}' AS providers FROM pc GROUP BY 1)"""
RATIO = "CASE WHEN input_tokens + cache_read_tokens > 0 THEN CAST(round(CAST(cache_read_tokens AS DECIMAL(20,0)) / CAST(input_tokens + cache_read_tokens AS DECIMAL(20,0)), 4) AS DOUBLE) END AS cache_hit_ratio"


def measured(expression, joins="", where="", shown=""):
    """The SQL of aggregates: measures by group, providers, ratio; shown: further columns of a group."""
    keys = ", ".join(["group_value", *shown.split()])
    extra = ("".join(f", {c}" for c in shown.split()))
    return f"""WITH g AS (SELECT {expression} AS group_value, r.* FROM fx_facts r {joins} {where}), m AS (SELECT {keys}, {MEASURES} FROM g GROUP BY {keys}), {PROVIDERS}
SELECT m.group_value{extra}, m.* EXCLUDE ({keys}), coalesce(providers, '{{}}') AS provider_breakdown, {RATIO} FROM m LEFT JOIN pb ON pb.pg IS NOT DISTINCT FROM m.group_value"""


def grouped(name, parts, expression, joins="", shown=""):
    @query(name, measured(expression, joins, shown=shown))
    def run(t, parts=parts):
        return money(U.aggregates(t.fx_facts, parts, clients=t.fx_clients, sessions=t.fx_sessions, projects=t.fx_projects))


@query("usage_total", measured("'total'"))
def usage_total(t):
    return money(U.total(t.fx_facts))


CLIENT = "LEFT JOIN (SELECT client_id, name AS client_name FROM fx_clients) c ON c.client_id = r.client_id"
AGENT = "LEFT JOIN (SELECT session_id AS sid, agent AS a FROM fx_sessions) s ON s.sid = r.session_id"
grouped("usage_by_client", ["client"], "client_name", CLIENT)
grouped("usage_by_model", ["model"], "model_name")
grouped("usage_by_session", ["session"], "CAST(session_id AS VARCHAR)")
for _unit in ("day", "week", "month"):
    grouped(f"usage_by_{_unit}", [_unit], BUCKET.format(_unit))
grouped("usage_by_agent", ["agent"], "coalesce(a, 'unknown')", AGENT)
grouped("usage_by_client_model", ["client", "model"], "client_name || '|' || model_name", CLIENT)
grouped("usage_by_agent_month", ["agent", "month"], "coalesce(a, 'unknown') AS agent, coalesce(a, 'unknown') || '|' || " + BUCKET.format("month"), AGENT, "agent")


grouped("usage_by_project", ["project"], f"{LABEL} AS project_label, {LABEL}", PROJECT_JOIN, "project_label")


@query("usage_aggregates", measured("'total'", where=f"WHERE reported_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND client_id = 10"))
def usage_aggregates(t):
    return money(U.total(U.window(t.fx_facts, START, END, client_id=10)))


@query("usage_no_rows", measured("'total'", where="WHERE client_id = -1").replace("FROM g GROUP BY group_value)", "FROM g)").replace("SELECT group_value, CAST", "SELECT 'total' AS group_value, CAST", 1))
def usage_no_rows(t):
    return money(U.total(U.window(t.fx_facts, client_id=-1)))


@query("usage_half_open", "SELECT client_id, count(*) AS n FROM fx_facts WHERE reported_at >= TIMESTAMP '1995-01-01' AND reported_at < TIMESTAMP '1996-01-01' GROUP BY 1")
def usage_half_open(t):
    return U.window(t.fx_facts, datetime(1995, 1, 1), datetime(1996, 1, 1), half_open=True).groupBy("client_id").agg(F.count("*").alias("n"))


PRESETS = {"this-month": ("2001-08-01", NOW), "last-month": ("2001-07-01", "2001-08-01"), "last-30-days": ("2001-07-02", NOW), "last-7-days": ("2001-07-25", NOW), "custom": ("1998-02-01", "1998-02-28 23:59:59"), "what": ("2001-08-01", NOW)}


@query("usage_presets", " UNION ALL ".join(f"SELECT '{k}' AS preset, count(*) AS records, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM fx_facts WHERE reported_at BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for k, (a, b) in PRESETS.items()))
def usage_presets(t):
    """The facts are read once: each counts for all ranges that it lies in."""
    ranges = [(name, *U.preset(name, CLOCK, "1998-02-01", "1998-02-28")) for name in PRESETS]
    within = [(name, (F.col("reported_at") >= F.lit(a).cast("timestamp")) & (F.col("reported_at") <= F.lit(b).cast("timestamp"))) for name, a, b in ranges]
    sums = t.fx_facts.agg(*[F.struct(F.lit(name).alias("preset"), F.count(F.when(c, 1)).alias("records"), F.sum(F.when(c, F.col("input_tokens"))).alias("input_tokens")).alias(f"_{k}") for k, (name, c) in enumerate(within)])
    return sums.select(F.inline(F.array(*sums.columns)))


@query("provider_breakdown", """WITH n AS (SELECT model_name, coalesce(nullif(provider, ''), 'unknown') AS p, count(*) AS n FROM fx_facts GROUP BY 1, 2)
SELECT model_name, '{' || string_agg('"' || p || '":' || n, ',' ORDER BY p) || '}' AS provider_breakdown FROM n GROUP BY 1""")
def provider_breakdown(t):
    return U.provider_breakdown(t.fx_facts, ["model_name"])


@query("primary_provider", f"SELECT * FROM {PRIMARY} x")
def primary_provider(t):
    return U.primary_provider(t.fx_facts)


@query("cache_hit_ratio", """SELECT model_name, CAST(round(CAST(sum(cache_read_tokens) AS DECIMAL(20,0)) / CAST(sum(input_tokens) + sum(cache_read_tokens) AS DECIMAL(20,0)), 4) AS DOUBLE) AS cache_hit_ratio
FROM fx_facts GROUP BY 1""")
def cache_hit_ratio(t):
    return t.fx_facts.groupBy("model_name").agg(F.sum("cache_read_tokens").alias("r"), F.sum("input_tokens").alias("i")).select("model_name", C.cache_hit_ratio(F.col("r"), F.col("i")).cast("double").alias("cache_hit_ratio"))


RECORD_COLUMNS = f"r.source_record_id, r.client_id, s.source_database_id, r.session_id, r.model_name, {', '.join('r.' + x for x in T)}, nullif(r.provider, '') AS provider, r.mode, CAST(r.estimated_cost_usd AS DOUBLE) AS estimated_cost_usd, r.reported_at, r.first_ingested_at AS ingested_at"
RECORDS = f"""SELECT {RECORD_COLUMNS}, coalesce(make_timestamp(c.source_created_at * 1000), r.reported_at) AS source_created_at FROM fx_facts r JOIN fx_sessions s ON s.session_id = r.session_id
 LEFT JOIN fx_contexts c ON c.source_database_id = s.source_database_id AND c.external_session_id = s.external_session_id"""


@query("usage_records", RECORDS)
def usage_records(t):
    return money(U.records(t.fx_facts, t.fx_sessions, t.fx_contexts))


@query("usage_records_page", f"SELECT * FROM ({RECORDS}) WHERE reported_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' ORDER BY source_created_at DESC NULLS LAST, source_record_id LIMIT 50 OFFSET 100")
def usage_records_page(t):
    return money(U.records(U.window(t.fx_facts, START, END), t.fx_sessions, t.fx_contexts, "source_created_at", "desc", 50, 100))


@query("usage_records_by_ingest", f"SELECT * FROM ({RECORDS}) ORDER BY ingested_at ASC NULLS LAST, source_record_id LIMIT 100")
def usage_records_by_ingest(t):
    return money(U.records(t.fx_facts, t.fx_sessions, t.fx_contexts, "ingested_at", "asc", 100))


TOTALS = f"""(SELECT session_id AS sid, max(reported_at) AS last_message_at, count(*) AS messages, {SUMS}, CAST(sum(estimated_cost_usd) AS DOUBLE) AS estimated_cost_usd FROM fx_facts GROUP BY 1)"""


@query("usage_sessions", f"""WITH r AS (SELECT s.*, u.* EXCLUDE (sid, messages), u.messages AS message_count, q.primary_provider FROM fx_sessions s LEFT JOIN {TOTALS} u ON u.sid = s.session_id LEFT JOIN {PRIMARY} q ON q.session_id = s.session_id
 WHERE s.first_message_at <= TIMESTAMP '{END}' AND (u.last_message_at >= TIMESTAMP '{START}' OR u.last_message_at IS NULL)) SELECT r.*, {LABEL} AS project_label FROM r {PROJECT_JOIN}""")
def usage_sessions(t):
    return money(U.overlapping(U.sessions(t.fx_sessions, t.fx_facts, t.fx_projects), START, END))


@query("usage_sessions_page", f"""WITH s AS (SELECT * FROM fx_sessions ORDER BY first_message_at DESC, session_id LIMIT 50 OFFSET 100), r AS (SELECT s.*, u.* EXCLUDE (sid, messages), u.messages AS message_count, q.primary_provider FROM s LEFT JOIN {TOTALS} u ON u.sid = s.session_id LEFT JOIN {PRIMARY} q ON q.session_id = s.session_id)
SELECT r.*, {LABEL} AS project_label FROM r {PROJECT_JOIN}""")
def usage_sessions_page(t):
    first = U.page(t.fx_sessions, [F.col("first_message_at").desc(), F.col("session_id")], 50, 100)
    return money(U.sessions(first, U.of_page(t.fx_facts, first), t.fx_projects))


RUNS = f"""SELECT s.session_id, s.external_session_id, s.client_id, s.agent, s.parent_session_id, s.first_message_at, u.last_message_at, coalesce(u.messages, 0) AS message_count,
 {STATUS.replace('message_count', 'coalesce(u.messages, 0)').replace('parent_session_id', 's.parent_session_id')} AS status, s.agent || ' — ' || substring(s.external_session_id, 1, 12) AS title, c.title AS session_title,
 CASE WHEN c.session_model LIKE '{{%' THEN (c.session_model ->> '$.providerID') || ' / ' || (c.session_model ->> '$.id') ELSE c.session_model END AS session_model,
 coalesce(d.todos, 0) AS todos, coalesce(d.todos_completed, 0) AS todos_completed, coalesce(d.todos_blocked, 0) AS todos_blocked, coalesce(k.children, 0) AS children,
 coalesce(u.reasoning_tokens, 0) AS reasoning_tokens, coalesce(u.input_tokens, 0) AS input_tokens, coalesce(u.output_tokens, 0) AS output_tokens, q.primary_provider, u.estimated_cost_usd
 FROM fx_sessions s LEFT JOIN {TOTALS} u ON u.sid = s.session_id
 LEFT JOIN (SELECT session_id, count(*) AS todos, count(*) FILTER (WHERE status = 'completed') AS todos_completed, count(*) FILTER (WHERE status = 'blocked') AS todos_blocked FROM fx_todos GROUP BY 1) d ON d.session_id = s.session_id
 LEFT JOIN (SELECT parent_session_id, count(*) AS children FROM fx_sessions GROUP BY 1) k ON k.parent_session_id = s.external_session_id
 LEFT JOIN {PRIMARY} q ON q.session_id = s.session_id
 LEFT JOIN fx_contexts c ON c.source_database_id = s.source_database_id AND c.external_session_id = s.external_session_id"""


def all_runs(t, status=None):
    return U.agent_runs(t.fx_sessions, t.fx_facts, t.fx_todos, t.fx_contexts, CLOCK, status)


@query("agent_runs", RUNS)
def agent_runs(t):
    return money(all_runs(t))


@query("agent_runs_by_status", f"SELECT status, count(*) AS n FROM ({RUNS}) GROUP BY 1")
def agent_runs_by_status(t):
    return all_runs(t).groupBy("status").agg(F.count("*").alias("n"))


@query("agent_runs_stale", f"SELECT * FROM ({RUNS}) WHERE status = 'unknown' ORDER BY last_message_at DESC NULLS LAST, session_id LIMIT 50")
def agent_runs_stale(t):
    return money(U.page(all_runs(t, "unknown"), [F.col("last_message_at").desc_nulls_last(), F.col("session_id")]))


@query("agent_runs_page", f"SELECT x.* FROM ({RUNS}) x JOIN (SELECT session_id FROM fx_sessions ORDER BY first_message_at DESC, session_id LIMIT 50) p USING (session_id)")
def agent_runs_page(t):
    first = U.page(t.fx_sessions, [F.col("first_message_at").desc(), F.col("session_id")])
    runs = U.agent_runs(t.fx_sessions, U.of_page(t.fx_facts, first), U.of_page(t.fx_todos, first), t.fx_contexts, CLOCK)
    return money(U.of_page(runs, first))


@query("agent_run_detail", f"""SELECT r.*, p.parent_id, l.todo_list FROM ({RUNS}) r LEFT JOIN (SELECT external_session_id AS e, min(session_id) AS parent_id FROM fx_sessions GROUP BY 1) p ON p.e = r.parent_session_id
 LEFT JOIN (SELECT session_id AS s, string_agg(position || ' ' || status, ',' ORDER BY position) AS todo_list FROM fx_todos GROUP BY 1) l ON l.s = r.session_id""")
def agent_run_detail(t):
    rows = money(U.agent_run_detail(all_runs(t), t.fx_sessions, t.fx_todos))
    return rows.withColumn("todo_list", F.array_join(F.transform("todo_list", lambda x: F.concat_ws(" ", x["position"].cast("string"), x["status"])), ","))


@query("todo_counts", "SELECT session_id, count(*) AS todos, count(*) FILTER (WHERE status = 'completed') AS todos_completed, count(*) FILTER (WHERE status = 'blocked') AS todos_blocked FROM fx_todos GROUP BY 1")
def todo_counts(t):
    return U.todo_counts(t.fx_todos)


@query("child_counts", "SELECT parent_session_id AS external_session_id, count(*) AS children FROM fx_sessions WHERE parent_session_id IS NOT NULL GROUP BY 1")
def child_counts(t):
    return U.child_counts(t.fx_sessions)


RWC = f"""WITH r AS (SELECT f.*, s.agent, s.source_database_id AS session_database_id, s.external_session_id, c.title AS session_title FROM fx_facts f JOIN fx_sessions s ON s.session_id = f.session_id
 LEFT JOIN fx_contexts c ON c.source_database_id = s.source_database_id AND c.external_session_id = s.external_session_id),
 l AS (SELECT r.*, {LABEL} AS project_label FROM r {PROJECT_JOIN})"""


@query("records_with_context", RWC + " SELECT source_record_id, session_id, agent, session_title, project_label, model_name, input_tokens, CAST(estimated_cost_usd AS DOUBLE) AS estimated_cost_usd FROM l")
def records_with_context(t):
    return money(U.records_with_context(t.fx_facts, t.fx_sessions, t.fx_contexts, t.fx_projects).select(
        "source_record_id", "session_id", "agent", "session_title", "project_label", "model_name", "input_tokens", "estimated_cost_usd"))


for _part, _value in {"project": "project_label", "session": "CAST(session_id AS VARCHAR)", "agent": "coalesce(agent, 'unknown')", "model": "model_name"}.items():

    @query(f"rwc_grouped_{_part}", f"{RWC} SELECT {_value} AS group_value, {SUMS}, CAST(sum(estimated_cost_usd) AS DOUBLE) AS estimated_cost_usd, count(*) AS message_count, max(session_title) AS session_title FROM l GROUP BY 1")
    def rwc_grouped(t, part=_part):
        return money(U.records_with_context_grouped(U.records_with_context(t.fx_facts, t.fx_sessions, t.fx_contexts, t.fx_projects if part == "project" else None), [part]))


@query("client_summary", """WITH x AS (SELECT client_id AS client, project_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, sum(estimated_cost_usd) AS cost, count(DISTINCT session_id) AS s, count(DISTINCT model_name) AS m FROM fx_facts GROUP BY 1, 2)
SELECT client, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(s) AS BIGINT) AS session_count, CAST(sum(m) AS BIGINT) AS model_count FROM x GROUP BY 1""")
def client_summary(t):
    rows = t.fx_facts.groupBy(F.col("client_id").alias("client"), "project_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("estimated_cost_usd").alias("cost"),
                                                                                  F.countDistinct("session_id").alias("session_count"), F.countDistinct("model_name").alias("model_count"))
    return money(U.client_summary(rows))


@query("client_agents", f"WITH s AS (SELECT session_id AS sid, agent FROM fx_sessions) SELECT client_id, coalesce(agent, 'unknown') AS agent, {SUMS}, count(*) AS message_count FROM fx_facts LEFT JOIN s ON sid = session_id GROUP BY 1, 2")
def client_agents(t):
    return U.client_agents(t.fx_facts, t.fx_sessions)


VENDOR_NAME = "CASE CAST(substring(model_name, 7, 1) AS INTEGER) WHEN 1 THEN 'GPT-' WHEN 2 THEN 'claude-' WHEN 3 THEN 'Gemma' WHEN 4 THEN 'mixtral' ELSE 'own' END || model_name"


@query("model_mix", f"""WITH v AS (SELECT {VENDOR_NAME} AS m, input_tokens + output_tokens AS n FROM fx_facts),
 w AS (SELECT CASE WHEN m LIKE 'GPT%' THEN 'OpenAI' WHEN m LIKE 'claude%' THEN 'Anthropic' WHEN m LIKE 'Gemma%' THEN 'Google' WHEN m LIKE 'mixtral%' THEN 'Meta/Mistral' ELSE 'Other' END AS vendor, CAST(sum(n) AS BIGINT) AS tokens FROM v GROUP BY 1)
SELECT vendor, tokens, round(CAST(tokens AS DOUBLE) * 100 / max(tokens) OVER (), 2) AS percent_of_most FROM w""")
def model_mix(t):
    return U.model_mix(t.fx_facts.withColumn("model_name", F.expr(VENDOR_NAME.replace("INTEGER", "INT"))))
