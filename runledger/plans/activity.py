"""Queries of transcripts, forge deliveries, correlation, closures and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import redaction
from ..operators import closure as E
from ..operators import correlation as N
from ..operators import reporting as G
from ..operators import transcript as X
from ..sources.fixtures import NOW
from ..session import stage
from .registry import query
from .usage import money

CLOCK = datetime.fromisoformat(NOW)
MS = "coalesce(source_created_at, 4611686018427387904)"

# ---- transcripts


@query("session_header_counts", """WITH s AS (SELECT DISTINCT session_id FROM fx_messages)
SELECT session_id, (SELECT count(*) FROM fx_messages m WHERE m.session_id = s.session_id) AS messages, count(p.session_id) AS parts, count(*) FILTER (WHERE p.part_type = 'tool') AS tool_calls,
 min(p.source_created_at) AS first_part_at, max(p.source_created_at) AS last_part_at FROM s LEFT JOIN fx_parts p USING (session_id) GROUP BY 1""")
def session_header_counts(t):
    return X.header_counts(t.fx_messages.select("session_id").distinct(), t.fx_messages, t.fx_parts)


@query("exec_messages", f"SELECT session_id, external_message_id, role, source_created_at FROM fx_messages WHERE ({MS}, external_message_id) > (1700000300000, 'msg_5_0') ORDER BY {MS}, external_message_id LIMIT 101")
def exec_messages(t):
    return X.keyset_page(t.fx_messages, "external_message_id", (1700000300000, "msg_5_0")).select("session_id", "external_message_id", "role", "source_created_at")


@query("exec_parts", f"SELECT external_part_id, part_type, source_created_at FROM fx_parts WHERE part_type = 'tool' ORDER BY {MS}, external_part_id LIMIT 51")
def exec_parts(t):
    return X.keyset_page(t.fx_parts.where("part_type = 'tool'"), "external_part_id", None, 50).select("external_part_id", "part_type", "source_created_at")


TOOLS = """SELECT external_part_id, data ->> '$.tool' AS tool_name, coalesce(data ->> '$.state.status', data ->> '$.status') AS tool_status, coalesce(data ->> '$.state.input', data ->> '$.input') AS tool_input,
 coalesce(data ->> '$.state.output', data ->> '$.output') AS tool_output FROM fx_parts WHERE part_type = 'tool' AND data ->> '$.tool' IS NOT NULL"""


@query("exec_tool_calls", TOOLS)
def exec_tool_calls(t):
    return X.tool_calls(t.fx_parts).drop("session_id", "external_message_id", "source_created_at")


@query("exec_bash_calls", f"SELECT * FROM ({TOOLS}) WHERE tool_name = 'bash' AND tool_status = 'error'")
def exec_bash_calls(t):
    return X.tool_calls(t.fx_parts, "bash", "error").drop("session_id", "external_message_id", "source_created_at")


@query("exec_session", """SELECT s.session_id, s.external_session_id, s.agent, s.parent_session_id, count(DISTINCT m.external_message_id) AS messages FROM fx_sessions s LEFT JOIN fx_messages m ON m.session_id = s.session_id GROUP BY 1, 2, 3, 4""")
def exec_session(t):
    counts = t.fx_messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    return t.fx_sessions.select("session_id", "external_session_id", "agent", "parent_session_id").join(counts, "session_id", "left").fillna(0, ["messages"])


@query("exec_page_end", f"""WITH p AS (SELECT {MS} AS ms, external_message_id AS id FROM fx_messages ORDER BY 1, 2 LIMIT 51), l AS (SELECT ms, id FROM (SELECT *, row_number() OVER (ORDER BY ms, id) AS k FROM p) WHERE k = 50)
SELECT (SELECT count(*) FROM p) > 50 AS has_more, CASE WHEN (SELECT count(*) FROM p) > 50 THEN translate(to_base64(encode(ms || ':' || id)), '+/', '-_') END AS next_cursor FROM (SELECT 1) LEFT JOIN l ON true""")
def exec_page_end(t):
    return X.page_end(X.keyset_page(t.fx_messages, "external_message_id", None, 50), "external_message_id", 50)


@query("tool_call_deferred", f"""WITH n AS ({TOOLS}), w AS (SELECT external_part_id, row_number() OVER (ORDER BY external_part_id) AS k FROM n WHERE tool_name = 'bash')
SELECT n.external_part_id, CASE WHEN k IS NULL THEN 'unchanged' WHEN k <= 20 THEN 'repaired' ELSE 'deferred' END AS state FROM n LEFT JOIN w USING (external_part_id)""")
def tool_call_deferred(t):
    old = X.tool_calls(t.fx_parts).withColumn("tool_status", F.when(F.col("tool_name") == "bash", "old").otherwise(F.col("tool_status")))
    return X.tool_call_repair(old, t.fx_parts, 20).select("external_part_id", "state")


@query("tool_call_repair", f"""WITH n AS ({TOOLS}), o AS (SELECT external_part_id, tool_name, CASE WHEN tool_name = 'bash' THEN 'old' ELSE tool_status END AS tool_status, tool_input, tool_output FROM n WHERE tool_name <> 'read' OR tool_output <> '20' UNION ALL SELECT 'gone', 'x', NULL, NULL, NULL)
SELECT coalesce(n.external_part_id, o.external_part_id) AS external_part_id, CASE WHEN n.external_part_id IS NULL THEN 'skipped' WHEN o.external_part_id IS NOT NULL AND n.tool_status IS NOT DISTINCT FROM o.tool_status THEN 'unchanged' ELSE 'repaired' END AS state
FROM o FULL JOIN n USING (external_part_id)""")
def tool_call_repair(t):
    new = X.tool_calls(t.fx_parts)
    old = new.where("tool_name <> 'read' or tool_output <> '20'").withColumn("tool_status", F.when(F.col("tool_name") == "bash", "old").otherwise(F.col("tool_status")))
    gone = t.spark.range(1).select(F.lit("gone").alias("external_part_id"), F.lit("x").alias("tool_name"), *[F.lit(None).cast("string").alias(c) for c in ("tool_status", "tool_input", "tool_output")])
    return X.tool_call_repair(old.select(*gone.columns).unionByName(gone), t.fx_parts).select("external_part_id", "state")


EDGES = "e AS (SELECT DISTINCT parent_session_id AS parent_id, session_id AS child_id FROM fx_messages WHERE parent_session_id IS NOT NULL)"


def edges(t):
    return X.session_edges(t.fx_messages.select("session_id", "parent_session_id").distinct(), t.fx_messages)


@query("session_edges", f"WITH {EDGES} SELECT * FROM e")
def session_edges(t):
    return edges(t)


@query("session_edges_both", """SELECT DISTINCT parent_id, child_id FROM (SELECT CAST(substr(parent_session_id, 5) AS BIGINT) AS parent_id, session_id AS child_id FROM fx_sessions WHERE parent_session_id IS NOT NULL
 UNION ALL SELECT parent_session_id, session_id FROM fx_messages WHERE parent_session_id IS NOT NULL)""")
def session_edges_both(t):
    """Edges that the sessions name, those that the messages name, and some that both do."""
    sessions = t.fx_sessions.select("session_id", F.substring("parent_session_id", 5, 20).cast("long").alias("parent_session_id"))
    return X.session_edges(sessions, t.fx_messages)


@query("tool_fields_bounded", """SELECT external_part_id, CASE WHEN n + 9 <= 4096 THEN '{"k":"' || repeat('a', n) || '"}' ELSE '"' || left('{\\"k\\": \\"' || repeat('a', n), 4096 + 3) || '"' END AS tool_input FROM (SELECT external_part_id, CAST(4000 + session_id % 20 * 10 AS INTEGER) AS n FROM fx_parts)""")
def tool_fields_bounded(t):
    text = F.concat(F.lit('{"k":"'), F.expr("repeat('a', cast(4000 + session_id % 20 * 10 as int))"), F.lit('"}'))
    return t.fx_parts.select("external_part_id", redaction.bounded_json(text).alias("tool_input"))


@query("session_timeline", f"""WITH RECURSIVE {EDGES}, w(root_id, session_id, depth) AS (SELECT DISTINCT session_id, session_id, 0 FROM fx_messages UNION ALL SELECT w.root_id, e.child_id, w.depth + 1 FROM w JOIN e ON e.parent_id = w.session_id WHERE w.depth < 50)
SELECT w.root_id, w.depth, p.session_id, p.external_part_id FROM w JOIN fx_parts p ON p.session_id = w.session_id""")
def session_timeline(t):
    roots = t.fx_messages.select("session_id").distinct()
    return X.timeline(t.fx_parts, edges(t), roots).select("root_id", "depth", "session_id", "external_part_id")


@query("exec_timeline", f"""WITH RECURSIVE {EDGES}, w(root_id, session_id, depth) AS (SELECT DISTINCT session_id, session_id, 0 FROM fx_messages UNION SELECT w.root_id, e.child_id, w.depth + 1 FROM w JOIN e ON e.parent_id = w.session_id WHERE w.depth < 2)
SELECT w.root_id, min(w.depth) AS depth, p.session_id, p.external_part_id FROM w JOIN fx_parts p ON p.session_id = w.session_id WHERE w.session_id % 2 = 0 AND p.source_created_at BETWEEN 1700000200000 AND 1700003000000 GROUP BY 1, 3, 4""")
def exec_timeline(t):
    ids = t.fx_messages.select("session_id").distinct()
    agents = ids.withColumn("agent", F.when(F.col("session_id") % 2 == 0, "even").otherwise("odd"))
    return X.timeline(t.fx_parts, edges(t), ids, 2, agents, "even", 1700000200000, 1700003000000).select("root_id", "depth", "session_id", "external_part_id")


TREE = """t AS (SELECT DISTINCT parent_id, child_id FROM fx_tree), w(root_id, session_id, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION SELECT w.root_id, t.child_id, w.depth + 1 FROM w JOIN t ON t.parent_id = w.session_id WHERE w.depth < {})"""


@query("session_descendants", f"WITH RECURSIVE {TREE.format(12)} SELECT root_id, session_id, min(depth) AS depth FROM w GROUP BY 1, 2")
def session_descendants(t):
    return X.descendants(t.fx_tree, t.customer.select(F.col("c_custkey").alias("session_id")), None)


@query("session_descendants_bounded", f"WITH RECURSIVE {TREE.format(2)} SELECT root_id, session_id, min(depth) AS depth FROM w GROUP BY 1, 2")
def session_descendants_bounded(t):
    return X.descendants(t.fx_tree, t.customer.select(F.col("c_custkey").alias("session_id")), 2)


@query("exec_children", f"WITH {EDGES} SELECT parent_id, count(*) AS children FROM e GROUP BY 1")
def exec_children(t):
    return edges(t).groupBy("parent_id").agg(F.count("*").alias("children"))


CUT = 1700002000000


@query("transcript_retention", f"""WITH calls AS (SELECT * FROM fx_parts WHERE part_type = 'tool' AND NOT coalesce(source_created_at < {CUT}, false)),
 parts AS (SELECT * FROM fx_parts p WHERE NOT coalesce(source_created_at < {CUT} - 500000, false) OR EXISTS (SELECT 1 FROM calls c WHERE c.external_part_id = p.external_part_id))
SELECT external_message_id FROM fx_messages m WHERE NOT coalesce(source_created_at < {CUT} + 100000, false) OR EXISTS (SELECT 1 FROM parts p WHERE p.external_message_id = m.external_message_id)""")
def transcript_retention(t):
    calls = X.retained(t.fx_parts.where("part_type = 'tool'"), CUT)
    parts = X.retained(t.fx_parts, CUT - 500000, "external_part_id", calls)
    return X.retained(t.fx_messages, CUT + 100000, "external_message_id", parts).select("external_message_id")


MSG = "SELECT external_message_id AS id, source_created_at FROM fx_messages"
KEPT = 150
RUN = f"""p AS (SELECT external_part_id AS id, external_message_id AS message_id, source_created_at FROM fx_parts), c AS (SELECT 'call-' || external_part_id AS id, external_part_id AS part_id, external_message_id AS message_id, source_created_at FROM fx_parts WHERE part_type = 'tool'),
 m AS ({MSG}), dc AS (SELECT id FROM c WHERE source_created_at < {CUT} ORDER BY source_created_at, id LIMIT {KEPT}), nc AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM dc)),
 dp AS (SELECT id FROM p WHERE source_created_at < {CUT} + 500000 AND id NOT IN (SELECT part_id FROM nc) ORDER BY source_created_at, id LIMIT greatest({KEPT} - (SELECT count(*) FROM dc), 0)), np AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM dp)),
 dm AS (SELECT id FROM m WHERE source_created_at < {CUT} + 900000 AND id NOT IN (SELECT message_id FROM np) AND id NOT IN (SELECT message_id FROM nc) ORDER BY source_created_at, id LIMIT greatest({KEPT} - (SELECT count(*) FROM dc) - (SELECT count(*) FROM dp), 0))"""


def transcript_tables(t):
    parts = t.fx_parts.select(F.col("external_part_id").alias("id"), F.col("external_message_id").alias("message_id"), "source_created_at", "part_type")
    calls = parts.where("part_type = 'tool'").select(F.concat(F.lit("call-"), "id").alias("id"), F.col("id").alias("part_id"), "message_id", "source_created_at")
    return {"tool_calls": calls, "parts": parts, "messages": t.fx_messages.select(F.col("external_message_id").alias("id"), "source_created_at")}


CUTS = {"tool_calls": CUT, "parts": CUT + 500000, "messages": CUT + 900000}


@query("retention_plan", f"""WITH {RUN} SELECT 'tool_calls' AS "table", id FROM dc UNION ALL SELECT 'parts', id FROM dp UNION ALL SELECT 'messages', id FROM dm""")
def retention_plan(t):
    """One limit over all tables, in their order."""
    return X.retention_plan(transcript_tables(t), CUTS, KEPT)


@query("retention_plan_unlimited", f"""WITH {RUN.replace(f"LIMIT {KEPT}", "").replace(f"LIMIT greatest({KEPT} - (SELECT count(*) FROM dc), 0)", "").replace(f"LIMIT greatest({KEPT} - (SELECT count(*) FROM dc) - (SELECT count(*) FROM dp), 0)", "")} SELECT 'tool_calls' AS "table", id FROM dc UNION ALL SELECT 'parts', id FROM dp UNION ALL SELECT 'messages', id FROM dm""")
def retention_plan_unlimited(t):
    return X.retention_plan(transcript_tables(t), CUTS)


@query("retention_dry_run", f"""WITH {RUN}, n AS (SELECT 0 AS k, 'tool_calls' AS "table", count(*) AS n FROM c WHERE source_created_at < {CUT} UNION ALL SELECT 1, 'parts', count(*) FROM p WHERE source_created_at < {CUT} + 500000 AND id NOT IN (SELECT part_id FROM c)
 UNION ALL SELECT 2, 'messages', count(*) FROM m WHERE source_created_at < {CUT} + 900000 AND id NOT IN (SELECT message_id FROM p) AND id NOT IN (SELECT message_id FROM c))
SELECT "table", CAST(least(n, greatest({KEPT} - coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS eligible FROM n""")
def retention_dry_run(t):
    return X.dry_run(transcript_tables(t), CUTS, KEPT)


SECRETS = ("'{\"Api-Key\":' || {k} || ',\"deep\":{\"password\":' || {p} || ',\"note\":\"n' || session_id || '\"},\"list\":[{\"token\":\"kept\"}],\"tokens\":' || session_id || '}'")


@query("redacted_payloads", "SELECT external_part_id, " + SECRETS.replace("{k}", "'\"[REDACTED]\"'").replace("{p}", "'\"[REDACTED]\"'") + " AS data, CASE WHEN session_id % 2 = 0 THEN NULL ELSE 'no secret here' END AS other FROM fx_parts")
def redacted_payloads(t):
    secret = F.expr(SECRETS.replace("{k}", "concat('\"k', session_id, '\"')").replace("{p}", "concat('[', session_id, ']')"))
    rows = t.fx_parts.select("external_part_id", secret.alias("data"), F.when(F.col("session_id") % 2 != 0, "no secret here").alias("other"))
    return rows.select("external_part_id", redaction.truncate_json(redaction.redact_json(F.col("data"))).alias("data"), redaction.redact_json(F.col("other")).alias("other"))


@query("truncated_payloads", """SELECT external_part_id, CASE WHEN length(data) > 40 THEN '{"truncated":true,"prefix":"' || replace(substring(data, 1, 40), '"', '\\"') || '"}' ELSE data END AS data FROM fx_parts""".replace("\\\\", "\\"))
def truncated_payloads(t):
    return t.fx_parts.select("external_part_id", redaction.truncate_json(F.col("data"), 40).alias("data"))


@query("page_cursors", f"SELECT external_message_id, translate(to_base64(encode({MS} || ':' || external_message_id)), '+/', '-_') AS cursor FROM fx_messages")
def page_cursors(t):
    return t.fx_messages.select("external_message_id", C.cursor(F.col("source_created_at"), F.col("external_message_id")).alias("cursor"))


@query("context_titles", """SELECT source_database_id, count(*) AS n, count(title) AS titled, CAST(sum(code_change_count) AS BIGINT) AS changes FROM (SELECT *, row_number() OVER (PARTITION BY source_database_id, external_session_id ORDER BY source_created_at DESC NULLS LAST, title) AS k FROM fx_contexts) WHERE k = 1 GROUP BY 1""")
def context_titles(t):
    rows = X.newest_context(t.fx_contexts, ["source_database_id", "external_session_id"], [F.col("source_created_at").desc_nulls_last(), F.col("title")])
    return rows.groupBy("source_database_id").agg(F.count("*").alias("n"), F.count("title").alias("titled"), F.sum("code_change_count").alias("changes"))


# ---- forge deliveries

FIRST = """f AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY provider, delivery_id ORDER BY event_id) AS k FROM fx_deliveries) WHERE k = 1),
 r AS (SELECT *, regexp_replace(lower(regexp_extract(repository_url, '^https://([^/:]+)', 1)) || '/' || regexp_extract(repository_url, '443/(.*)$', 1), '(\\.git|/)$', '') AS repository,
  CASE resource_kind WHEN 'issue' THEN 'issue' WHEN 'wiki' THEN NULL ELSE 'change_request' END AS resource_type FROM f),
 d AS (SELECT * FROM r WHERE resource_type IS NOT NULL)""".replace("\\\\", "\\")
RES = "provider, repository, resource_type, number"


def delivered(t):
    return G.identified(G.first_deliveries(t.fx_deliveries, ["event_id"]))


@query("delivery_dedup", f"WITH {FIRST} SELECT provider, delivery_id, event_id, state FROM f")
def delivery_dedup(t):
    return G.first_deliveries(t.fx_deliveries, ["event_id"]).select("provider", "delivery_id", "event_id", "state")


@query("forward_merge", f"""WITH {FIRST}, p AS (SELECT {RES}, occurred_at, delivery_id, 'k1' AS k, CAST(k1 AS VARCHAR) AS v FROM d UNION ALL SELECT {RES}, occurred_at, delivery_id, 'k2', CAST(k2 AS VARCHAR) FROM d WHERE k2 IS NOT NULL),
 b AS (SELECT {RES}, k, v FROM (SELECT *, row_number() OVER (PARTITION BY {RES}, k ORDER BY occurred_at DESC, delivery_id) AS n FROM p) WHERE n = 1),
 l AS (SELECT {RES}, occurred_at AS last_occurred_at, delivery_id AS last_delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY {RES} ORDER BY occurred_at DESC, delivery_id) AS n FROM d) WHERE n = 1)
SELECT {RES}, last_occurred_at, last_delivery_id, '{{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}}' AS merged FROM l JOIN b USING ({RES}) GROUP BY ALL""")
def forward_merge(t):
    return G.forward_merge(delivered(t).withColumn("payload", F.to_json(F.struct("k1", "k2"))))


STATED = f"""WITH {FIRST}, p AS (SELECT {RES}, occurred_at, delivery_id, 'k1' AS k, CAST(k1 AS VARCHAR) AS v FROM d UNION ALL SELECT {RES}, occurred_at, delivery_id, 'k2', CAST(k2 AS VARCHAR) FROM d WHERE k2 IS NOT NULL),
 b AS (SELECT {RES}, k, v, occurred_at AS t, delivery_id AS w FROM (SELECT *, row_number() OVER (PARTITION BY {RES}, k ORDER BY occurred_at DESC, delivery_id) AS n FROM p) WHERE n = 1),
 l AS (SELECT {RES}, max(occurred_at) AS last_occurred_at, arg_min(delivery_id, (-epoch_us(occurred_at), delivery_id)) AS last_delivery_id, count(*) AS deliveries FROM d GROUP BY {RES})
SELECT {RES}, last_occurred_at, last_delivery_id, deliveries, '{{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}}' AS merged,
 '{{' || string_agg('"' || k || '":{{"occurred_at":"' || strftime(t, '%Y-%m-%dT%H:%M:%SZ') || '","delivery_id":"' || w || '"}}', ',' ORDER BY k) || '}}' AS key_provenance FROM l JOIN b USING ({RES}) GROUP BY ALL"""


def stated(t):
    return delivered(t).withColumn("payload", F.to_json(F.struct("k1", "k2")))


@query("forward_state", STATED)
def forward_state(t):
    return G.rendered(G.forward_state(stated(t)))


@query("forward_state_delta", STATED)
def forward_state_delta(t):
    """A stored state of two thirds of the deliveries, late ones among the rest, and the merge of the rest into it in two parts."""
    rows = stated(t)
    part = lambda k: G.forward_state(rows.where(F.col("event_id") % 3 == k))
    stored = stage(G.merge_into(part(0), part(2)), "state")
    return G.rendered(G.merge_into(stored, part(1)))


PRODUCED = """WITH f AS (SELECT event_id, provider, 'https://Host.example:443/org/repo-' || (event_id % 50) AS url, CASE event_id % 5 WHEN 0 THEN 'issue' WHEN 1 THEN 'pull_request' WHEN 2 THEN 'merge_request' WHEN 3 THEN 'wiki' END AS kind,
 CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'true' ELSE CAST(event_id % 20 AS VARCHAR) END AS number FROM fx_deliveries)
SELECT event_id, 'host.example/org/repo-' || (event_id % 50) AS repository, CASE WHEN kind = 'issue' THEN 'issue' ELSE 'change_request' END AS resource_type, number FROM f WHERE kind <> 'wiki' AND number <> 'true'"""


@query("delivery_identity", PRODUCED)
def delivery_identity(t):
    """Payloads as producers write them (type, number) and as they are written back (resource_type, resource_number)."""
    url = F.concat(F.lit("https://Host.example:443/org/repo-"), F.col("event_id") % 50)
    kind = F.get(F.array(*[F.lit(x) for x in ("issue", "pull_request", "merge_request", "wiki", None)]), (F.col("event_id") % 5).cast("int"))
    number = F.when(F.col("event_id") % 7 == 1, F.lit("true")).when(F.col("event_id") % 7 != 0, (F.col("event_id") % 20).cast("string"))
    name = lambda a, b: F.struct(F.struct(url.alias("repository_url"), kind.alias(a), number.alias(b)).alias("resource"))
    payload = F.when(F.col("event_id") % 2 == 0, F.to_json(name("type", "number"))).otherwise(F.to_json(name("resource_type", "resource_number")))
    return G.by_payload(t.fx_deliveries.select("event_id", "provider", payload.alias("payload"))).select("event_id", "repository", "resource_type", "number")


@query("reporting_resources", f"WITH {FIRST} SELECT {RES}, max(occurred_at) AS last_occurred_at, count(*) AS deliveries, arg_min(delivery_id, (-epoch_us(occurred_at), delivery_id)) AS last_delivery_id FROM d GROUP BY {RES}")
def reporting_resources(t):
    return G.resources(delivered(t))


@query("resource_delivery_count", f"WITH {FIRST} SELECT event_id, count(*) OVER (PARTITION BY {RES}) AS deliveries FROM d")
def resource_delivery_count(t):
    return G.with_delivery_count(delivered(t)).select("event_id", "deliveries")


@query("resource_count", f"WITH {FIRST} SELECT count(*) AS resources FROM (SELECT DISTINCT {RES} FROM d)")
def resource_count(t):
    return G.resource_count(delivered(t))


@query("reporting_resource_trail", f"""WITH {FIRST}, x AS (SELECT DISTINCT {RES}, occurred_at, state FROM d) SELECT {RES}, '[' || string_agg('"' || state || '"', ',' ORDER BY occurred_at, state) || ']' AS states FROM x GROUP BY {RES}""")
def reporting_resource_trail(t):
    return G.trail(delivered(t))


@query("exact_associations", f"""WITH {FIRST} SELECT {RES}, string_agg(DISTINCT state, ',' ORDER BY state) AS source_fields, arg_min(k2, (k1, k2)) FILTER (WHERE k2 IS NOT NULL) AS session_id FROM d GROUP BY {RES}""")
def exact_associations(t):
    return G.exact_associations(delivered(t), G.RESOURCE, "state", "k2", "k1").withColumnRenamed("k2", "session_id")


@query("observation_keys", """SELECT event_id, sha256('{"entity_type":"' || entity_type || '","event_type":"' || event_type || '","external_id":"' || external_id || '","occurred_at":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') ||
 CASE WHEN epoch_us(occurred_at) % 1000000 = 0 THEN '' ELSE strftime(occurred_at, '.%f') END || '+00:00","provider":"github","repository":"' || repository || '"}') AS observation_key FROM fx_events""")
def observation_keys(t):
    return t.fx_events.select("event_id", C.observation_key(F.lit("github"), F.col("repository"), F.col("entity_type"), F.col("external_id"), F.col("event_type"), F.col("occurred_at")).alias("observation_key"))


@query("dlq_classes", f"SELECT event_id, CASE WHEN event_id % 5 <> 0 AND TIMESTAMP '{NOW}' - occurred_at > INTERVAL 90 DAY THEN 'expired' ELSE 'retain' END AS class FROM fx_events")
def dlq_classes(t):
    text = F.when(F.col("event_id") % 5 == 0, "no time").otherwise(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return t.fx_events.select("event_id", C.dead_letter_class(text, CLOCK, 90).alias("class"))


@query("source_health", f"""SELECT source_database_id, max(reported_at) AS last_seen, count(*) AS records, CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(reported_at)) <= 300000000 THEN 'healthy' ELSE 'stale' END AS health FROM fx_facts GROUP BY 1""")
def source_health(t):
    rows = t.fx_facts.groupBy("source_database_id").agg(F.max("reported_at").alias("last_seen"), F.count("*").alias("records"))
    return rows.withColumn("health", C.health(F.col("last_seen"), CLOCK))


# ---- correlation

CLOSING = r"(?i)\b(?:resolves?|closes?|fixes?)\s+#?\d+(?:\s*(?:,|and|&)?\s*#?\d+)*"


def numbers(text, pattern, group=1):
    return f"list_distinct(list_transform(regexp_extract_all({text}, '{pattern}', {group}), lambda x: CAST(x AS BIGINT)))"


CLOSES = f"list_distinct(flatten(list_transform(regexp_extract_all(description, '{CLOSING}'), lambda y: list_transform(regexp_extract_all(y, '(\\d+)', 1), lambda x: CAST(x AS BIGINT)))))"
CORRELATE = f"""cr AS (SELECT *, {CLOSES} AS closes, {numbers('description', '#(\\d+)')} AS refs FROM fx_entities WHERE entity_type = 'change_request'),
 issue AS (SELECT scope, number, max(entity_id) AS issue_id FROM fx_entities WHERE entity_type = 'issue' GROUP BY 1, 2),
 tm AS (SELECT r.run_id, cr.*, count(*) OVER (PARTITION BY r.scope, r.run_id) AS matches FROM fx_runs r JOIN cr ON cr.scope = r.scope AND cr.title = r.title),
 own AS (SELECT * FROM tm WHERE matches = 1),
 n1 AS (SELECT DISTINCT r.scope, r.run_id, e.entity_id, 1.0 AS c, 'explicit_run_id' AS m, 1 AS k FROM fx_runs r JOIN fx_run_events e ON e.scope = r.scope AND e.payload ->> '$.run_id' = r.run_id),
 nm AS (SELECT scope, run_id, closes, unnest(list_distinct(list_concat(refs, closes))) AS number FROM own),
 n2 AS (SELECT scope, run_id, entity_id, 1.0 AS c, 'issue_reference' AS m, 2 AS k FROM own UNION ALL SELECT nm.scope, run_id, issue_id, CASE WHEN list_contains(closes, nm.number) THEN 1.0 ELSE 0.1 END, 'issue_reference', 2 FROM nm JOIN issue USING (scope, number)),
 br AS (SELECT DISTINCT scope, issue_id FROM (SELECT scope, unnest({numbers('branch', '(\\d+)')}) AS number FROM cr WHERE branch IS NOT NULL) JOIN issue USING (scope, number)),
 co AS (SELECT DISTINCT scope, issue_id FROM (SELECT scope, unnest({numbers('title', '#(\\d+)')}) AS number FROM fx_entities WHERE entity_type = 'commit') JOIN issue USING (scope, number)),
 n3 AS (SELECT r.scope, r.run_id, issue_id, 0.8, 'branch_issue', 3 FROM fx_runs r JOIN br USING (scope)), n4 AS (SELECT r.scope, r.run_id, issue_id, 0.6, 'commit_issue', 4 FROM fx_runs r JOIN co USING (scope)),
 n5 AS (SELECT r.scope, r.run_id, e.entity_id, 0.4, 'temporal', 5 FROM fx_runs r JOIN fx_entities e ON e.scope = r.scope AND e.entity_type <> 'merge_event' AND r.started_at <= e.updated_at AND e.created_at <= r.finished_at),
 al AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3 UNION ALL SELECT * FROM n4 UNION ALL SELECT * FROM n5),
 cor AS (SELECT scope, run_id, entity_id, CAST(c AS DOUBLE) AS confidence, m AS method FROM (SELECT *, row_number() OVER (PARTITION BY scope, run_id, entity_id ORDER BY k, c DESC) AS n FROM al) WHERE n = 1)"""


def correlated(t):
    return N.correlate(t.fx_runs, t.fx_entities, t.fx_run_events)


@query("correlate", f"WITH {CORRELATE} SELECT * FROM cor")
def correlate(t):
    return correlated(t)


for _name, _rule in {"rule_explicit_run_id": "n1", "rule_issue_reference": "n2", "rule_branch_issue": "n3", "rule_commit_issue": "n4", "rule_temporal": "n5"}.items():

    @query(_name, f"WITH {CORRELATE} SELECT x.* FROM (SELECT NULL, NULL, NULL, 0.0, NULL, 0 WHERE false UNION ALL SELECT * FROM {_rule}) x(scope, run_id, entity_id, confidence, method, rule)".replace("x.*", "scope, run_id, entity_id, CAST(confidence AS DOUBLE) AS confidence"))
    def rule(t, rule=getattr(N, _name.removeprefix("rule_"))):
        return rule(t.fx_runs, t.fx_entities, t.fx_run_events).select("scope", "run_id", "entity_id", "confidence")


LINKS = """dir AS (SELECT scope, run_id, entity_id, CASE WHEN confidence >= 0.5 THEN 'resolved' ELSE 'referenced' END AS role, confidence, 'direct' AS source FROM cor),
 sure AS (SELECT own.scope, own.run_id, own.external_id, own.number, own.closes, coalesce(cor.confidence, 1.0) AS confidence FROM own LEFT JOIN cor USING (scope, run_id, entity_id)),
 lin AS (SELECT DISTINCT s.scope, s.run_id, e.entity_id, CASE WHEN s.confidence >= 0.5 THEN 'resolved' ELSE 'referenced' END, s.confidence, 'owning_change_request' FROM sure s JOIN fx_entities e ON e.scope = s.scope AND e.owning_change_request_id = s.external_id
  WHERE NOT EXISTS (SELECT 1 FROM dir WHERE dir.scope = s.scope AND dir.run_id = s.run_id AND dir.entity_id = e.entity_id)),
 bound AS (SELECT * FROM dir UNION ALL SELECT * FROM lin),
 noisy AS (SELECT r.scope, r.run_id, e.entity_id FROM fx_runs r JOIN fx_entities e ON e.scope = r.scope LEFT JOIN sure s ON s.scope = r.scope AND s.run_id = r.run_id
  WHERE e.entity_type = 'change_request' OR e.entity_type = 'commit' AND len(list_filter(list_transform(regexp_extract_all(e.title, '#(\\d+)', 1), lambda x: CAST(x AS BIGINT)), lambda x: NOT list_contains(coalesce(list_append(s.closes, s.number), []), x))) > 0)"""


@query("entity_links", f"WITH {CORRELATE}, {LINKS} SELECT * FROM bound UNION ALL SELECT DISTINCT n.*, 'noise', 0.0, 'direct' FROM noisy n WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.scope = n.scope AND b.run_id = n.run_id AND b.entity_id = n.entity_id)")
def entity_links(t):
    return N.linked(t.fx_runs, t.fx_entities, t.fx_run_events)


@query("noise_counts", f"WITH {CORRELATE}, {LINKS} SELECT n.scope, n.run_id, count(DISTINCT n.entity_id) AS noise FROM noisy n WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.scope = n.scope AND b.run_id = n.run_id AND b.entity_id = n.entity_id) GROUP BY 1, 2")
def noise_counts(t):
    """How much of a scope is noise to each run, from the scope's candidates and the run's exceptions."""
    links = N.linked(t.fx_runs, t.fx_entities, t.fx_run_events, noise=False)
    return N.noise_counts(t.fx_runs, t.fx_entities, links).where("noise > 0")


@query("scope_proposals", f"WITH {CORRELATE} SELECT scope, run_id, issue_id AS entity_id, CAST(0.8 AS DOUBLE) AS confidence, 'branch_issue' AS method FROM n3 UNION ALL SELECT scope, run_id, issue_id, CAST(0.6 AS DOUBLE), 'commit_issue' FROM n4")
def scope_proposals(t):
    """What branches and commits name, stored once for each scope and expanded for all runs."""
    stored = stage(N.scope_proposals(t.fx_entities), "proposals")
    return N.expand_proposals(t.fx_runs, stored).select("scope", "run_id", "entity_id", "confidence", "method")


SESSIONS = f"""ses AS (SELECT r.scope, r.run_id, s.session_id, CASE WHEN s.agent = o.author THEN 'agent_identity' WHEN s.client = r.client THEN 'client_identity' WHEN s.project = o.repository THEN 'project_match'
 WHEN r.started_at <= s.session_finished_at AND s.session_started_at <= r.finished_at THEN 'temporal_overlap' END AS method FROM fx_runs r JOIN fx_run_sessions s ON s.scope = r.scope LEFT JOIN own o ON o.scope = r.scope AND o.run_id = r.run_id)"""


@query("session_links", f"WITH {CORRELATE}, {SESSIONS} SELECT * FROM ses WHERE method IS NOT NULL")
def session_links(t):
    return N.session_links(t.fx_runs, t.projected("fx_entities"), t.fx_run_sessions)


@query("unresolved_runs", f"""WITH {CORRELATE} SELECT scope, run_id, 'ambiguous' AS reason, string_agg(entity_id, ',' ORDER BY entity_id) AS candidates FROM tm WHERE matches > 1 GROUP BY 1, 2
UNION ALL SELECT scope, run_id, 'unmatched', '' FROM fx_runs r WHERE NOT EXISTS (SELECT 1 FROM tm WHERE tm.scope = r.scope AND tm.run_id = r.run_id) AND NOT EXISTS (SELECT 1 FROM cor WHERE cor.scope = r.scope AND cor.run_id = r.run_id)""")
def unresolved_runs(t):
    return N.unresolved(t.fx_runs, t.fx_entities, correlated(t))


@query("run_outcomes", f"""WITH {CORRELATE}, me AS (SELECT scope, number, min(entity_id) AS merge_event_id, arg_min(created_at, entity_id) AS merged_at FROM fx_entities WHERE entity_type = 'merge_event' GROUP BY 1, 2),
 ri AS (SELECT scope, run_id, string_agg(entity_id, ',' ORDER BY entity_id) AS resolved_issues FROM cor WHERE confidence >= 0.5 AND entity_id LIKE 'issue:%' GROUP BY 1, 2)
SELECT o.scope, o.run_id, o.entity_id AS owner_id, CASE WHEN merge_event_id IS NOT NULL OR lower(state) = 'merged' THEN 'merged' WHEN lower(state) = 'closed' THEN 'closed' ELSE 'open' END AS status, coalesce(resolved_issues, '') AS resolved_issues, merge_event_id, merged_at
FROM own o LEFT JOIN me USING (scope, number) LEFT JOIN ri USING (scope, run_id)""")
def run_outcomes(t):
    return N.outcomes(t.fx_runs, t.fx_entities, correlated(t))


@query("dedupe_entities", f"""WITH {CORRELATE} SELECT r.scope, r.run_id, e.entity_id, arg_min_null(e.owning_change_request_id, (CASE WHEN e.owning_change_request_id = o.external_id THEN 0 ELSE 1 END, e.arrival_seq)) AS owning_change_request_id
FROM fx_runs r JOIN fx_entities e ON e.scope = r.scope LEFT JOIN own o ON o.scope = r.scope AND o.run_id = r.run_id GROUP BY 1, 2, 3""")
def dedupe_entities(t):
    return N.dedupe_entities(t.fx_entities, t.fx_runs)


@query("match_buckets", f"WITH {CORRELATE} SELECT count(*) FILTER (WHERE method = 'explicit_run_id') AS explicit, count(*) FILTER (WHERE method <> 'explicit_run_id' AND confidence >= 0.5) AS high, count(*) FILTER (WHERE method <> 'explicit_run_id' AND confidence < 0.5) AS inferred FROM cor")
def match_buckets(t):
    return N.match_buckets(correlated(t))


@query("run_usage_totals", f"""WITH {CORRELATE}, {SESSIONS}, u AS (SELECT session_id, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(estimated_cost_usd) AS c FROM fx_facts GROUP BY 1)
SELECT scope, run_id, CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens, CAST(sum(c) AS DOUBLE) AS estimated_cost_usd, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents
FROM ses LEFT JOIN u USING (session_id) LEFT JOIN (SELECT session_id, agent FROM fx_sessions) USING (session_id) WHERE method IS NOT NULL GROUP BY 1, 2""")
def run_usage_totals(t):
    return money(N.scope_usage(t.fx_runs, t.projected("fx_entities"), t.fx_run_sessions, t.fx_facts, t.fx_sessions))


@query("run_reconstruct", f"""WITH {CORRELATE}, {SESSIONS}, l AS (SELECT * FROM (SELECT *, confidence < max(confidence) OVER (PARTITION BY scope, entity_id) AS superseded FROM cor) WHERE NOT superseded),
 en AS (SELECT scope, entity_id, min({{'r': coalesce(repository, ''), 'o': coalesce(owning_change_request_id, '')}}) AS x FROM fx_entities GROUP BY 1, 2),
 a AS (SELECT scope, run_id, count(*) AS n_links, count(x) AS n_entities, string_agg(entity_id || '|' || CASE WHEN confidence >= 0.5 THEN 'resolved' ELSE 'referenced' END, ',' ORDER BY entity_id) AS entity_links,
  string_agg(run_id || ':' || entity_id || '|' || method, ',' ORDER BY entity_id) AS correlations, string_agg(entity_id || '|' || x.r || '|' || x.o, ',' ORDER BY entity_id) FILTER (WHERE x IS NOT NULL) AS entities FROM l LEFT JOIN en USING (scope, entity_id) GROUP BY 1, 2),
 h AS (SELECT scope, run_id, count(*) AS n_events, string_agg(entity_id || '|' || coalesce(payload, ''), ',' ORDER BY entity_id, coalesce(payload, '')) AS events FROM l JOIN fx_run_events USING (scope, entity_id) GROUP BY 1, 2),
 w AS (SELECT scope, run_id, string_agg(session_id || '|' || method, ',' ORDER BY session_id, method) AS session_links FROM ses WHERE method IS NOT NULL GROUP BY 1, 2),
 me AS (SELECT scope, number, min(entity_id) AS merge_event_id FROM fx_entities WHERE entity_type = 'merge_event' GROUP BY 1, 2),
 ri AS (SELECT scope, run_id, string_agg(entity_id, ',' ORDER BY entity_id) AS resolved_issues FROM cor WHERE confidence >= 0.5 AND entity_id LIKE 'issue:%' GROUP BY 1, 2),
 oc AS (SELECT o.scope, o.run_id, CASE WHEN merge_event_id IS NOT NULL OR lower(state) = 'merged' THEN 'merged' WHEN lower(state) = 'closed' THEN 'closed' ELSE 'open' END || '|' || coalesce(resolved_issues, '') || '|' || coalesce(merge_event_id, '') AS outcome
  FROM own o LEFT JOIN me USING (scope, number) LEFT JOIN ri USING (scope, run_id))
SELECT scope, run_id, title, coalesce(n_links, 0) AS n_links, coalesce(n_entities, 0) AS n_entities, coalesce(n_events, 0) AS n_events, coalesce(entities, '') AS entities, coalesce(entity_links, '') AS entity_links, coalesce(correlations, '') AS correlations,
 coalesce(events, '') AS events, coalesce(session_links, '') AS session_links, outcome FROM fx_runs LEFT JOIN a USING (scope, run_id) LEFT JOIN h USING (scope, run_id) LEFT JOIN w USING (scope, run_id) LEFT JOIN oc USING (scope, run_id)""")
def run_reconstruct(t):
    """Runs with all that hangs on them, shown as text. Owners and links, which several parts read, are written once."""
    own = stage(N.owners(t.fx_runs, t.fx_entities), "owners")
    links = stage(N.superseded_links(N.proposed(t.fx_runs, t.fx_entities, t.fx_run_events, own=own)), "links")
    rows = N.reconstruct(t.fx_runs, links, t.fx_entities, t.fx_run_events, N.session_links(t.fx_runs, t.fx_entities, t.fx_run_sessions, own=own), N.outcomes(t.fx_runs, t.fx_entities, links, own))
    text = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[F.coalesce(x[p].cast("string"), F.lit("")) for p in parts])), ",").alias(c)
    n = lambda c, name: F.size(c).cast("long").alias(name)
    outcome = F.when(F.col("outcome").isNotNull(), F.concat_ws("|", "outcome.status", "outcome.resolved_issues", F.coalesce("outcome.merge_event_id", F.lit(""))))
    return rows.select("scope", "run_id", "title", n("entity_links", "n_links"), n("entities", "n_entities"), n("events", "n_events"), text("entities", "entity_id", "repository", "owning_change_request_id"), text("entity_links", "entity_id", "role"),
                       text("correlations", "correlation_id", "method"), text("events", "entity_id", "payload"), text("session_links", "session_id", "method"), outcome.alias("outcome"))


# ---- closures

LINK_STATES = """s AS (SELECT repository, external_id AS cr_id, occurred_at, list_sort(list_distinct([link_a, link_b])) AS snap, observed_via = 'webhook' AS hook FROM fx_closure WHERE link_a IS NOT NULL),
 g AS (SELECT repository, cr_id, occurred_at, list(DISTINCT snap) AS every, list(DISTINCT snap) FILTER (WHERE hook) AS hooks FROM s GROUP BY 1, 2, 3),
 a AS (SELECT repository, cr_id, occurred_at, CASE WHEN len(every) = 1 THEN every[1] WHEN len(hooks) = 1 THEN hooks[1] ELSE list_reduce(every, lambda x, y: list_intersect(x, y)) END AS active,
  CASE WHEN len(every) = 1 THEN every[1] WHEN len(hooks) = 1 THEN hooks[1] ELSE list_distinct(flatten(every)) END AS named FROM g),
 l AS (SELECT repository, cr_id, arg_max(active, occurred_at) AS active, arg_max(named, occurred_at) AS named FROM a GROUP BY 1, 2),
 kn AS (SELECT DISTINCT repository, cr_id, unnest(named) AS issue_id FROM a),
 ls AS (SELECT kn.*, CASE WHEN list_contains(l.active, issue_id) THEN 'active' WHEN list_contains(l.named, issue_id) THEN 'parked' ELSE 'revoked' END AS state FROM kn JOIN l USING (repository, cr_id))"""
EPISODES = LINK_STATES + """, m AS (SELECT repository, external_id AS cr_id, min(occurred_at) AS merged_at FROM fx_closure WHERE event_type = 'change_request.merged' GROUP BY 1, 2),
 dl AS (SELECT ls.*, m.merged_at FROM ls LEFT JOIN m USING (repository, cr_id) WHERE state <> 'revoked'),
 ev AS (SELECT repository, external_id AS issue_id, event_type, occurred_at, coalesce(sum(CASE WHEN event_type = 'issue.closed' THEN 1 ELSE 0 END) OVER (PARTITION BY repository, external_id ORDER BY occurred_at, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM fx_closure WHERE entity_type = 'issue'),
 iv AS (SELECT repository, issue_id, segment, coalesce(max(occurred_at) FILTER (WHERE event_type = 'issue.reopened'), min(occurred_at) FILTER (WHERE event_type = 'issue.opened')) AS opened_at, max(occurred_at) FILTER (WHERE event_type = 'issue.closed') AS closed_at FROM ev GROUP BY 1, 2, 3),
 act AS (SELECT repository, issue_id, bool_or(merged_at IS NOT NULL) AS merged FROM dl WHERE state = 'active' GROUP BY 1, 2),
 al AS (SELECT iv.* FROM iv LEFT JOIN act USING (repository, issue_id) WHERE closed_at IS NOT NULL OR opened_at IS NOT NULL AND (segment > 0 OR act.merged IS NOT NULL)
  UNION ALL SELECT repository, issue_id, 0, NULL, NULL FROM act WHERE NOT EXISTS (SELECT 1 FROM iv WHERE iv.repository = act.repository AND iv.issue_id = act.issue_id)),
 ct AS (SELECT al.repository, al.issue_id, al.segment, count(*) FILTER (WHERE state = 'active') AS n_active, count(*) FILTER (WHERE state = 'parked') AS n_parked, string_agg(DISTINCT cr_id, ',' ORDER BY cr_id) AS names FROM al JOIN dl ON dl.repository = al.repository AND dl.issue_id = al.issue_id AND dl.merged_at < al.closed_at GROUP BY 1, 2, 3),
 ep AS (SELECT al.*, CASE WHEN closed_at IS NULL THEN CASE WHEN act.merged THEN 'awaiting_closure' ELSE 'pending' END WHEN coalesce(n_parked, 0) > 0 OR n_active > 1 THEN 'ambiguous' WHEN n_active = 1 THEN 'inferred' ELSE 'unmatched' END AS found, names,
  lead(segment) OVER (PARTITION BY al.repository, al.issue_id ORDER BY segment) IS NULL AS latest FROM al LEFT JOIN act USING (repository, issue_id) LEFT JOIN ct USING (repository, issue_id, segment))"""


def closure_facts(t):
    both = F.when(F.col("link_a").isNotNull(), F.array_distinct(F.array("link_a", "link_b")))
    return t.fx_closure.withColumn("links", both)


@query("link_state", f"WITH {LINK_STATES} SELECT * FROM ls")
def link_state(t):
    return E.link_states(closure_facts(t)).drop("issue_repository")


@query("cr_merged_at", "SELECT repository, external_id AS cr_id, min(occurred_at) AS merged_at FROM fx_closure WHERE event_type = 'change_request.merged' GROUP BY 1, 2")
def cr_merged_at(t):
    return E.merged_at(closure_facts(t))


EPISODE_ROWS = "SELECT repository, issue_id, CAST(segment AS BIGINT) AS segment, opened_at, closed_at, CASE WHEN latest THEN found ELSE 'superseded' END AS status, CASE WHEN found = 'inferred' THEN names END AS cr_id FROM ep"


@query("closure_episodes", f"WITH {EPISODES} {EPISODE_ROWS}")
def closure_episodes(t):
    return E.episodes(closure_facts(t)).drop("found", "candidates")


@query("closure_current", f"WITH {EPISODES} SELECT repository, issue_id, found AS status, opened_at, closed_at FROM ep WHERE latest")
def closure_current(t):
    return E.episodes(closure_facts(t)).where("status <> 'superseded'").select("repository", "issue_id", "status", "opened_at", "closed_at")


@query("closure_unresolved", f"WITH {EPISODES} SELECT repository, issue_id, closed_at, found AS reason, CASE WHEN found = 'ambiguous' THEN names ELSE '' END AS candidates FROM ep WHERE found IN ('ambiguous', 'unmatched')")
def closure_unresolved(t):
    return E.unresolved(E.episodes(closure_facts(t)))


@query("closure_reverse", f"WITH {LINK_STATES} SELECT repository, cr_id, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'parked') AS parked, count(*) FILTER (WHERE state = 'revoked') AS revoked FROM ls GROUP BY 1, 2")
def closure_reverse(t):
    n = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return E.link_states(closure_facts(t)).groupBy("repository", "cr_id").agg(n("active"), n("parked"), n("revoked"))


@query("closure_rebuild", f"""WITH {EPISODES}, w AS (SELECT repository, external_id AS issue_id FROM fx_closure WHERE entity_type = 'issue' GROUP BY 1, 2 HAVING min(occurred_at) >= TIMESTAMP '2024-01-02' AND max(occurred_at) <= TIMESTAMP '2024-02-20')
SELECT e.* FROM ({EPISODE_ROWS}) e JOIN w USING (repository, issue_id)""")
def closure_rebuild(t):
    facts = closure_facts(t)
    issues = E.issues_within(facts, datetime(2024, 1, 2), datetime(2024, 2, 20))
    return E.episodes(E.facts_of(facts, issues)).join(issues, E.ISSUE, "left_semi").drop("found", "candidates")


@query("episode_reconcile", f"""WITH {EPISODES}, c AS ({EPISODE_ROWS} WHERE NOT (issue_id LIKE '%9' AND latest)), o AS (SELECT * REPLACE (CASE WHEN issue_id LIKE '%1' THEN 'pending' ELSE status END AS status) FROM c WHERE segment <> 1 UNION ALL SELECT repository, issue_id || 'x', segment, opened_at, closed_at, status, cr_id FROM c WHERE segment = 2),
 oo AS (SELECT repository, issue_id, closed_at, min(status) AS status, min(cr_id) AS cr_id FROM o GROUP BY 1, 2, 3), cc AS (SELECT repository, issue_id, closed_at, min(status) AS status, min(cr_id) AS cr_id FROM c GROUP BY 1, 2, 3)
SELECT coalesce(cc.repository, oo.repository) AS repository, coalesce(cc.issue_id, oo.issue_id) AS issue_id, coalesce(cc.closed_at, oo.closed_at) AS closed_at, CASE WHEN cc.repository IS NULL THEN 'superseded' ELSE cc.status END AS status,
 CASE WHEN cc.repository IS NULL THEN oo.cr_id ELSE cc.cr_id END AS cr_id, CASE WHEN oo.repository IS NULL THEN 'insert' WHEN cc.repository IS NULL THEN 'supersede' WHEN oo.status = cc.status AND oo.cr_id IS NOT DISTINCT FROM cc.cr_id THEN 'keep' ELSE 'update' END AS action
 FROM oo FULL JOIN cc ON oo.repository = cc.repository AND oo.issue_id = cc.issue_id AND oo.closed_at IS NOT DISTINCT FROM cc.closed_at""")
def episode_reconcile(t):
    found = E.episodes(closure_facts(t)).where("not (issue_id like '%9' and status <> 'superseded')")
    one = lambda df: df.groupBy("repository", "issue_id", "closed_at").agg(F.min("status").alias("status"), F.min("cr_id").alias("cr_id"))
    stored = found.where("segment <> 1").withColumn("status", F.when(F.col("issue_id").endswith("1"), "pending").otherwise(F.col("status")))
    stored = stored.unionByName(found.where("segment = 2").withColumn("issue_id", F.concat("issue_id", F.lit("x"))))
    return E.reconcile(one(stored), one(found))
