"""The usage model's tables as projections of the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, stage

#: The clock of every query: ten minutes after the last order.
NOW = "2001-08-01 00:10:00"

FIXTURES: dict[str, str] = {
    "fx_sessions": """
SELECT CAST(o_orderkey AS BIGINT) AS session_id, concat('ses_', CAST(o_orderkey AS VARCHAR(20))) AS external_session_id,
 CAST(o_custkey AS BIGINT) AS client_id, CAST(o_custkey % 10 AS BIGINT) AS source_database_id,
 CAST(o_orderdate AS TIMESTAMP) AS first_message_at, o_orderpriority AS agent,
 CASE WHEN o_orderkey % 5 <> 0 THEN concat('ses_', CAST(o_orderkey - o_orderkey % 5 AS VARCHAR(20))) END AS parent_session_id,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('proj-', CAST(o_custkey % 7 AS VARCHAR(20))) END AS project_id
FROM {orders}""",
    "fx_usage": """
SELECT concat(CAST(l.l_orderkey AS VARCHAR(20)), '-', CAST(l.l_linenumber AS VARCHAR(20))) AS source_record_id,
 CAST(o.o_custkey AS BIGINT) AS client_id, CAST(l.l_orderkey AS BIGINT) AS session_id, p.p_brand AS model_name,
 CAST(l.l_quantity AS BIGINT) * 100 AS input_tokens, CAST(p.p_size AS BIGINT) * 10 AS output_tokens,
 CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE CAST(l.l_quantity AS BIGINT) * 7 END AS cache_read_tokens,
 CASE WHEN l.l_linenumber % 4 = 0 THEN NULL ELSE CAST(l.l_linenumber AS BIGINT) END AS cache_write_tokens,
 CASE WHEN l.l_linenumber % 2 = 0 THEN NULL ELSE CAST(l.l_quantity AS BIGINT) END AS reasoning_tokens,
 CASE WHEN l.l_linenumber = 7 THEN NULL ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(12,2))
      * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,6)) END AS estimated_cost_usd,
 CAST(l.l_shipdate AS TIMESTAMP) AS reported_at, CAST(l.l_shipdate AS TIMESTAMP) + INTERVAL '1' DAY * CAST(l.l_orderkey % 7 AS INTEGER) AS first_ingested_at,
 CASE l.l_returnflag WHEN 'A' THEN 'alpha' WHEN 'R' THEN 'beta' ELSE '' END AS provider, l.l_linestatus AS mode,
 CASE WHEN l.l_suppkey % 13 = 0 THEN NULL ELSE concat('proj-', CAST(l.l_suppkey % 7 AS VARCHAR(20))) END AS project_id,
 CAST(l.l_suppkey % 10 AS BIGINT) AS source_database_id,
 CAST(row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber ORDER BY l.l_shipdate, l.l_partkey, l.l_suppkey,
      l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus) AS BIGINT) AS arrival_seq
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "fx_facts": """
SELECT u.*, coalesce(u.cache_read_tokens, 0) + coalesce(u.cache_write_tokens, 0) AS cached_tokens FROM {fx_usage} u WHERE u.arrival_seq = 1""",
    "fx_clients": """
SELECT CAST(c_custkey AS BIGINT) AS client_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS canonical_name FROM {customer}""",
    "fx_projects": """
SELECT CAST(c_custkey AS BIGINT) AS client_id, CAST((c_custkey + 5 * k.k) % 10 AS BIGINT) AS source_database_id,
 CASE WHEN c_custkey % 6 = 5 THEN concat('project-long-id-', CAST(c_custkey % 7 AS VARCHAR(20))) ELSE concat('proj-', CAST(c_custkey % 7 AS VARCHAR(20))) END AS external_project_id,
 CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('Team ', CAST(c_nationkey AS VARCHAR(20)), '-', CAST(c_custkey AS VARCHAR(20))) ELSE NULL END AS display_name,
 CASE c_custkey % 4 WHEN 0 THEN concat(c_mktsegment, '-12') WHEN 1 THEN '-7' ELSE NULL END AS name,
 CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '/' ELSE concat('/srv/', c_mktsegment, '/', c_name, '-3') END AS worktree
FROM {customer}, (SELECT 0 AS k UNION ALL SELECT 1) k""",
    "fx_contexts": """
SELECT CAST(o_custkey % 10 AS BIGINT) AS source_database_id, concat('ses_', CAST(o_orderkey AS VARCHAR(20))) AS external_session_id,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('Fixes #', CAST(o_orderkey % 200 AS VARCHAR(20)), ' for ', o_orderpriority) END AS title,
 CASE o_orderkey % 3 WHEN 0 THEN concat(chr(123), '"providerID":"p', CAST(o_orderkey % 5 AS VARCHAR(20)), '","id":"m', CAST(o_orderkey % 7 AS VARCHAR(20)), '"', chr(125))
   WHEN 1 THEN concat('model-', CAST(o_orderkey % 7 AS VARCHAR(20))) END AS session_model,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(946684800000 + o_orderkey * 1000 AS BIGINT) END AS source_created_at,
 CAST(o_orderkey % 9 AS BIGINT) AS code_change_count
FROM {orders} WHERE o_orderkey % 8 <> 7""",
    "fx_todos": """
SELECT CAST(l_orderkey AS BIGINT) AS session_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS position,
 CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_linenumber % 2 = 0 THEN 'blocked' ELSE 'pending' END AS status
FROM {lineitem}""",
    "fx_messages": """
SELECT CAST(conv_id AS BIGINT) AS session_id,
 concat('msg_', CAST(conv_id AS VARCHAR(20)), '_', CAST(turn AS VARCHAR(20))) AS external_message_id, role,
 CASE WHEN turn = 0 THEN NULL ELSE CAST(1700000000000 + conv_id * 60000 + turn * 1000 AS BIGINT) END AS source_created_at,
 CASE WHEN conv_id % 4 <> 0 THEN CAST(conv_id - 1 AS BIGINT) END AS parent_session_id, text
FROM {conversations}""",
    "fx_parts": """
SELECT session_id, external_message_id, concat('prt_', external_message_id) AS external_part_id, source_created_at, parent_session_id,
 CASE WHEN role = 'assistant' THEN 'tool' WHEN role = 'user' THEN 'text' ELSE 'reasoning' END AS part_type,
 CASE WHEN role = 'assistant' AND session_id % 3 = 0 THEN concat(chr(123), '"tool":"bash","state":', chr(123), '"status":"', CASE WHEN session_id % 2 = 0 THEN 'completed' ELSE 'error' END, '","input":', chr(123), '"n":', CAST(length(text) AS VARCHAR(20)), repeat(chr(125), 3))
  WHEN role = 'assistant' AND session_id % 3 = 1 THEN concat(chr(123), '"tool":"read","status":"running","output":"', CAST(length(text) AS VARCHAR(20)), '"', chr(125))
  WHEN role = 'assistant' THEN concat(chr(123), '"state":1', chr(125)) ELSE concat(chr(123), '"text":"x"', chr(125)) END AS data
FROM {fx_messages}""",
    "fx_events": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS occurred_at, CAST(user_id AS VARCHAR(20)) AS external_id,
 concat('host/repo-', CAST(user_id % 5 AS VARCHAR(20))) AS repository,
 CASE event_type WHEN 'signup' THEN 'issue.opened' WHEN 'error' THEN 'issue.closed' WHEN 'view' THEN 'issue.reopened'
   WHEN 'click' THEN 'change_request.opened' ELSE 'change_request.merged' END AS event_type,
 CASE WHEN event_type IN ('click','purchase') THEN 'change_request' ELSE 'issue' END AS entity_type, props
FROM {events}""",
    "fx_deliveries": """
SELECT concat('d', CAST(event_id % 9000 AS VARCHAR(20))) AS delivery_id, CASE WHEN user_id % 2 = 0 THEN 'github' ELSE 'gitlab' END AS provider,
 CAST(ts AS TIMESTAMP) AS occurred_at, event_id, event_type AS state,
 concat('https://Host.example:443/org/repo-', CAST(user_id % 50 AS VARCHAR(20)), CASE WHEN user_id % 3 = 0 THEN '.git' ELSE '/' END) AS repository_url,
 CASE user_id % 4 WHEN 0 THEN 'issue' WHEN 1 THEN 'pull_request' WHEN 2 THEN 'merge_request' ELSE 'wiki' END AS resource_kind,
 CAST(user_id % 20 AS BIGINT) AS number, CAST(event_id % 13 AS BIGINT) AS k1, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 17 AS BIGINT) END AS k2
FROM {events}""",
    "fx_identities": """
SELECT CAST(k AS BIGINT) AS identity_id, CAST(k % 4 AS BIGINT) AS owner_id, CASE WHEN k IN (7, 8) THEN CAST(k - 4 AS BIGINT) END AS canonical_parent_id
FROM (SELECT DISTINCT o_custkey % 10 AS k FROM {orders}) t""",
    "fx_raw": """
SELECT source_record_id, arrival_seq, client_id, source_database_id,
 CASE WHEN session_id % 50 = 0 THEN 'n/a' WHEN session_id % 51 = 0 THEN '-5' ELSE CAST(input_tokens AS VARCHAR(20)) END AS input_tokens,
 CAST(output_tokens AS VARCHAR(20)) AS output_tokens, CASE WHEN session_id % 53 = 0 THEN '' ELSE '0' END AS cached_tokens,
 CASE WHEN session_id % 49 = 0 THEN -1 ELSE reasoning_tokens END AS reasoning_tokens, cache_read_tokens, cache_write_tokens
FROM {fx_usage}""",
    "fx_received": """
SELECT u.*, coalesce(u.cache_read_tokens, 0) + coalesce(u.cache_write_tokens, 0) AS cached_tokens, CAST(u.source_database_id % 4 AS BIGINT) AS identity_id,
 concat(CAST(u.client_id AS VARCHAR(20)), ':', CAST(u.source_database_id AS VARCHAR(20))) AS batch,
 CAST(u.arrival_seq * 1000 + u.session_id % 97 AS BIGINT) AS ingest_order
FROM {fx_usage} u""",
    "fx_ingest": """
SELECT client_id, source_database_id, concat(CAST(client_id AS VARCHAR(20)), ':', CAST(seq AS VARCHAR(20))) AS batch, seq,
 CAST(row_number() OVER (PARTITION BY client_id, seq ORDER BY source_record_id, k, tie) AS BIGINT) AS idx, source_record_id, session_id,
 CASE WHEN session_id % 61 = 0 THEN 'n/a' WHEN session_id % 67 = 0 THEN '-5' ELSE CAST(q + CASE WHEN k = 1 AND session_id % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) END AS input_tokens,
 CAST(q * 2 AS BIGINT) AS output_tokens, CAST(7 AS BIGINT) AS cached_tokens, CASE WHEN k = 0 AND session_id % 2 = 0 THEN NULL ELSE CAST(q AS BIGINT) END AS reasoning_tokens,
 CASE WHEN session_id % 3 = 0 AND k = 0 THEN NULL ELSE CAST(q + 3 AS BIGINT) END AS cache_read_tokens, CASE WHEN session_id % 3 = 0 THEN CASE WHEN k = 1 AND session_id % 2 = 0 THEN CAST(4 AS BIGINT) END ELSE CAST(q % 5 AS BIGINT) END AS cache_write_tokens,
 CASE WHEN session_id % 7 = 0 THEN NULL ELSE CAST(q AS DECIMAL(18,6)) / 4 END AS estimated_cost_usd, CASE WHEN k = 0 AND session_id % 4 = 0 THEN ' ' ELSE 'p' END AS provider, CASE WHEN session_id % 4 = 1 THEN CAST(NULL AS VARCHAR(20)) ELSE 'm' END AS mode, CAST(NULL AS VARCHAR(20)) AS finish_reason
FROM (SELECT CAST(o.o_custkey % 50 AS BIGINT) AS client_id, CAST((l.l_suppkey + CASE WHEN k.k = 2 THEN 1 ELSE 0 END) % 6 AS BIGINT) AS source_database_id, k.k, concat(CAST(l.l_orderkey AS VARCHAR(20)), '-', CAST(l.l_linenumber AS VARCHAR(20))) AS source_record_id,
  CAST(((year(l.l_shipdate) - 1992) * 12 + month(l.l_shipdate) + k.k) * 10 + (l.l_suppkey + CASE WHEN k.k = 2 THEN 1 ELSE 0 END) % 6 AS BIGINT) AS seq, CAST(l.l_orderkey AS BIGINT) AS session_id, CAST(l.l_quantity AS BIGINT) AS q,
  concat(CAST(l.l_partkey AS VARCHAR(20)), '|', CAST(l.l_suppkey AS VARCHAR(20)), '|', CAST(l.l_quantity AS VARCHAR(20)), '|', CAST(l.l_extendedprice AS VARCHAR(30))) AS tie
 FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k ON k.k = 0 OR (k.k = 1 AND l.l_orderkey % 4 = 0) OR (k.k = 2 AND l.l_orderkey % 97 = 0)) x""",
    "fx_ingest_parents": """
SELECT DISTINCT concat(CAST(c_custkey % 50 AS VARCHAR(20)), '/5') AS identity, concat(CAST(c_custkey % 50 AS VARCHAR(20)), '/4') AS parent FROM {customer} WHERE c_custkey % 50 % 3 = 0""",
    "fx_run_saves": """
SELECT concat('run-', CAST(o_custkey AS VARCHAR(20))) AS run_id, CAST(o_orderkey AS BIGINT) AS arrival_seq, CASE WHEN o_orderkey % 2 = 0 THEN 'github' ELSE 'gitlab' END AS provider,
 CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Change ', CAST(o_orderkey % 17 AS VARCHAR(20))) END AS title,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS started_at, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 DAY END AS finished_at,
 CASE o_orderkey % 6 WHEN 1 THEN 'merged' WHEN 2 THEN 'closed' END AS outcome_status, CAST(o_orderdate AS TIMESTAMP) AS seen_at
FROM {orders}""",
    "fx_session_saves": """
SELECT concat('run-', CAST(o_custkey AS VARCHAR(20))) AS run_id, concat('ses_', CAST(o_orderkey - o_orderkey % 3 AS VARCHAR(20))) AS external_session_id, CAST(o_orderkey AS BIGINT) AS arrival_seq,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS session_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS started_at,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY END AS finished_at, CAST(o_orderdate AS TIMESTAMP) AS seen_at
FROM {orders}""",
    "fx_open_saves": """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'github' ELSE 'gitlab' END AS provider, concat('proj-', CAST(o_custkey % 7 AS VARCHAR(20))) AS repository, CASE WHEN o_orderkey % 3 = 0 THEN 'issue' ELSE 'change_request' END AS entity_type,
 CAST(o_orderkey % 40 AS VARCHAR(20)) AS external_id, concat('run-', CAST(o_custkey AS VARCHAR(20))) AS run_id, 'temporal' AS method, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence, concat('e', CAST(o_orderkey AS VARCHAR(20))) AS evidence,
 CASE o_orderkey % 4 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'unmatched' END AS reason, CASE WHEN o_orderkey % 4 = 0 THEN concat('c', CAST(o_orderkey AS VARCHAR(20))) END AS candidates,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('v', CAST(o_orderkey % 3 AS VARCHAR(20))) END AS resolver_version, CAST(o_orderkey AS BIGINT) AS arrival_seq, CAST(o_orderdate AS TIMESTAMP) AS seen_at
FROM {orders}""",
    "fx_binding_saves": """
SELECT CAST(o_orderkey % 900 AS VARCHAR(20)) AS job_id, CAST(o_orderkey AS BIGINT) AS arrival_seq, CASE WHEN o_custkey % 2 = 0 THEN 'github' ELSE 'gitlab' END AS provider,
 concat('https://Host.example/org/repo-', CAST(o_custkey % 5 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN '.git' ELSE '' END) AS repository_url, 'change_request' AS resource_type, CAST(o_custkey % 40 AS VARCHAR(20)) AS resource_number,
 CASE o_orderkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'cancelled' END AS outcome, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderkey AS BIGINT) AS binding_id
FROM {orders}""",
    "fx_credentials": """
SELECT CAST(c_custkey AS BIGINT) AS credential_id, CAST(c_custkey - c_custkey % 3 + 1 AS BIGINT) AS client_id, CASE WHEN c_custkey % 7 = 0 THEN CAST('2000-01-01 00:00:00' AS TIMESTAMP) END AS revoked_at FROM {customer}""",
    "fx_batches": """
SELECT CAST(o_custkey * 2 AS BIGINT) AS credential_id, CAST(o_orderdate AS TIMESTAMP) AS ingested_at, CAST(o_orderkey % 50 AS BIGINT) AS record_count FROM {orders}""",
    "fx_databases": """
SELECT CAST(c_custkey AS BIGINT) AS source_database_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey * 10 AS BIGINT) END AS last_seen_at, CAST(c_custkey % 90 AS BIGINT) AS record_count, c_custkey % 3 <> 0 AS is_active
FROM {customer} WHERE c_custkey % 2 = 0""",
    "fx_tree": """
SELECT CAST(c_custkey - c_custkey % 32 + floor((c_custkey % 32) / 2) AS BIGINT) AS parent_id, CAST(c_custkey AS BIGINT) AS child_id FROM {customer} WHERE c_custkey % 32 > 1
UNION SELECT CAST(c_custkey AS BIGINT), CAST(c_custkey - c_custkey % 32 + (c_custkey % 32 * 3 + 1) % 32 AS BIGINT) FROM {customer}""",
    "fx_directories": """
SELECT CAST(o_custkey AS BIGINT) AS client_id, CAST(o_orderkey AS BIGINT) AS batch,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat(' /srv/', o_orderpriority, ' ') ELSE concat('/srv/', CAST(o_orderkey % 9 AS VARCHAR(20))) END AS directory
FROM {orders}""",
    "fx_links": """
SELECT concat('run-', CAST(o_custkey AS VARCHAR(20))) AS run_id, concat(CASE o_orderkey % 5 WHEN 0 THEN 'issue' WHEN 1 THEN 'change_request' WHEN 2 THEN 'commit' WHEN 3 THEN 'review' ELSE 'merge_event' END, ':', CAST(o_orderkey % 500 AS VARCHAR(20))) AS entity_id, CAST(o_orderkey AS BIGINT) AS arrival_seq,
 CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence, concat('e', CAST(o_orderkey AS VARCHAR(20))) AS evidence, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS method,
 CASE WHEN o_orderkey % 2 = 0 THEN 'resolved' ELSE 'referenced' END AS role, 'direct' AS source
FROM {orders}""",
    "fx_rollup": """
SELECT CASE WHEN client_id % 10 = 3 THEN client_id + 1000000 ELSE client_id END AS client_id, project_id, CAST(reported_at AS DATE) AS day,
 CAST(sum(input_tokens) + CASE WHEN client_id % 10 = 1 THEN 1 ELSE 0 END AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 CAST(sum(coalesce(estimated_cost_usd, 0)) AS DECIMAL(28,6)) AS estimated_cost_usd, count(*) AS message_count
FROM {fx_facts} WHERE project_id IS NOT NULL GROUP BY client_id, project_id, CAST(reported_at AS DATE)""",
    "fx_closure": """
SELECT concat('host/repo-', CAST(user_id % 5 AS VARCHAR(20))) AS repository, entity_type,
 CAST(CASE WHEN entity_type = 'issue' THEN user_id % 200 ELSE user_id % 300 END AS VARCHAR(20)) AS external_id, event_type, date_trunc('day', occurred_at) AS occurred_at,
 CASE WHEN event_id % 3 = 0 THEN 'webhook' ELSE 'backfill' END AS observed_via,
 CASE WHEN entity_type = 'change_request' AND event_id % 4 <> 0 THEN CAST(user_id % 200 AS VARCHAR(20)) END AS link_a,
 CASE WHEN entity_type = 'change_request' AND event_id % 4 <> 0 THEN CAST((user_id + 5 * (event_id % 7)) % 200 AS VARCHAR(20)) END AS link_b
FROM (SELECT e.*, CAST(e.external_id AS BIGINT) AS user_id FROM {fx_events} e) f""",
    "fx_runs": """
SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS scope, concat('run-', CAST(o_orderkey AS VARCHAR(20))) AS run_id, concat('Change ', CAST(o_orderkey % 17 AS VARCHAR(20))) AS title,
 CAST(o_orderdate AS TIMESTAMP) AS started_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 DAY AS finished_at, concat('k', CAST(o_orderkey % 9 AS VARCHAR(20))) AS client
FROM {orders}""",
    "fx_entities": """
SELECT DISTINCT concat('c', CAST(o.o_custkey AS VARCHAR(20))) AS scope, t.entity_type, concat(CAST(l.l_orderkey AS VARCHAR(20)), '-', CAST(l.l_linenumber AS VARCHAR(20))) AS external_id,
 concat(t.entity_type, ':', CAST(l.l_orderkey AS VARCHAR(20)), '-', CAST(l.l_linenumber AS VARCHAR(20))) AS entity_id, CAST(o.o_orderkey % 30 AS BIGINT) AS number,
 CASE t.entity_type WHEN 'change_request' THEN concat('Change ', CAST(o.o_orderkey % 17 AS VARCHAR(20))) WHEN 'commit' THEN concat('Work on #', CAST(o.o_orderkey % 30 AS VARCHAR(20)), ' and #', CAST(o.o_orderkey * 7 % 30 AS VARCHAR(20))) ELSE 'x' END AS title,
 CASE WHEN t.entity_type = 'change_request' THEN concat('Resolves #', CAST(o.o_orderkey * 3 % 30 AS VARCHAR(20)), ', ', CAST(o.o_orderkey % 30 AS VARCHAR(20)), ' see #', CAST((o.o_orderkey + 1) % 30 AS VARCHAR(20)), ', fix #', CAST(o.o_orderkey * 7 % 30 AS VARCHAR(20))) END AS description,
 CASE WHEN t.entity_type = 'change_request' AND o.o_orderkey % 2 = 0 THEN concat('feature/', CAST(o.o_orderkey % 30 AS VARCHAR(20)), '-x') END AS branch,
 CASE WHEN t.entity_type IN ('commit', 'review') THEN concat(CAST(l.l_orderkey AS VARCHAR(20)), '-2') END AS owning_change_request_id,
 CASE o.o_orderkey % 3 WHEN 0 THEN 'Merged' WHEN 1 THEN 'closed' ELSE 'open' END AS state, o.o_orderpriority AS author, concat('proj-', CAST(o.o_custkey % 7 AS VARCHAR(20))) AS repository,
 CAST(o.o_orderdate AS TIMESTAMP) AS created_at, CAST(o.o_orderdate AS TIMESTAMP) + INTERVAL 5 DAY AS updated_at, CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS arrival_seq
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
 JOIN (SELECT 0 AS k, 'merge_event' AS entity_type UNION ALL SELECT 1, 'issue' UNION ALL SELECT 2, 'change_request' UNION ALL SELECT 3, 'commit' UNION ALL SELECT 4, 'review') t ON t.k = l.l_linenumber % 5""",
    "fx_run_events": """
SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS scope, concat('issue:', CAST(o_orderkey AS VARCHAR(20)), '-1') AS entity_id,
 CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(123), '"run_id":"run-', CAST(o_orderkey AS VARCHAR(20)), '"', chr(125)) ELSE concat(chr(123), '"x":1', chr(125)) END AS payload
FROM {orders}""",
    "fx_run_sessions": """
SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS scope, CAST(o_orderkey AS BIGINT) AS session_id, o_orderpriority AS agent, concat('k', CAST(o_orderkey % 5 AS VARCHAR(20))) AS client,
 concat('proj-', CAST(o_orderkey % 7 AS VARCHAR(20))) AS project, CAST(o_orderdate AS TIMESTAMP) AS session_started_at,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY END AS session_finished_at
FROM {orders}""",
}

#: Projections that are written once for a session and folder, as the store they stand for would hold them: queries read these many times over.
STORED = ("fx_ingest", "fx_entities")
#: The order of joins for Spark: what comes last leaves the rows dealt by order, as the numbering and joins by session need them.
FROM_USAGE = "{lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey"
BY_ORDER = "{lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {orders} o ON o.o_orderkey = l.l_orderkey"
#: Entities for Spark: the few columns that make one are distinct where they meet by order, as are then the entities, whose wide rows needn't be shuffled.
ENTITY_ROWS = "SELECT DISTINCT concat('c'", "FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey\n JOIN (SELECT 0 AS k, 'merge_event'"
DISTINCT_ROWS = "SELECT concat('c'", """FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_linenumber FROM {lineitem})) l
 JOIN (SELECT DISTINCT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM (SELECT /*+ REPARTITION(o_orderkey) */ o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM {orders})) o ON o.o_orderkey = l.l_orderkey
 JOIN (SELECT 0 AS k, 'merge_event'"""
_stored: dict[tuple[str, str, str], DataFrame] = {}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def needs(name: str) -> list[str]:
    return [t for t in [*FIXTURES, *BASE] if "{" + t + "}" in FIXTURES[name]]


def load(spark: SparkSession, sf_dir: str, name: str, stored: bool = True) -> DataFrame:
    """A driver table or a projection of them. stored: False where a query reads a part of it once, which isn't worth writing all of it."""
    ship(spark)
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = spark.sparkContext.applicationId, sf_dir, name
    if key in _stored:
        return _stored[key]
    text = FIXTURES[name].replace(FROM_USAGE, BY_ORDER)
    if name == "fx_entities":
        for one, other in zip(ENTITY_ROWS, DISTINCT_ROWS, strict=True):
            text = text.replace(one, other)
    rows = spark.sql(text, **{t: load(spark, sf_dir, t) for t in needs(name)})
    if name in STORED and stored:
        rows = _stored[key] = stage(rows, name)
    return rows


def with_fixtures(sql: str) -> str:
    """The SQL with the projections it names put before it as WITH clauses."""
    found: list[str] = []

    def add(text: str) -> None:
        for name in FIXTURES:
            if name not in found and re.search(rf"\b{name}\b", text):
                add(FIXTURES[name])
                found.append(name)

    add(sql)
    parts = []
    for name in found:
        text = FIXTURES[name]
        for t in needs(name):
            text = text.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({text})")
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if parts and body.upper().startswith(head):
            return head + ", ".join(parts) + ", " + body[len(head) :]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
