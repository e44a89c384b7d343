"""Queries of the ingest path: a history in two calls, the second against what the first one stored, held against one pass in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as G
from ..session import stage
from .registry import query
from .usage import money

#: Months from which on deliveries come in the second call.
LATER = 400
_SAME = "input_tokens = f.a AND output_tokens = f.b AND cached_tokens = f.c AND CASE WHEN estimated_cost_usd IS NULL OR f.d IS NULL THEN estimated_cost_usd IS NULL AND f.d IS NULL ELSE abs(estimated_cost_usd - f.d) < 0.0001 END"
_DELTA = ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "estimated_cost_usd")
_FILL = ("provider", "mode", "finish_reason", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")
_BEFORE = "OVER (PARTITION BY client_id, source_database_id, source_record_id ORDER BY seq, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

PATH = f"""RECURSIVE i AS (SELECT d.*, coalesce(p.parent, concat(d.client_id, '/', d.source_database_id)) AS identity FROM fx_ingest d LEFT JOIN fx_ingest_parents p ON p.identity = concat(d.client_id, '/', d.source_database_id)),
 n AS (SELECT * REPLACE (TRY_CAST(input_tokens AS BIGINT) AS input_tokens, CASE WHEN cache_read_tokens IS NOT NULL AND cache_write_tokens IS NOT NULL THEN cache_read_tokens + cache_write_tokens ELSE cached_tokens END AS cached_tokens,
   nullif(trim(provider), '') AS provider), CASE WHEN TRY_CAST(input_tokens AS BIGINT) IS NULL THEN 'Non-numeric token value: invalid literal for int() with base 10: ''' || input_tokens || '''' WHEN TRY_CAST(input_tokens AS BIGINT) < 0 THEN 'Negative token value' END AS bad FROM i),
 g AS (SELECT * FROM n WHERE bad IS NULL),
 q AS (SELECT client_id, seq, identity, row_number() OVER (PARTITION BY client_id ORDER BY seq) AS k FROM (SELECT DISTINCT client_id, seq, identity FROM g)),
 u AS (SELECT DISTINCT client_id, source_record_id, seq, identity FROM g),
 e AS (SELECT b.client_id, b.seq, list(DISTINCT a.seq) AS earlier FROM u a JOIN u b ON a.client_id = b.client_id AND a.source_record_id = b.source_record_id AND a.identity <> b.identity AND a.seq < b.seq
   WHERE a.identity NOT IN (SELECT identity FROM fx_ingest_parents) GROUP BY ALL),
 z AS (SELECT client_id, CAST(0 AS BIGINT) AS k, list(DISTINCT identity) FILTER (WHERE identity LIKE '%9/3') AS held, CAST([] AS BIGINT[]) AS good, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason FROM q GROUP BY 1
  UNION ALL SELECT client_id, k, CASE WHEN hit AND NOT old THEN list_append(coalesce(held, []), identity) ELSE held END, CASE WHEN hit OR old THEN good ELSE list_append(good, seq) END, seq,
   CASE WHEN old THEN 'Record quarantined — source identity has active quarantine' WHEN hit THEN 'Record quarantined — source identity overlap detected' END
  FROM (SELECT z.client_id, q.k, z.held, z.good, q.seq, q.identity, coalesce(list_contains(z.held, q.identity), false) AS old, len(list_intersect(z.good, coalesce(e.earlier, []))) > 0 AS hit
   FROM z JOIN q ON q.client_id = z.client_id AND q.k = z.k + 1 LEFT JOIN e ON e.client_id = q.client_id AND e.seq = q.seq)),
 s AS (SELECT g.*, z.reason AS stop FROM g JOIN z ON z.client_id = g.client_id AND z.seq = g.seq),
 f AS (SELECT *, first_value(struct_pack(a := input_tokens, b := output_tokens, c := cached_tokens, d := estimated_cost_usd)) OVER w AS f, row_number() OVER w = 1 AS won
   FROM s WHERE stop IS NULL WINDOW w AS (PARTITION BY client_id, source_database_id, source_record_id ORDER BY seq, idx)),
 m AS (SELECT * EXCLUDE (f), won OR ({_SAME}) AS same FROM f),
 l AS (SELECT client_id, source_database_id, source_record_id, seq, idx, session_id, cache_read_tokens, cache_write_tokens, {', '.join(f"NOT won AND {c} IS NOT NULL AND count({c}) {_BEFORE} = 0 AS fill_{c}" for c in _FILL)},
   first_value(session_id) OVER (PARTITION BY client_id, source_database_id, source_record_id ORDER BY seq, idx) AS first_session FROM m WHERE same),
 v AS (SELECT identity, source_record_id, seq, idx, row_number() OVER w = 1 AS first_one, {', '.join(f"{c}, coalesce(last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o_{c}" for c in _DELTA)}, client_id
   FROM m WHERE won WINDOW w AS (PARTITION BY identity, source_record_id ORDER BY seq, idx)),
 o AS (SELECT client_id, seq, idx, CASE WHEN first_one THEN 'accepted' WHEN {' OR '.join(f'coalesce({c} <> o_{c}, false)' for c in _DELTA)} THEN 'updated' ELSE 'duplicate' END AS outcome FROM v),
 r AS (SELECT batch, idx, 'rejected' AS status, bad AS reason FROM n WHERE bad IS NOT NULL UNION ALL SELECT batch, idx, 'quarantined', stop FROM s WHERE stop IS NOT NULL
  UNION ALL SELECT m.batch, m.idx, coalesce(o.outcome, CASE WHEN same THEN 'accepted' ELSE 'conflict' END),
   CASE WHEN won THEN NULL WHEN NOT same THEN 'Divergent duplicate: same dedup key but different values' WHEN {' OR '.join(f'coalesce(fill_{c}, false)' for c in _FILL)} THEN 'Duplicate (idempotent) — enrichment applied' ELSE 'Duplicate (idempotent)' END
  FROM m LEFT JOIN o USING (client_id, seq, idx) LEFT JOIN l USING (client_id, source_database_id, source_record_id, seq, idx))"""


def calls(t, keep=False):
    """Both calls' results. The state between them is stored, as a feed stores it. keep: several results of the second call are wanted."""
    rows = t.fx_ingest
    parents = t.fx_ingest_parents
    own = rows.select(F.concat_ws("/", "client_id", "source_database_id").alias("identity")).distinct()
    state = G.State(held=own.where("identity like '%9/3'"), parents=parents)
    first = G.ingest(rows.where(F.col("seq") < LATER), state)
    after = G.advance(state, first)
    after.records, after.events, after.held = stage(after.records, "records"), stage(after.events, "events"), stage(after.held, "held")
    return first, G.ingest(rows.where(F.col("seq") >= LATER), after, keep)


@query("ingest_path", f"WITH {PATH} SELECT batch, idx, status, reason FROM r")
def ingest_path(t):
    a, b = calls(t)
    return a.outcomes.unionByName(b.outcomes)


@query("ingest_path_ledger", f"WITH {PATH} SELECT batch, count(*) AS records, count(*) FILTER (WHERE status IN ('accepted', 'duplicate', 'updated')) AS accepted, count(*) FILTER (WHERE status NOT IN ('accepted', 'duplicate', 'updated')) AS rejected FROM r GROUP BY 1")
def ingest_path_ledger(t):
    a, b = calls(t)
    return G.ledger(a.outcomes.unionByName(b.outcomes))


@query("replay_fill_session_totals", f"""WITH {PATH}, x AS (SELECT session_id, coalesce(cache_read_tokens, 0) AS a, coalesce(cache_write_tokens, 0) AS b, 0 AS ca, 0 AS cb, input_tokens AS n, estimated_cost_usd AS cost FROM m WHERE won
  UNION ALL SELECT first_session, 0, 0, CASE WHEN fill_cache_read_tokens THEN greatest(cache_read_tokens, 0) ELSE 0 END, CASE WHEN fill_cache_write_tokens THEN greatest(cache_write_tokens, 0) ELSE 0 END, 0, NULL FROM l)
SELECT session_id, CAST(sum(n) AS BIGINT) AS input_tokens, CAST(sum(a + ca) AS BIGINT) AS cache_read_tokens, CAST(sum(b + cb) AS BIGINT) AS cache_write_tokens, CAST(sum(ca + cb) AS BIGINT) AS credited, CAST(sum(cost) AS DOUBLE) AS estimated_cost_usd FROM x GROUP BY 1""")
def replay_fill_session_totals(t):
    """Session totals over both calls: what the records hold at last, of which later deliveries filled some."""
    a, b = calls(t, keep=True)
    caches, none = ("cache_read_tokens", "cache_write_tokens"), F.lit(None)
    held = a.records.unionByName(b.records).select("session_id", "input_tokens", "estimated_cost_usd", *caches, none.cast("long").alias("credited"))
    late = b.fills.select("session_id", none.cast("long").alias("input_tokens"), none.cast(held.schema["estimated_cost_usd"].dataType).alias("estimated_cost_usd"), *caches, none.cast("long").alias("credited"))
    paid = a.credits.unionByName(b.credits).select("session_id", F.expr(" + ".join(caches)).alias("credited"))
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in (*caches, "credited")]
    return money(held.unionByName(late).unionByName(paid, allowMissingColumns=True).groupBy("session_id").agg(F.sum("input_tokens").alias("input_tokens"), *sums, F.sum("estimated_cost_usd").alias("estimated_cost_usd")))
