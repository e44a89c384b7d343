"""What the third review found."""

from datetime import datetime

from pyspark.sql import functions as F

from runledger.operators import correlation as N

RUNS = "scope string, run_id string, title string, started_at timestamp, finished_at timestamp, client string"
ENTITIES = "scope string, entity_type string, entity_id string, created_at timestamp, updated_at timestamp"


def day(n):
    return datetime(1996, 1, 1 + n)


def test_times_that_end_before_they_start(spark):
    """Both comparisons hold, so they meet, as in the SQL: [4, 2] within [1, 6], and [3, 5] around [5, 4]."""
    runs = spark.createDataFrame([("s", "back", None, day(4), day(2), None), ("s", "on", None, day(3), day(5), None), ("s", "open", None, day(3), None, None)], RUNS)
    entities = spark.createDataFrame([("s", "issue", "wide", day(1), day(6)), ("s", "issue", "inside", day(5), day(4)), ("s", "issue", "half", day(3), day(6)), ("s", "issue", "far", day(20), day(8))], ENTITIES)
    got = {(r.run_id, r.entity_id) for r in N.temporal(runs, entities, None).collect()}
    assert got == {("back", "wide"), ("on", "wide"), ("on", "inside"), ("on", "half")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_usage_is_read_once(spark):
    """Aggregates pass over the facts once, and the projection of the driver's tables isn't written before it is read."""
    from runledger.operators import usage as U
    from runledger.plans.registry import Tables
    from runledger.sources import fixtures

    from .conftest import DATA

    t = Tables(spark, DATA)
    for df in (U.total(t.fx_facts), U.aggregates(t.fx_facts, ["agent", "month"], sessions=t.fx_sessions), U.records_with_context_grouped(U.records_with_context(t.fx_facts, t.fx_sessions, t.fx_contexts), ["session"])):
        assert plan(df).count("/lineitem.parquet") == 1
    assert not [key for key in fixtures._stored if key[2] in ("fx_usage", "fx_facts")]


def test_measures_of_odd_rows(spark):
    """No rows, nulls in every column, and a group that is null."""
    from runledger.operators import usage as U

    columns = ", ".join(f"{c} bigint" for c in U.TOKENS) + ", estimated_cost_usd decimal(18,6), provider string, session_id bigint, model_name string"
    none = spark.createDataFrame([], columns)
    assert U.total(none).drop("estimated_cost_usd").collect()[0].asDict() == {"group_value": "total", **dict.fromkeys(U.TOKENS, 0), "message_count": 0, "session_count": 0, "model_count": 0, "provider_breakdown": "{}", "cache_hit_ratio": None}
    rows = spark.createDataFrame([(None,) * 10, (*(1,) * 6, None, "", 5, None), (*(2,) * 6, None, "b", 5, "m")], columns)
    got = {r.group_value: r for r in U.aggregates(rows, ["model"]).collect()}
    assert (got[None].message_count, got[None].session_count, got[None].model_count, got[None].provider_breakdown, got[None].input_tokens) == (2, 1, 0, '{"unknown":2}', 1)
    assert (got["m"].message_count, got["m"].model_count, got["m"].provider_breakdown, got["m"].estimated_cost_usd) == (1, 1, '{"b":1}', None)


def test_pairs_of_a_scope_are_grouped_where_they_are(spark):
    """Entities in several slices, proposals for single runs, a run and a scope without any: the same as by the rules one by one; copies of an entity are one."""
    n = 3 * N.HELD // 2
    issues = [("s", "issue", f"issue:{k}", k, None, None, None, None, None, None, None, k) for k in range(n)]
    crs = [("s", "change_request", f"change_request:{k}", k, f"T{k}", f"closes #{k}", f"b/{k}", None, None, None, None, k) for k in range(n)]
    entities = spark.createDataFrame(issues + crs, "scope string, entity_type string, entity_id string, number bigint, title string, description string, branch string, author string, repository string, state string, external_id string, arrival_seq bigint")
    entities = entities.withColumns({"created_at": F.lit(day(1)), "updated_at": F.lit(day(2)), "owning_change_request_id": F.lit(None).cast("string")})
    runs = spark.createDataFrame([("s", "a", "T7", day(1), day(2), None), ("s", "b", None, None, None, None), ("t", "c", None, None, None, None)], RUNS)
    events = spark.createDataFrame([("t", "e:1", '{"run_id":"c"}'), ("s", "issue:3", '{"run_id":"b"}')], "scope string, entity_id string, payload string")
    got = {(r.scope, r.run_id, r.entity_id): (r.confidence, r.method) for r in N.correlate(runs, entities, events).collect()}
    best = {}
    for rule in N.RULES:
        for r in rule(runs, entities, events).orderBy("confidence").collect():
            key = (r.scope, r.run_id, r.entity_id)
            if key not in best or best[key][0] == r.rule:
                best[key] = r.rule, r.confidence, r.method
    assert got == {k: v[1:] for k, v in best.items()} and len(got) == 3 * n + 1
    assert N.dedupe_entities(entities.unionByName(entities), runs).count() == 4 * n
