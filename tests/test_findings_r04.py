"""What the findings of round 4 named."""

from datetime import datetime

from runledger.operators import correlation as N
from runledger.plans import registry

from .conftest import DATA

RUNS = "scope string, run_id string, title string, started_at timestamp, finished_at timestamp, client string"
ENTITIES = """scope string, entity_type string, entity_id string, external_id string, number bigint, title string, description string, branch string, owning_change_request_id string,
 state string, author string, repository string, created_at timestamp, updated_at timestamp, arrival_seq bigint"""
EVENTS = "scope string, entity_id string, payload string"


def day(n):
    return datetime(1996, 1, 1 + n)


def store(spark):
    """Scope s: run a with an owner that closes 1; run b without owner, named by an event. Scope t: nothing but a run."""
    def row(kind, external, number=None, title=None, description=None, branch=None, owning=None, scope="s", at=20):
        return (scope, kind, f"{kind}:{external}", external, number, title, description, branch, owning, "open", None, "r", day(at), day(at), 1)

    entities = [row("issue", "i1", 1), row("issue", "i2", 2), row("change_request", "c1", 5, "T", "closes #1"), row("change_request", "c2", 6, "other", branch="b/2"),
                row("commit", "known", title="on #1 and #5"), row("commit", "new", title="on #1 and #9"), row("commit", "new", title="on #1"), row("commit", "kin", title="on #9", owning="c1"),
                row("review", "r1", owning="c1"), row("review", "r2", owning="c2"), row("issue", "near", 30, at=2)]
    runs = spark.createDataFrame([("s", "a", "T", day(1), day(3), None), ("s", "b", None, None, None, None), ("t", "c", None, None, None, None)], RUNS)
    events = spark.createDataFrame([("s", "review:r2", '{"run_id":"b"}'), ("s", "issue:i2", "{}"), ("s", "issue:i2", None)], EVENTS)
    return runs, spark.createDataFrame(entities, ENTITIES), events


def before_pairs(df):
    """The plan's text from its top to where pairs of runs and entities are made."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in text
    return text[: text.index("Generate inline")]


def test_links_are_not_shuffled(spark):
    """from where the pairs are made to the result there is no shuffle, and none of them is staged."""
    assert "Exchange" not in before_pairs(registry.QUERIES["entity_links"](spark, DATA))


def test_links_where_pairs_are_made(spark):
    """roles, lineage and noise, of copies too, with correlations of one's own as with those of the rules."""
    runs, entities, events = store(spark)
    mine = {("a", "change_request:c1", "resolved", 1.0, "direct"), ("a", "issue:i1", "resolved", 1.0, "direct"), ("a", "issue:i2", "resolved", 0.8, "direct"), ("a", "issue:near", "referenced", 0.4, "direct"),
            ("a", "commit:kin", "resolved", 1.0, "owning_change_request"), ("a", "review:r1", "resolved", 1.0, "owning_change_request"), ("a", "change_request:c2", "noise", 0.0, "direct"), ("a", "commit:new", "noise", 0.0, "direct")}
    other = {("b", "review:r2", "resolved", 1.0, "direct"), ("b", "issue:i2", "resolved", 0.8, "direct"), ("b", "issue:i1", "resolved", 0.6, "direct"), ("b", "change_request:c1", "noise", 0.0, "direct"), ("b", "change_request:c2", "noise", 0.0, "direct"),
             ("b", "commit:known", "noise", 0.0, "direct"), ("b", "commit:new", "noise", 0.0, "direct"), ("b", "commit:kin", "noise", 0.0, "direct")}
    for links in (N.linked(runs, entities, events), N.entity_links(runs, entities, N.correlate(runs, entities, events))):
        got = [tuple(r)[1:] for r in links.collect()]
        assert len(got) == len(set(got)) and set(got) == mine | other
    assert {tuple(r)[1:] for r in N.linked(runs, entities, events, noise=False).collect()} == {x for x in mine | other if x[2] != "noise"}
    weak = spark.createDataFrame([("s", "a", "change_request:c1", 0.4, "temporal")], "scope string, run_id string, entity_id string, confidence double, method string")
    assert {(r.role, r.confidence) for r in N.entity_links(runs, entities, weak).where("source = 'owning_change_request'").collect()} == {("referenced", 0.4)}


def test_backfill_reads_the_facts_once(spark):
    """the window's runs and what is found for them are written once; what follows reads no facts."""
    text = registry.QUERIES["backfill_links"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "/lineitem.parquet" not in text and "Generate" not in text


def test_times_far_from_all_runs(spark):
    """entities that no run can meet are left out before the join; those that only touch the first or last run's end aren't, nor are times that end before they start. Without runs nothing meets."""
    runs = spark.createDataFrame([("s", "a", None, day(3), day(5), None), ("s", "long", None, day(9), day(7), None)], RUNS)
    at = {"touches start": (1, 3), "touches end": (5, 6), "before": (0, 2), "after": (21, 22), "around": (0, 20), "back": (6, 4), "years": (-3000, 4), "inside the gap": (8, 8)}
    base = store(spark)[1].where("entity_type = 'issue'").limit(1).collect()[0].asDict()
    from datetime import timedelta

    rows = [base | {"entity_id": k, "created_at": day(0) + timedelta(a), "updated_at": day(0) + timedelta(b)} for k, (a, b) in at.items()]
    entities = spark.createDataFrame([tuple(r[f] for f in base) for r in rows], ENTITIES)
    expected = {(r.run_id, x) for r in runs.collect() for x, (a, b) in at.items() if r.started_at <= day(0) + timedelta(b) and day(0) + timedelta(a) <= r.finished_at}
    got = [(r.run_id, r.entity_id) for r in N.temporal(runs, entities, None).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(got) == 5
    assert N.temporal(runs.where("false"), entities, None).count() == 0


def test_reconstruct_reads_all_back(spark):
    """every run, with its entities, links, correlations, events, sessions and outcome; a link that another run has with more confidence doesn't count."""
    runs, entities, events = store(spark)
    sessions = spark.createDataFrame([("s", 7, None, None, None, day(2), day(2)), ("s", 8, None, None, None, None, None)],
                                     "scope string, session_id bigint, agent string, client string, project string, session_started_at timestamp, session_finished_at timestamp")
    links = N.superseded_links(N.proposed(runs, entities, events))
    got = {r.run_id: r for r in N.reconstruct(runs, links, entities, events, N.session_links(runs, entities, sessions), N.outcomes(runs, entities, links)).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert [(x.entity_id, x.role) for x in a.entity_links] == [("change_request:c1", "resolved"), ("issue:i1", "resolved"), ("issue:i2", "resolved"), ("issue:near", "referenced")]
    assert [x.entity_id for x in b.entity_links] == ["issue:i2", "review:r2"]  # not issue:i1, which a has with more confidence
    assert [(x.entity_id, x.owning_change_request_id) for x in b.entities] == [("issue:i2", None), ("review:r2", "c2")]
    assert [(x.correlation_id, x.method) for x in b.correlations] == [("b:issue:i2", "branch_issue"), ("b:review:r2", "explicit_run_id")]
    assert [(x.entity_id, x.payload) for x in a.events] == [("issue:i2", None), ("issue:i2", "{}")] and [x.entity_id for x in b.events] == ["issue:i2", "issue:i2", "review:r2"]
    assert [(x.session_id, x.method) for x in a.session_links] == [(7, "temporal_overlap")]
    assert (a.outcome.status, a.outcome.resolved_issues, b.outcome) == ("open", "issue:i1,issue:i2", None)
    assert (c.entities, c.entity_links, c.correlations, c.events, c.session_links, c.outcome) == ([], [], [], [], [], None)
