"""Folds over time: any order of input gives the same rows, and literal cases."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runledger.operators import closure as E
from runledger.operators import correlation as N
from runledger.operators import merge as M
from runledger.operators import reporting as G
from runledger.operators import transcript as X

DAY = [datetime(2025, 1, 1) + timedelta(days=k) for k in range(12)]
FACT = "repository string, entity_type string, external_id string, event_type string, occurred_at timestamp, observed_via string, links array<string>"


def snap(cr, day, via, links):
    return ("r", "change_request", cr, "change_request.updated", DAY[day], via, links)


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


def states(spark, rows):
    return {(r.cr_id, r.issue_id): r.state for r in E.link_states(facts(spark, rows)).collect()}


def test_link_states(spark):
    rows = [snap("1", 1, "webhook", ["a", "b"]), snap("1", 2, "webhook", ["b", "c"]), snap("2", 1, "webhook", ["a"]), snap("2", 1, "backfill", ["b"]),
            snap("3", 1, "webhook", ["a", "b"]), snap("3", 1, "webhook", ["b", "c"]), snap("4", 1, "webhook", ["a"]), snap("4", 2, "webhook", []), snap("5", 1, "backfill", None)]
    want = {("1", "a"): "revoked", ("1", "b"): "active", ("1", "c"): "active", ("2", "a"): "active", ("3", "a"): "parked", ("3", "b"): "active", ("3", "c"): "parked", ("4", "a"): "revoked"}
    assert states(spark, rows) == want
    random.Random(1).shuffle(rows)
    assert states(spark, rows) == want


def event(issue, day, kind):
    return ("r", "issue", issue, f"issue.{kind}", DAY[day], "webhook", None)


def merged(cr, day):
    return ("r", "change_request", cr, "change_request.merged", DAY[day], "webhook", None)


def episodes(spark, rows):
    return [(r.issue_id, r.opened_at, r.closed_at, r.status, r.cr_id) for r in E.episodes(facts(spark, rows)).orderBy("issue_id", "segment").collect()]


def test_episodes(spark):
    rows = [snap("9", 1, "webhook", ["i", "j", "k"]), merged("9", 3),
            event("i", 1, "opened"), event("i", 4, "closed"), event("i", 5, "reopened"),  # attributed, then open again
            event("j", 1, "opened"), event("j", 3, "closed"),  # merged at the close, not before it
            event("l", 1, "opened")]  # nothing declared: no episode
    want = [("i", DAY[1], DAY[4], "superseded", "9"), ("i", DAY[5], None, "awaiting_closure", None), ("j", DAY[1], DAY[3], "unmatched", None), ("k", None, None, "awaiting_closure", None)]
    assert episodes(spark, rows) == want
    rows.reverse()
    assert episodes(spark, rows) == want
    two = [snap("1", 1, "webhook", ["i"]), snap("2", 1, "webhook", ["i"]), merged("1", 2), merged("2", 2), event("i", 5, "closed")]
    assert episodes(spark, two) == [("i", None, DAY[5], "ambiguous", None)]
    assert E.unresolved(E.episodes(facts(spark, two))).first().candidates == "1,2"


def test_affected_issues(spark):
    old = facts(spark, [snap("1", 1, "webhook", ["a", "b"]), event("c", 1, "opened")])
    assert {r.issue_id for r in E.affected(facts(spark, [merged("1", 2)]), old).collect()} == {"a", "b"}
    assert {r.issue_id for r in E.affected(facts(spark, [event("d", 1, "opened")]), old).collect()} == {"d"}


def test_closing_references(spark):
    df = spark.createDataFrame([("Resolves #1, #2 and 3; fix #4, fixes 5; see #6",), (None,), ("closed #7 close #8",)], "t string")
    assert [sorted(r[0]) for r in df.select(N.closing(F.col("t"))).collect()] == [[1, 2, 3, 5], [], [8]]
    assert [sorted(r[0]) for r in df.select(N.references(F.col("t"))).collect()] == [[1, 2, 4, 6], [], [7, 8]]


def test_delta_merge(spark):
    schema = "k int, arrival_seq int, who string, " + ", ".join(f"{c} long" for c in M.DELTA_FIELDS)
    def row(k, n, who, v):
        return (k, n, who, *[v] * len(M.DELTA_FIELDS))
    rows = [row(1, 1, "a", None), row(1, 2, "b", 0), row(2, 1, "a", None), row(2, 2, "b", 5), row(2, 3, "b", 0), row(3, 1, "a", 4), row(3, 2, "b", None)]
    for _ in range(2):
        got = {r.k: (r.who, r.input_tokens, r.attempts) for r in M.delta_merge(spark.createDataFrame(rows, schema), ["k"], ["who"]).collect()}
        assert got == {1: ("a", None, 2), 2: ("a", 0, 3), 3: ("a", 4, 2)}
        rows.reverse()


def test_forward_merge_any_order(spark):
    rows = [("p", "r", "issue", 1, DAY[1], "b", '{"x":"1","y":null}'), ("p", "r", "issue", 1, DAY[2], "c", '{"x":null,"y":"2"}'),
            ("p", "r", "issue", 1, DAY[2], "a", '{"y":"3","z":"0"}'), ("p", "r", "issue", 1, DAY[0], "d", '{"x":"9","w":"5"}')]
    schema = "provider string, repository string, resource_type string, number long, occurred_at timestamp, delivery_id string, payload string"
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        r = G.forward_merge(spark.createDataFrame(rows, schema)).first()
        assert (r.merged, r.last_delivery_id, r.last_occurred_at) == ('{"w":"5","x":"1","y":"3","z":"0"}', "a", DAY[2])


def test_snapshots(spark):
    rows = [(1, 1, "/a"), (1, 2, "  "), (2, 1, "/a"), (2, 2, None), (3, 1, " /b "), (3, 1, "/b"), (3, 1, "")]
    got = M.replace_snapshots(spark.createDataFrame(rows, "c int, batch int, d string"), ["c"], "d").collect()
    assert sorted(map(tuple, got)) == [(1, "/a"), (3, "/b")]


def test_insert_once_compares_nulls(spark):
    rows = [(1, 1, None), (1, 2, None), (1, 3, "x")]
    assert [r.outcome for r in M.insert_once(spark.createDataFrame(rows, "k int, n int, v string"), ["k"], ["v"], "n").orderBy("n").collect()] == ["inserted", "replayed", "conflict"]


def test_descendants_end_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "parent_id int, child_id int")
    got = X.descendants(edges, spark.createDataFrame([(1,)], "session_id int")).collect()
    assert sorted((r.session_id, r.depth) for r in got) == [(1, 0), (2, 1), (3, 1)]


def test_keyset_pages(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("d", 2)], "id string, source_created_at long")
    assert [r.id for r in X.keyset_page(df, "id", (1, "a"), 5).collect()] == ["b", "d", "c"]
