"""The reconciliation of a window, joins by scope in slices, and noise as an anti-set."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runledger.operators import correlation as N
from runledger.streaming.reconcile import Stores, reconcile

NOW = datetime(2025, 3, 2)
ENTITY = ("scope string, entity_type string, external_id string, entity_id string, number long, title string, description string, branch string, owning_change_request_id string, state string, author string, repository string, "
          "created_at timestamp, updated_at timestamp, arrival_seq long")


def entity(kind, number, title="x", **more):
    at = NOW - timedelta(hours=2)
    row = {"scope": "h/r", "entity_type": kind, "external_id": str(number), "entity_id": f"{kind}:{number}", "number": number, "title": title, "created_at": at, "updated_at": at, "arrival_seq": number} | more
    return tuple(row.get(c.split()[0]) for c in ENTITY.split(", "))


def rows(df):
    return sorted(df.collect(), key=str)


def test_a_window_again_leaves_the_same_rows(spark, tmp_path):
    hour = lambda h: NOW - timedelta(hours=h)
    sessions = spark.createDataFrame([(1, 5, "s1", hour(3), hour(1)), (2, 5, "s2", hour(90), hour(80)), (3, 5, "s3", hour(30), hour(23))], "session_id long, source_database_id long, external_session_id string, first_message_at timestamp, last_message_at timestamp")
    contexts = spark.createDataFrame([(5, "s1", "Add parser"), (5, "s3", None)], "source_database_id long, external_session_id string, title string")
    found = [entity("change_request", 7, "Add parser", description="closes #3", branch="x"), entity("issue", 3), entity("change_request", 8, "Other")]
    events = [("h/r", "change_request:7", "e1", "change_request.merged", hour(2), None), ("h/r", "change_request:7", "e1", "change_request.merged", hour(2), None)]
    asked = []

    def fetch(what, schema):
        def run(since, until):
            asked.append((since, until))
            return spark.createDataFrame(what, schema)
        return run

    stores = Stores.at(spark, str(tmp_path), buckets=2)
    event = "scope string, entity_id string, event_id string, event_type string, occurred_at timestamp, payload string"
    call = lambda **k: reconcile(stores, sessions, contexts, F.lit("h/r"), fetch(found, ENTITY), fetch(events, event), NOW, **k)
    dry = call(dry_run=True).collect()
    assert asked == [(NOW - timedelta(days=1), NOW)] * 2 and stores.runs.read().count() == 0
    assert call().collect() == dry
    first = [rows(x.read()) for x in (stores.runs, stores.links, stores.events)]
    assert len(first[0]) == 2 and len(first[2]) == 1
    sure = {r.entity_id: r.role for r in first[1] if r.run_id == next(x.run_id for x in first[0] if x.title)}
    assert sure["change_request:7"] == "resolved" and sure["issue:3"] == "resolved"
    call()
    assert [rows(x.read()) for x in (stores.runs, stores.links, stores.events)] == first
    found.append(entity("commit", 9, "Work on #3", owning_change_request_id="7"))
    contexts = spark.createDataFrame([(5, "s1", None)], contexts.schema)
    call()
    assert {r.title for r in stores.runs.read().collect()} == {"Add parser", None}  # what was known isn't erased


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_scopes_are_joined_in_slices(spark, size):
    runs = spark.createDataFrame([(f"s{k % 3}", f"r{k}") for k in range(9)] + [("none", "x")], "scope string, run_id string")
    items = spark.createDataFrame([(f"s{k % 2}", f"e{k}") for k in range(20)], "scope string, entity_id string")
    got = N.by_scope(runs, items, "entity_id", slice_rows=size)
    assert rows(got.select("scope", "run_id", "entity_id")) == rows(runs.join(items, "scope").select("scope", "run_id", "entity_id"))


def test_noise_counts_are_those_of_the_rows(spark):
    """Copies of a commit with other titles, commits that name only what the owner closes, bound ones."""
    found = spark.createDataFrame([entity("change_request", 7, "T", description="closes #3, #4", branch="x"), entity("change_request", 8, "U"), entity("issue", 3), entity("issue", 4), entity("issue", 5),
                                   entity("commit", 20, "Work on #3"), entity("commit", 21, "On #3 and #5"), entity("commit", 22, "On #4"), entity("commit", 22, "On #9"), entity("commit", 23, "no number"), entity("commit", 24, "by #7 #4", owning_change_request_id="7")], ENTITY)
    runs = spark.createDataFrame([("h/r", "a", "T", None, None), ("h/r", "b", "nothing", None, None)], "scope string, run_id string, title string, started_at timestamp, finished_at timestamp")
    events = spark.createDataFrame([], "scope string, entity_id string, payload string")
    links = N.entity_links(runs, found, N.correlate(runs, found, events))
    noise = {r.run_id: r.n for r in links.where("role = 'noise'").groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert noise == {r.run_id: r.noise for r in N.noise_counts(runs, found, links.where("role <> 'noise'")).collect()}
    assert {r.entity_id for r in links.where("role = 'noise' and run_id = 'a'").collect()} == {"change_request:8", "commit:21", "commit:22"}
