import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runledger.operators import outcomes, rollup, usage
from runledger.sources import forge
from runledger.sources.tables import KeyedTable
from runledger.streaming import feeds


def event(**change):
    e = {"schema_version": "1.0", "event_type": "normalized", "provider": "github", "delivery_id": "d1", "resource": {"type": "issue", "repository_url": "https://h/o/r.git", "number": 7},
         "action": "edited", "ingested_at": "2025-01-01T00:00:00Z", "redacted_payload": {"reference": {"provider": "github", "delivery_id": "d1"}}}
    return json.dumps(e | change)


def stored(spark, path, parse, key):
    like = parse(spark.createDataFrame([], "value string")).drop("value", "reason", "status")
    return KeyedTable(spark, path, like.schema, key).read()


def test_event_rules(spark):
    bad = [event(schema_version="2"), event(event_type="x"), event(resource={"type": "wiki"}), event(action="merged"), event(resource={"type": "issue", "repository_url": "ftp://x/y"}),
           event(delivery_id="other"), "not json"]
    df = spark.createDataFrame([(event(),), *[(b,) for b in bad]], "value string")
    rows = feeds.parsed_events(df).collect()
    assert (rows[0].reason, rows[0].event_type, rows[0].repository, rows[0].external_id) == (None, "issue.updated", "h/o/r", "7")
    starts = ["Unsupported schema version: '2'", "Unsupported event type: 'x'", "Unsupported resource type: 'wiki'", "Unsupported action: 'merged' for resource type 'issue'",
              "Invalid repository identity: 'ftp://x/y'", "Reference mismatch: redacted_payload.reference.delivery_id='d1'", "Malformed event"]
    assert all(r.reason.startswith(s) for r, s in zip(rows[1:], starts, strict=True))


def test_event_feed_is_idempotent(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(2):
        ref = {"reference": {"provider": "github", "delivery_id": f"e{k}"}}
        (source / f"{k}.json").write_text("\n".join([event(), event(), event(action="closed", delivery_id=f"e{k}", redacted_payload=ref), "broken"]))
        feeds.event_feed(feeds.files(spark, str(source), maxFilesPerTrigger="1"), out, str(tmp_path / "dead"), str(tmp_path / "offsets")).awaitTermination()
    assert sorted(r.event_type for r in stored(spark, out, feeds.parsed_events, ["observation_key"]).collect()) == ["issue.closed", "issue.updated"]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2


def test_usage_feed(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rec = {"source_record_id": "a", "client_id": 1, "source_database_id": 1, "input_tokens": "5", "output_tokens": "1", "cached_tokens": "0", "arrival_seq": 1}
    (source / "a.json").write_text("\n".join(map(json.dumps, [rec, rec | {"arrival_seq": 2, "input_tokens": "6"}, rec | {"source_record_id": "b", "input_tokens": "-1"}, {"client_id": 2}])))
    feeds.usage_feed(feeds.files(spark, str(source)), out, str(tmp_path / "dead"), str(tmp_path / "offsets"), str(tmp_path / "ledger"), "usage").awaitTermination()
    (source / "b.json").write_text("\n".join(map(json.dumps, [rec | {"arrival_seq": 9}, rec | {"arrival_seq": 0, "output_tokens": "3"}, rec | {"source_record_id": "c"}])))
    feeds.usage_feed(feeds.files(spark, str(source)), out, str(tmp_path / "dead"), str(tmp_path / "offsets"), str(tmp_path / "ledger"), "usage").awaitTermination()
    told = sorted((r.number, r.source_record_id, r.status, (r.reason or "")[:9]) for r in spark.read.parquet(str(tmp_path / "ledger")).collect())
    assert told == [(0, "a", "accepted", ""), (0, "a", "conflict", "Divergent"), (1, "a", "conflict", "Divergent"), (1, "a", "duplicate", "Duplicate"), (1, "c", "accepted", "")]
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert {r.original_topic for r in dead.collect()} == {"usage"}
    for _ in range(2):
        feeds.sweep(dead, datetime(2100, 1, 1), 30, str(tmp_path / "escalated"))
    assert spark.read.parquet(str(tmp_path / "escalated")).count() == 2
    assert [(r.source_record_id, r.input_tokens) for r in stored(spark, out, feeds.parsed_usage, ["client_id", "source_database_id", "source_record_id"]).orderBy("source_record_id").collect()] == [("a", "5"), ("c", "5")]
    assert {r.reason for r in spark.read.parquet(str(tmp_path / "dead")).collect()} == {"Negative token value", "Malformed record"}


def test_issue_links(spark):
    at = lambda repo, n: {"repository": f"https://h/o/{repo}", "number": n}
    cases = [({}, None, None), ({"issue_links": {"declares_closure": [], "references": []}}, None, None), ({"issue_links": {"declares_closure": [at("r", "1"), at("q", "2"), {"repository": "no", "number": "3"}], "references": [at("r.git", "4")]}}, ["1", "h/o/q#2"], ["4"]),
             ({"issue_links": {"declares_closure": [{"repository": "no", "number": "3"}]}}, [], []), ({"issue_links": {"references": [at("r", "5")]}}, [], ["5"])]
    rows = feeds.parsed_events(spark.createDataFrame([(k, event(**c[0])) for k, c in enumerate(cases)], "k int, value string").select("value")).collect()
    assert [(r.links, r.mentions) for r in rows] == [c[1:] for c in cases]


def test_closure_refresh_keeps_the_newest_version(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    pull = {"type": "pull_request", "repository_url": "https://h/o/r", "number": 9}
    issue = {"type": "issue", "repository_url": "https://h/o/q", "number": 7}
    ref = lambda d: {"delivery_id": d, "redacted_payload": {"reference": {"provider": "github", "delivery_id": d}}}
    days = lambda n: {"occurred_at": f"2025-01-0{n}T00:00:00Z"}
    files = [[event(resource=issue, action="opened", **ref("a"), **days(1)), event(resource=pull, action="opened", issue_links={"declares_closure": [{"repository": "https://h/o/q.git", "number": "7"}]}, **ref("b"), **days(2))],
             [event(resource=pull, action="merged", **ref("c"), **days(3))], [event(resource=issue, action="closed", **ref("d"), **days(4))]]
    seen = []
    for k, rows in enumerate(files):
        (source / f"{k}.json").write_text("\n".join(rows))
        feeds.event_feed(feeds.files(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "offsets"), feeds.closure_refresh(spark, str(tmp_path / "episodes"))).awaitTermination()
        seen.append([(r.repository, r.issue_id, r.status, r.cr_id) for r in feeds.current_episodes(spark, str(tmp_path / "episodes")).collect()])
    assert seen == [[("h/o/q", "7", "pending", None)], [("h/o/q", "7", "awaiting_closure", None)], [("h/o/q", "7", "inferred", "h/o/r#9")]]


def test_batches_deliveries_and_bindings(spark):
    batch = {"schema_version": "1.2", "source_database_id": 5, "replay_id": "x", "records": [{"source_record_id": "a", "estimated_cost_usd": 0.5}], "messages": [{"external_message_id": "m", "role": "user"}, {"external_message_id": "n"}],
             "session_todos": [{"external_session_id": "s", "content": "do", "position": 1}], "parts": [{"external_part_id": "p", "part_type": "tool"}]}
    raw = spark.createDataFrame([(json.dumps(batch),), (json.dumps(batch | {"schema_version": "2.0"}),), ("broken",)], "value string")
    read = feeds.parsed_batch(raw)
    assert {k: v.count() for k, v in read.items()} == {"rejected": 2, "records": 1, "session_contexts": 0, "projects": 0, "project_directories": 0, "session_todos": 1, "messages": 2, "parts": 1}
    assert read["messages"].first().source_database_id == 5 and "Unsupported schema version: '2.0'" in {r.reason for r in read["rejected"].collect()}
    d = {"provider": "github", "delivery_id": "1", "event_type": "issue", "occurred_at": "2025-01-01T02:00:00+02:00", "payload": {"resource": {"repository_url": "https://h/o/r", "resource_type": "issue", "resource_number": "7"}}}
    rows = feeds.parsed_deliveries(spark.createDataFrame([(json.dumps(d | c),) for c in ({}, {"occurred_at": "2025-01-01T02:00:00"}, {"provider": None})], "value string")).collect()
    assert [r.reason for r in rows] == [None, "occurred_at must carry an offset", "Malformed delivery"] and rows[0].occurred_at == datetime(2025, 1, 1) and rows[0].number == "7"
    b = {"awx_job": {"job_id": "12"}, "external_session_id": "s", "resource": {"provider": "gitlab", "repository": "https://h/o/r", "resource_type": "change_request", "resource_number": "3"}, "outcome": "failed"}
    bad = [{"awx_job": {"job_id": "x"}}, {"outcome": "lost"}, {"failure_reason": "x" * 1001}, {"resource": b["resource"] | {"resource_type": "issue"}}]
    rows = feeds.parsed_bindings(spark.createDataFrame([(json.dumps(b | c),) for c in ({}, *bad)], "value string")).collect()
    assert [r.reason for r in rows] == [None, "job_id must be a number", "Unknown outcome", "failure_reason is too long", "resource_type must be change_request"] and rows[0].repository == "h/o/r"


def test_deliveries_of_producers_reach_the_reporting_state(spark, tmp_path):
    """type/number as producers say them; states merge in any order; a batch that comes again counts once."""
    source = tmp_path / "in"
    source.mkdir()
    d = lambda i, at, payload: json.dumps({"provider": "github", "delivery_id": i, "event_type": "x", "occurred_at": f"2025-01-0{at}T00:00:00Z", "payload": payload})
    named = {"resource": {"repository_url": "https://h/o/r.git", "type": "pull_request", "number": 7}}
    batches = [[d("b", 2, named | {"a": "new", "b": None}), d("c", 2, named | {"c": 5})], [d("a", 1, named | {"a": "old", "b": "kept"}), d("z", 3, {"resource": {"repository_url": "https://h/o/r", "type": "wiki", "number": 1}}), d("y", 3, {"resource": {"type": "issue", "number": True, "repository_url": "https://h/o/r"}})]]
    after = feeds.reporting_refresh(spark, str(tmp_path / "state"), 4)
    seen = []
    for k, rows in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(rows))
        run = feeds.run_stream(feeds.files(spark, str(source)), feeds.parsed_deliveries, ["provider", "delivery_id"], ["occurred_at"], str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "offsets"),
                               lambda fresh, name: (after(fresh, name), after(fresh, name), seen.append(fresh.count())), ["event_type", "payload"])
        run.awaitTermination()
    r = feeds.reporting_state(spark, str(tmp_path / "state")).collect()
    assert seen == [2, 3] and len(r) == 1
    assert (r[0].repository, r[0].resource_type, r[0].number, r[0].deliveries, r[0].last_delivery_id) == ("h/o/r", "change_request", "7", 3, "b")
    merged = json.loads(r[0].merged)
    assert {k: merged[k] for k in "abc"} == {"a": "new", "b": "kept", "c": "5"}
    assert {k: v["delivery_id"] for k, v in json.loads(r[0].key_provenance).items()} == {"a": "b", "b": "a", "c": "c", "resource": "b"}


def test_forge_rows(spark, tmp_path):
    dumps = {
        "issues": [{"number": 1, "title": "t", "state": "closed", "user": {"login": "u"}, "created_at": "2025-01-01T00:00:00Z", "closed_at": "2025-01-02T00:00:00Z"}, {"number": 2, "pull_request": {"url": "x"}}],
        "pulls": [{"number": 2, "title": "p", "state": "closed", "user": {"login": "u"}, "head": {"ref": "b"}, "requested_reviewers": [{"login": "v"}], "created_at": "2025-01-01T00:00:00Z",
                   "merged_at": "2025-01-03T00:00:00Z", "closed_at": "2025-01-03T00:00:00Z"}],
        "reviews": [{"pull": 2, "id": 5, "state": "APPROVED", "user": {"login": "v"}, "submitted_at": "2025-01-02T00:00:00Z"}, {"pull": 2, "id": 6, "state": "COMMENTED", "submitted_at": "2025-01-02T00:00:00Z"}],
        "commits": [{"pull": 2, "sha": "s", "commit": {"message": "m", "author": {"name": "n", "date": "2025-01-01T00:00:00Z"}}}],
        "check_runs": [{"pull": 2, "id": 8, "conclusion": "timed_out", "completed_at": "2025-01-02T00:00:00Z"}, {"pull": 2, "id": 9, "conclusion": "neutral", "completed_at": "2025-01-02T00:00:00Z"}],
    }
    read = {}
    for kind, rows in dumps.items():
        (tmp_path / f"{kind}.json").write_text("\n".join(map(json.dumps, rows)))
        read[kind] = forge.read(spark, str(tmp_path / f"{kind}.json"), kind)
    found = forge.entities("h/r", read["issues"], read["pulls"], read["reviews"], read["commits"])
    assert sorted(r.entity_id for r in found.collect()) == ["change_request:2", "commit:s", "issue:1", "merge_event:2", "review:5", "review:6"]
    assert found.where("entity_id = 'commit:s'").first().author == "n"
    kinds = sorted(r.event_type for r in forge.events("h/r", read["issues"], read["pulls"], read["reviews"], read["check_runs"]).collect())
    assert kinds == ["change_request.approved", "change_request.merged", "change_request.opened", "change_request.review_requested", "issue.closed", "issue.opened", "pipeline.failed"]
    assert forge.within(read["issues"], datetime(2025, 1, 2), None).count() == 1


def test_second_forge(spark, tmp_path):
    dumps = {"pipelines": [{"iid": 3, "id": 1, "status": "success", "finished_at": "2025-01-02T00:00:00Z"}, {"iid": 3, "id": 2, "status": "running", "updated_at": "2025-01-02T00:00:00Z"}, {"iid": 3, "id": 4, "status": "failed", "updated_at": "2025-01-01T00:00:00Z"}],
             "approvals": [{"iid": 3, "updated_at": "2025-01-03T00:00:00Z", "approved_by": [{"user": {"id": 9, "username": "u"}}, {"user": {}}]}]}
    read = {}
    for kind, rows in dumps.items():
        (tmp_path / f"{kind}.json").write_text("\n".join(map(json.dumps, rows)))
        read[kind] = forge.read(spark, str(tmp_path / f"{kind}.json"), kind)
    assert [(r.event_id, r.event_type, r.entity_id) for r in forge.pipeline_events("h/r", read["pipelines"], read["approvals"]).collect()] == [
        ("pipeline:4", "pipeline.failed", "change_request:3"), ("pipeline:1", "pipeline.succeeded", "change_request:3"), ("change_request:3:approved:9", "change_request.approved", "change_request:3")]
    assert [(r.author, r.state, r.owning_change_request_id) for r in forge.approval_entities("h/r", read["approvals"]).collect()] == [("u", "approved", "3")]


def test_commits_of_the_second_forge(spark, tmp_path):
    rows = [{"iid": 3, "id": "abc", "title": "t", "author_name": "n", "authored_date": "2025-01-02T01:00:00+01:00", "created_at": "2025-01-05T00:00:00Z"}, {"iid": 4, "id": "def", "created_at": "2025-01-05T00:00:00Z"}, {"iid": 4, "title": "no id"}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    got = forge.merge_request_commits("h/r", forge.read(spark, str(tmp_path / "c.json"), "merge_request_commits")).collect()
    assert [(r.entity_id, r.entity_type, r.provider, r.repository, r.title, r.author, r.created_at, r.owning_change_request_id) for r in got] == [
        ("commit:abc", "commit", "gitlab", "h/r", "t", "n", datetime(2025, 1, 2), "3"), ("commit:def", "commit", "gitlab", "h/r", None, None, datetime(2025, 1, 5), "4")]


def test_rollup_is_read_where_it_can_answer(spark):
    """Two dimensions in any order and no filter by model or session; the plan of the facts has no rollup in it."""
    assert rollup.from_rollup(["project", "client"]) and not rollup.from_rollup(["client", "project"], model="m") and not rollup.from_rollup(["client"]) and not rollup.from_rollup(["client", "project"], session_id=1)


def test_bad_arguments_are_refused(spark):
    rows = spark.createDataFrame([(1, datetime(2025, 1, 1))], "client_id long, reported_at timestamp")
    calls = [lambda: usage.aggregates(rows, ["colour"]), lambda: usage.records(rows, rows, rows, "price"), lambda: usage.page(rows, [], 0), lambda: usage.window(rows, datetime(2025, 2, 1), datetime(2025, 1, 1)),
             lambda: outcomes.runs(rows, rows, status="odd"), lambda: outcomes.correlations(rows.withColumns({"entity_type": F.lit("a"), "external_id": F.lit("b")}), "odd"), lambda: outcomes.bindings_for_resource(rows, resource_type="issue"),
             lambda: outcomes.between(rows, "reported_at", datetime(2025, 2, 1), datetime(2025, 1, 1))]
    for call in calls:
        with pytest.raises(ValueError):
            call()
    assert outcomes.last_window(datetime(2025, 1, 2)) == (datetime(2025, 1, 1), datetime(2025, 1, 2))
    assert usage.preset("last-month", datetime(2025, 3, 5, 7)) == (datetime(2025, 2, 1), datetime(2025, 3, 1)) and usage.preset("custom", datetime(2025, 3, 5), "x", "y")[0] == datetime(2025, 3, 1)


def test_dead_letters_expire(spark):
    dead = spark.createDataFrame([("2025-01-01T00:00:00Z", "x"), ("never", "y"), ("2025-03-01T00:00:00Z", "z")], "dead_lettered_at string, value string")
    assert [r.value for r in feeds.expired(dead, datetime(2025, 3, 5), 30).collect()] == ["x"]
    assert dead.select(F.count("*")).first()[0] == 3
