"""Stored tables: batches that come again, crashes between steps, look-ups that read what may hold their keys, versions."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.operators import closure
from runledger.sources import tables
from runledger.sources.tables import KeyedTable, Snapshot
from runledger.streaming import feeds

ROW = "k long, at long, v string"


def rows_of(df):
    return sorted(df.collect(), key=str)


def test_filters_know_their_keys():
    rng = np.random.default_rng(0)
    own, others = rng.integers(-(1 << 63), 1 << 63, 20_000), rng.integers(-(1 << 63), 1 << 63, 200_000)
    made = tables.bloom(own)
    assert tables.may_have(made, own).all() and tables.may_have(made, others).mean() < 1e-3
    assert not tables.may_have(tables.bloom(own[:0]), others).any()


def test_batch_that_comes_again_tells_the_same(spark, tmp_path):
    """A driver lost after the append: the ledger is that of the first time, and nothing is stored twice."""
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, ["k"])
    one = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (1, 7, "a"), (2, 1, "x"), (None, 1, "n"), (None, 2, "n")], ROW)
    two = spark.createDataFrame([(1, 0, "a"), (1, 0, "z"), (3, 1, "c")], ROW)
    first = [rows_of(feeds.merge_batch(b, table, ["at"], n, ["v"])[0]) for b, n in ((one, "q-0"), (two, "q-1"))]
    again = [rows_of(feeds.merge_batch(b, table, ["at"], n, ["v"])[0]) for b, n in ((two, "q-1"), (one, "q-0"))]
    assert first == again[::-1]
    assert [(r.k, r.status) for r in first[0]] == [(1, "accepted"), (1, "conflict"), (1, "duplicate"), (2, "accepted"), (None, "accepted"), (None, "duplicate")]
    assert [(r.k, r.status) for r in first[1]] == [(1, "conflict"), (1, "duplicate"), (3, "accepted")]
    stored = rows_of(table.read().select("k", "at", "v"))
    table.compact()
    assert rows_of(table.read().select("k", "at", "v")) == stored == [tuple(r) for r in [(1, 5, "a"), (2, 1, "x"), (3, 1, "c"), (None, 1, "n")]]
    assert rows_of(feeds.merge_batch(one, table, ["at"], "q-0", ["v"])[0]) == first[0]
    table.vacuum()
    assert rows_of(table.read().select("k", "at", "v")) == stored and len(table.folder.names("sets")) == 1


def test_append_that_breaks_off_leaves_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, ["k"])
    df = spark.createDataFrame([(1, 5, "a")], ROW)
    df.withColumn("batch", F.lit("b")).withColumn("slot", F.lit(0)).write.partitionBy("slot").parquet(str(tmp_path / "t/sets/b/rows"))  # rows, but no index
    assert table.read().count() == 0
    assert [r.status for r in feeds.merge_batch(df, table, ["at"], "b", ["v"])[0].collect()] == ["accepted"]
    assert table.read().count() == 1


def test_rows_that_tie_in_order(spark, tmp_path):
    """One of them is stored and accepted, whichever values they have."""
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, ["k"])
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (1, None, "b"), (2, 3, "c"), (2, 3, "c")], ROW).repartition(3)
    told, fresh = feeds.merge_batch(df, table, ["at"], "b", ["v"])
    assert [(r.k, r.status) for r in rows_of(told)] == [(1, "accepted"), (1, "conflict"), (1, "conflict"), (2, "accepted"), (2, "duplicate")]
    assert rows_of(fresh) == [(1, None, "a"), (2, 3, "c")] and table.read().count() == 2


def test_lookup_reads_what_may_hold_its_keys(spark, tmp_path):
    """100,000 keys: only slots that may hold them are read; keys that were never stored read next to nothing."""
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v long", ["k"], rows_per_slot=50_000)
    for b in range(4):
        table.append(spark.range(b * 1_000_000, b * 1_000_000 + 150_000).select(F.col("id").alias("k"), F.lit(b).cast("long").alias("v")), f"b{b}")
    assert len(table.slots()) == 12
    asked = spark.range(2_000_000, 2_100_000).select(F.col("id").alias("k"))
    assert all("/b2/" in p for p in table.slots(asked)) and len(table.slots(asked)) == 3
    assert table.lookup(asked).count() == 100_000 and table.lookup(asked, but="b2").count() == 0
    assert len(table.slots(spark.range(9_000_000, 9_000_500).select(F.col("id").alias("k")))) <= 2


@pytest.fixture
def snapshot(spark, tmp_path):
    return Snapshot(spark, str(tmp_path / "s"), ROW, ["k"], buckets=8)


def test_two_upserts_equal_one(spark, snapshot, tmp_path):
    rng = random.Random(1)
    rows = [(k, 1, f"a{k}") for k in range(60)] + [(None, 1, "n")]
    later = [(k, 2, f"b{k}") for k in rng.sample(range(80), 30)]
    snapshot.upsert(spark.createDataFrame(rows, ROW))
    snapshot.upsert(spark.createDataFrame(later, ROW))
    other = Snapshot(spark, str(tmp_path / "o"), ROW, ["k"], buckets=3)
    other.upsert(spark.createDataFrame([r for r in rows if r[0] not in {x[0] for x in later}] + later, ROW))
    assert rows_of(snapshot.read()) == rows_of(other.read())
    assert snapshot.newest()[0] == 2


def test_write_touches_its_buckets_only(spark, snapshot):
    snapshot.upsert(spark.createDataFrame([(k, 1, "a") for k in range(200)], ROW))
    before = snapshot.newest()[1]["parts"]
    snapshot.upsert(spark.createDataFrame([(7, 2, "b")], ROW))
    after = snapshot.newest()[1]["parts"]
    assert sum(before[b] != after[b] for b in before) == 1
    snapshot.vacuum()
    assert snapshot.read().count() == 200 and snapshot.read().where("v = 'b'").count() == 1


@pytest.mark.parametrize("breaks", ["before the version", "within the version"])
def test_crash_leaves_the_old_version(spark, snapshot, monkeypatch, breaks):
    snapshot.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], ROW))
    create = tables.Folder.create

    def lost(folder, name, text):
        if breaks == "within the version":
            create(folder, name, text[: len(text) // 2])
        raise OSError("lost")

    monkeypatch.setattr(tables.Folder, "create", lost)
    with pytest.raises(OSError):
        snapshot.upsert(spark.createDataFrame([(1, 2, "b"), (3, 2, "b")], ROW))
    monkeypatch.undo()
    assert rows_of(snapshot.read()) == [(1, 1, "a"), (2, 1, "a")]
    snapshot.upsert(spark.createDataFrame([(1, 2, "b"), (3, 2, "b")], ROW))
    assert rows_of(snapshot.read()) == [(1, 2, "b"), (2, 1, "a"), (3, 2, "b")]


def test_second_writer_of_a_version_fails(spark, snapshot, monkeypatch):
    snapshot.upsert(spark.createDataFrame([(1, 1, "a")], ROW))
    seen = snapshot.newest()
    snapshot.upsert(spark.createDataFrame([(1, 2, "b")], ROW))
    monkeypatch.setattr(snapshot, "newest", lambda: seen)
    with pytest.raises(Exception, match="xist"):
        snapshot.upsert(spark.createDataFrame([(1, 3, "c")], ROW))
    monkeypatch.undo()
    assert rows_of(snapshot.read()) == [(1, 2, "b")]


def test_merge_and_deletion(spark, snapshot):
    snapshot.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, None), (3, 1, "x")], ROW))
    fill = lambda old, new: old.unionByName(new).groupBy("k").agg(F.max("at").alias("at"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("at"))).alias("v"))
    snapshot.upsert(spark.createDataFrame([(1, 2, "b"), (2, 2, "b")], ROW), fill)
    assert rows_of(snapshot.read()) == [(1, 2, "a"), (2, 2, "b"), (3, 1, "x")]
    snapshot.replace(spark.createDataFrame([(3, 0, ""), (1, 0, "")], ROW), spark.createDataFrame([(1, 9, "p"), (1, 9, "q")], ROW))
    assert rows_of(snapshot.read()) == [(1, 9, "p"), (1, 9, "q"), (2, 2, "b")]
    assert json.loads(snapshot.folder.text("versions/000000000003"))["buckets"] == 8


def random_facts(rng, n, issues):
    day = datetime(2025, 1, 1)
    out = []
    for k in range(n):
        at = day + timedelta(hours=rng.randrange(2000))
        if rng.random() < 0.5:
            out.append(("h", f"d{k}", f"h/r{rng.randrange(2)}", "issue", str(rng.randrange(issues)), rng.choice(["issue.opened", "issue.closed", "issue.reopened"]), at, "u", "webhook", None, None, f"o{k}"))
        else:
            links = rng.choice([None, [], [str(rng.randrange(issues))], [str(rng.randrange(issues)), f"h/r1#{rng.randrange(issues)}"]])
            out.append(("h", f"d{k}", f"h/r{rng.randrange(2)}", "change_request", str(rng.randrange(issues)), rng.choice(["change_request.opened", "change_request.merged", "change_request.updated"]),
                        at, "u", "webhook", links, None, f"o{k}"))
    return out


def test_episodes_by_batches_equal_a_rebuild(spark, tmp_path):
    """Facts in any order, in batches, one of them twice and sets compacted in between."""
    rng = random.Random(4)
    facts = random_facts(rng, 60, 6)
    history = feeds.ClosureHistory(spark, str(tmp_path), buckets=4)
    parts = [facts[:20], facts[20:45], facts[45:]]
    for k, part in enumerate(parts):
        history.add(spark.createDataFrame(part, history.FACT), f"b{k}")
        if k == 1:
            history.add(spark.createDataFrame(part, history.FACT), f"b{k}")
            history.compact()
    whole = spark.createDataFrame(facts, history.FACT)
    touched = whole.where("entity_type = 'issue'").select("repository", F.col("external_id").alias("issue_id")).unionByName(
        closure.naming(whole).select(F.col("issue_repository").alias("repository"), "issue_id")).distinct()
    want = closure.episodes(whole).join(touched, closure.ISSUE, "left_semi")
    assert rows_of(history.episodes.read()) == rows_of(want.select(*history.episodes.schema.names))


def test_what_a_batch_reads_does_not_grow(spark, tmp_path):
    """A history of ten times as many other issues: the same slots' rows are read for one issue."""
    read = []
    for size in (40, 400):
        history = feeds.ClosureHistory(spark, str(tmp_path / str(size)))
        for table in history.facts.values():
            table.rows_per_slot = 20
        facts = random_facts(random.Random(size), size, size)
        history.add(spark.createDataFrame([(*f[:2], "h/other", *f[3:]) for f in facts], history.FACT), "old")
        new = spark.createDataFrame([("h", "d", "h/r", "issue", "1", "issue.opened", datetime(2025, 1, 1), "u", "webhook", None, None, "x")], history.FACT)
        history.add(new, "new")
        issue = new.select("repository", "external_id")
        read.append(sum(t.read(t.slots(issue)).count() for t in history.facts.values()))
        assert history.facts_of(new.select("repository", F.col("external_id").alias("issue_id"))).count() == 1
    assert read[1] <= read[0] + 20
