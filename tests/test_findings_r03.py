"""Tests for the findings of round 3 that were settled after it."""

import re

from pyspark.sql import functions as F

from runledger.operators import ingest as G
from runledger.plans import ingest as plans


def deliveries(spark, rows):
    """(source_record_id, database, seq, idx, cache_read_tokens, session)"""
    out = [(1, db, f"1:{seq}", seq, idx, record, session, "5", 1, 1, None, read, None, None, None, None, None) for record, db, seq, idx, read, session in rows]
    return spark.createDataFrame(out, "client_id long, source_database_id long, batch string, seq long, idx long, source_record_id string, session_id long, input_tokens string, output_tokens long, cached_tokens long, "
                                      "reasoning_tokens long, cache_read_tokens long, cache_write_tokens long, estimated_cost_usd decimal(18,6), provider string, mode string, finish_reason string")


def test_ingest_shuffles_deliveries_once(spark):
    rows = deliveries(spark, [("a", 1, 1, 1, None, 7), ("a", 1, 2, 1, 3, 7)])
    state = G.advance(G.State(), G.ingest(rows, G.State()))
    plan = G.ingest(rows, state, keep=False).outcomes._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) <= 4  # the deliveries', and those of the stored state's own plans


def test_every_delivery_has_an_outcome_and_late_fills_a_session(spark):
    first = deliveries(spark, [("a", 1, 1, 1, None, 7), (None, 1, 1, 2, 4, 8), ("b", 1, 1, 3, 2, 9)])
    one = G.ingest(first, G.State())
    assert {(r.batch, r.idx, r.status) for r in one.outcomes.collect()} == {("1:1", 1, "accepted"), ("1:1", 2, "accepted"), ("1:1", 3, "accepted")}
    two = G.ingest(deliveries(spark, [("a", 1, 2, 1, 3, 7), ("b", 2, 3, 1, 2, 9), ("b", 2, 4, 1, 2, 9)]), G.advance(G.State(), one))
    assert {(r.batch, r.status, r.reason) for r in two.outcomes.collect()} == {("1:2", "accepted", G.FILLS), ("1:3", "quarantined", G.OVERLAP), ("1:4", "quarantined", G.HELD)}
    assert [(r.session_id, r.source_record_id, r.cache_read_tokens) for r in two.fills.collect()] == [(7, "a", 3)]
    assert [(r.session_id, r.cache_read_tokens) for r in two.credits.collect()] == [(7, 3)]


def test_second_call_stages_no_deliveries(spark, monkeypatch):
    """The ledger's second call makes its outcomes from one shuffle, without a copy of all deliveries."""
    from runledger.plans.registry import QUERIES

    from .conftest import DATA

    names = []
    real = G.stage
    monkeypatch.setattr(G, "stage", lambda df, name: names.append(name) or real(df, name))
    QUERIES["ingest_path_ledger"](spark, DATA)
    assert names.count("rated") == 1 and "deliveries" not in names and plans.LATER == 400


def test_usage_of_runs_shuffles_no_pairs(spark):
    """Sums meet the sessions before the runs: the same as over the links, and entities aren't written for it."""
    from runledger.operators import correlation as N
    from runledger.plans.registry import Tables
    from runledger.sources import fixtures

    from .conftest import DATA

    t = Tables(spark, DATA)
    fixtures._stored.clear()
    args = t.fx_runs, t.projected("fx_entities"), t.fx_run_sessions
    assert not fixtures._stored
    facts, sessions = t.fx_facts.cache(), t.fx_sessions.unionByName(t.fx_sessions.where("session_id % 3 = 0").withColumn("agent", F.lit("other")))
    doubled = t.fx_run_sessions.unionByName(t.fx_run_sessions.where("session_id % 5 = 0"))  # a session named twice counts once
    got = N.scope_usage(args[0], args[1], doubled, facts, sessions)
    want = N.run_usage(N.session_links(args[0], args[1], doubled), facts, sessions)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    facts.unpersist()


def test_no_partner_is_dropped_in_crowded_bands(spark, monkeypatch):
    """Bands that most texts share: still all pairs that share one and are near come together, as by brute force."""
    import random

    import numpy as np

    from runledger.llm import fingerprints as fp

    monkeypatch.setattr(fp, "CROWD", 50)
    rnd = random.Random(31)
    texts = []
    for _ in range(120):
        t = "".join(rnd.choice("ab") for _ in range(rnd.choice([100, 104, 110])))
        k = rnd.randrange(len(t))
        texts += [t, t[:k] + "b" + t[k:]] if rnd.random() < 0.5 else [t]
    texts = sorted(set(texts), key=lambda t: rnd.random())
    levels, found = fp.sample(texts)
    like = lambda i, j: fp.likeness(levels[[i]], found[[i]], levels[[j]], found[[j]])[0]
    picks = [np.argsort(fp.mixed(np.arange(fp.SAMPLES, dtype=np.uint64) + np.uint64(k << 20)))[:2] for k in range(2)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            band = levels[i] == levels[j] and any((found[i, 0, p] == found[j, 0, p]).all() for p in picks)
            if band and like(i, j) >= 0.8 and fp.is_within(texts[i], texts[j], int(0.1 * max(len(texts[i]), len(texts[j])))):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    rows = fp.near_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), bands=2, width=2).collect()
    assert [r.near_id for r in sorted(rows, key=lambda r: r.doc_id)] == root
    assert sum(r != k for k, r in enumerate(root)) > 25


def test_texts_cross_the_shuffle_packed(spark):
    """op6's one shuffle of all texts carries them compressed one by one, and they come out as they went in."""
    import pyarrow as pa

    from runledger.llm import fingerprints as fp

    texts = ["", "é𝄞 " * 50, *(f"the same few words again and again {k} " * 40 for k in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    codec, plain, rows = pa.Codec("zstd"), fp.in_id_order(df).collect(), fp.in_id_order(df, pack=True).collect()
    assert sorted((r.part, r.extra, r.doc_id, fp.unpacked(bytes(r.text), codec)) for r in rows) == sorted(map(tuple, plain))
    assert sum(len(r.text) for r in rows) < 0.2 * sum(len(r.text.encode()) for r in plain)
    plan = fp.fingerprint_edits(df)._jdf.queryExecution().executedPlan().toString()
    assert "pack_texts(" in plan


def test_components_of_few_edges_take_one_stage(spark, monkeypatch):
    """A long path needed a dozen rounds of three stages each; what one task can hold is solved at once, or after the rounds."""
    from runledger.llm import graph

    names, real = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: names.append(name) or real(df, name))
    path = [(k, k + 1) for k in range(60)] + [(100 + k, 100) for k in range(9)] + [(200, 200)]
    edges = spark.createDataFrame([((a, -a), (b, -b)) for a, b in path], "a struct<x:long,y:long>, b struct<x:long,y:long>").repartition(5)
    want = {k: 0 for k in range(61)} | {100 + k: 100 for k in range(9)} | {200: 200}
    for chunk, most in ((graph.CHUNK, 1), (20, 99)):
        names.clear()
        monkeypatch.setattr(graph, "CHUNK", chunk)
        rows = graph.connected(edges).collect()
        roots = {r.node.x: r.root.x for r in rows}
        assert len(rows) == len(want) == len(roots) and all(r.root.y == -r.root.x for r in rows) and len(names) <= most
        assert all((roots[a] == roots[b]) == (want[a] == want[b]) for a in want for b in want) and all(roots[r] == r for r in roots.values())
    assert len(names) > 4


def test_alike_ends_are_left_out_of_edit_distances(spark, monkeypatch):
    """A long common end made each pair cost the texts' whole length squared; what is left of it is compared, with the same result."""
    import random

    from runledger.llm import fingerprints as fp

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rnd, sizes, real = random.Random(7), [], fp.edit_distance
    monkeypatch.setattr(fp, "edit_distance", lambda a, b, *more: sizes.append(max(len(a), len(b))) or real(a, b, *more))
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    for _ in range(150):
        head, a, b, tail = word(rnd.randrange(9)), word(rnd.randrange(60)), word(rnd.randrange(60)), word(rnd.randrange(9))
        a, b, most = head + a + tail, head + b + tail, rnd.randrange(45)
        want = plain(a, b)
        assert real(a, b) == want and (real(a, b, most) <= most) == fp.is_within(a, b, most) == (want <= most)
        assert plain(*fp.trimmed(a, b)) == want
    sizes.clear()
    tail = word(3000)
    assert not fp.is_within(word(500) + tail, word(500) + tail, 100) and max(sizes, default=0) <= 500
    assert fp.is_within(word(500) + tail, word(490) + tail, 500) and fp.is_within("", "", 0) and fp.is_within("ab", "b", 1)


def test_pairs_of_a_crowd_are_made_once(spark, monkeypatch):
    """Texts that share a long end, in many bands, but aren't near: pairs are held against all samples where they are made, once; groups are those of brute force."""
    import random

    from runledger.llm import fingerprints as fp

    monkeypatch.setattr(fp, "CROWD", 40)
    rnd, real, counts = random.Random(11), fp.stage, {}

    def counted(df, name):
        out = real(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(fp, "stage", counted)
    tail, texts = "".join(rnd.choice("abcdefgh") for _ in range(180)), []
    for _ in range(110):
        t = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(24, 40))) + tail
        texts += [t, t[:9] + "x" + t[9:]] if rnd.random() < 0.2 else [t]
    levels, found = fp.sample(texts)
    picks = fp.band_places(6, 4)
    root, alike = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            band = levels[i] == levels[j] and any((found[i, 0, p] == found[j, 0, p]).all() for p in picks)
            if band and fp.likeness(levels[[i]], found[[i]], levels[[j]], found[[j]])[0] >= 0.8:
                alike += 1
                if fp.is_within(texts[i], texts[j], int(0.1 * max(len(texts[i]), len(texts[j])))):
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
    rows = fp.near_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), bands=6, width=4).collect()
    assert [r.near_id for r in sorted(rows, key=lambda r: r.doc_id)] == root
    assert sum(r != k for k, r in enumerate(root)) >= 10 and len(counts["pairs"]) == 3 and counts["pairs"][2] > 100
    assert sum(counts["pairs"][1:]) <= alike and sum(counts["tags"]) <= len(texts) * (6 * fp.REPRESENTATIVES + 1) and len(counts["tags"]) == 2
