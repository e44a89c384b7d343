import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runledger.functions import columns as C
from runledger.functions import redaction as R
from runledger.operators import usage as U

NOW = datetime(2025, 7, 1, 12)


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize("age, count, parent, state", [
    (timedelta(minutes=15) - timedelta(microseconds=1), 1, None, "running"), (timedelta(minutes=15), 1, None, "completed"), (timedelta(minutes=15), 1, "p", "blocked"),
    (timedelta(hours=2), 1, None, "stale"), (timedelta(hours=48), 1, None, "unknown"), (timedelta(0), 0, None, "unknown"), (None, 3, None, "unknown")])
def test_run_status(spark, age, count, parent, state):
    at = None if age is None else NOW - age
    c = C.run_status(F.col("t"), F.col("n"), F.col("p"), NOW)
    assert values(spark, [(at, count, parent)], "t timestamp, n int, p string", c) == [state]


@pytest.mark.parametrize("display, name, tree, pid, label", [
    ("Team-12", "x", None, "p", "Team"), ("-3", "core-1", None, "p", "core"), (None, "", "/srv/app-2", "p", "app"), (None, None, "/", "proj-9", "proj"),
    (None, None, "", "0123456789abc", "0123456789ab…"), (None, None, None, None, "unknown"), (None, None, None, "-5", "unknown")])
def test_project_label(spark, display, name, tree, pid, label):
    c = C.project_label(*map(F.col, "abcd"))
    assert values(spark, [(display, name, tree, pid)], "a string, b string, c string, d string", c) == [label]


@pytest.mark.parametrize("url, repo", [
    ("https://Host.Example:443/Org/Repo.git", "host.example/Org/Repo"), ("http://h:80/a/", "h/a"), ("http://h:8080/a", "h:8080/a"), ("https://h/", None), ("ftp://h/a", None), (None, None), ("nonsense", None)])
def test_repository(spark, url, repo):
    assert values(spark, [(url,)], "u string", C.repository(F.col("u"))) == [repo]


def test_model_display(spark):
    rows = [('{"providerID":"a","id":"b"}',), ('{"id":"b"}',), ("plain",), ("[1]",), (None,)]
    assert values(spark, rows, "m string", C.model_display(F.col("m"))) == ["a / b", "b", "plain", "[1]", None]


def test_cursor_round_trip(spark):
    df = spark.createDataFrame([(5, "a:b"), (None, "é?>")], "ms long, id string").withColumn("c", C.cursor(F.col("ms"), F.col("id")))
    ms, row = C.read_cursor(F.col("c"))
    assert [tuple(r) for r in df.select(ms, row).collect()] == [(5, "a:b"), (C.NO_TIME_MS, "é?>")]


def test_redaction(spark):
    rows = [('{"a":{"api_key":"x","n":[{"password":"y"}]},"tokens":3}',), ("not json password",), (None,), ("[1]",)]
    assert values(spark, rows, "j string", R.redact_json(F.col("j"))) == ['{"a":{"api_key":"[REDACTED]","n":[{"password":"y"}]},"tokens":3}', "not json password", None, "[1]"]
    assert values(spark, [("x" * 20,), ("y",)], "j string", R.truncate_json(F.col("j"), 5)) == ['{"truncated":true,"prefix":"xxxxx"}', "y"]


def test_ratio_vendor_text(spark):
    assert [float(x) for x in values(spark, [(1, 2)], "r long, i long", C.cache_hit_ratio(F.col("r"), F.col("i")))] == [0.3333]
    assert values(spark, [(0, 0)], "r long, i long", C.cache_hit_ratio(F.col("r"), F.col("i"))) == [None]
    assert values(spark, [("GPT-4",), ("Sonnet",), ("?",)], "m string", C.vendor(F.col("m"))) == ["OpenAI", "Anthropic", "Other"]
    assert values(spark, [(" ",), (" a",), (None,)], "t string", C.blank_to_null(F.col("t"))) == [None, " a", None]


def test_bad_arguments(spark):
    df = spark.createDataFrame([(NOW,)], "reported_at timestamp")
    with pytest.raises(ValueError):
        U.window(df, NOW, NOW - timedelta(days=1))
    with pytest.raises(ValueError):
        U.page(df, [F.col("reported_at")], limit=0)
    with pytest.raises(ValueError):
        U.dimensions(df, ["nonsense"])


def test_window_includes_both_ends(spark):
    df = spark.createDataFrame([(NOW,), (NOW + timedelta(seconds=1),), (NOW + timedelta(seconds=2),)], "reported_at timestamp")
    assert U.window(df, NOW, NOW + timedelta(seconds=1)).count() == 2


def test_ids_links_and_canonical_json(spark):
    """Run ids against plain Python, the explorer's link, and the canonical body of a run."""
    import hashlib
    from urllib.parse import unquote

    alphabet = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

    def base32(n, size):
        return "".join(alphabet[n >> 5 * k & 31] for k in reversed(range(size)))

    rows = [(1_700_000_000_123, "a"), (0, ""), (1_735_689_600_000, "session-9é")]
    got = spark.createDataFrame(rows, "ms long, seed string").select(C.ulid(F.col("ms"), F.col("seed")).alias("id")).collect()
    assert [r.id for r in got] == [base32(ms, 10) + base32(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:10], "big"), 16) for ms, seed in rows]
    one = spark.createDataFrame([("x y", 3, datetime(2025, 1, 2, 3, 4, 5), datetime(2025, 1, 2, 3, 4, 5, 60))], "a string, b int, t timestamp, u timestamp")
    link, body = one.select(C.explorer_url("https://h/logs", a=F.col("a"), b=F.col("b")), C.canonical_json("a", "b", "t", "u")).first()
    assert link.startswith("https://h/logs?q=") and json.loads(unquote(link.split("=")[1].replace("+", " "))) == {"a": "x y", "b": 3}
    assert body == '{"data":{"a":"x y","b":3,"t":"2025-01-02T03:04:05Z","u":"2025-01-02T03:04:05.000060Z"},"schema_version":1}'


def test_tool_fields_are_bounded_as_serialised(spark):
    """Blanks behind separators and ASCII escapes count; what isn't JSON is taken as text."""
    cases = ['{"a":1}', json.dumps({"k": "é" * 700}, ensure_ascii=False), json.dumps({"k": "é" * 600}, ensure_ascii=False), "x" * 5000, None, json.dumps(["a" * 4090])]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "c string").select(R.bounded_json(F.col("c"))).collect()]
    assert got[0] == cases[0] and got[2] == cases[2] and got[4] is None and got[5] == cases[5]
    assert json.loads(got[1]) == json.dumps(json.loads(cases[1]))[:4096] and json.loads(got[3]) == json.dumps(cases[3])[:4096]
