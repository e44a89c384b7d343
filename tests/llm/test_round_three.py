"""Quality classifier, conversation repair and spelling variants against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from runledger.llm import quality, spelling, turn_repair
from runledger.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import DATA
from ..test_queries import TABLES, rows

BIGGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_spelling_variants"])
def test_rows_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{BIGGER}/{t}.parquet')")
    assert rows(QUERIES[name](spark, BIGGER).toArrow()) == rows(con.execute(ORACLE_SQL[name]).to_arrow_table())


# conversation repair


def plain_damage(turns):
    out = []
    for c, t, r, x in turns:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def plain_faults(turns):
    seen, out = set(), []
    for _, _, r, x in turns:
        v = x.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not v else "duplicate" if (r, x) in seen else "truncated" if v[-1] not in ".!?" else None)
        seen.add((r, x))
    return out


def every_repair(turns, faults):
    """All edit sequences with up to two inserted turns in each gap: (cost, audit, repaired turns)."""

    def ways(k):
        if k == len(turns):
            yield 0, "", ()
            return
        _, _, r, x = turns[k]
        for cost, audit, rest in gaps(k + 1):
            yield cost + 3, "D" + audit, rest
            if faults[k] in (None, "truncated"):
                extra = faults[k] is not None
                yield cost + extra, "K" + audit, ((r, x), *rest)
                for role in ("user", "assistant"):
                    yield cost + extra + 2, "R" + audit, ((role, x), *rest)

    def gaps(k):
        rest = list(ways(k))
        for n in range(3):
            for roles in [()] if n == 0 else [("user",), ("assistant",)] if n == 1 else [("user", "assistant"), ("assistant", "user")]:
                for cost, audit, turns_left in rest:
                    yield cost + 2 * n, "I" * n + audit, (*((role, "") for role in roles), *turns_left)

    return min((w for w in gaps(0) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in w[2]))), key=lambda w: w[:2])


def plain_repair(turns, repair=every_repair):
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults = plain_faults(turns)
    cost, audit, left = repair(turns, faults)
    known = [t for _, t, _, _ in turns if t is not None]
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest())


def random_turns(rng, conversations, longest):
    return [(c or None, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice(["Hello there.", "Ok!", "cut off", "", " \n", None, "What? ", "a|b."])) for c in range(conversations) for t in range(rng.randint(1, longest))]


def test_repair_against_all_edit_sequences(spark):
    """Every conversation, even one that damage leaves without turns, against every sequence of edits."""
    turns = random_turns(random.Random(3), 60, 3)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.digest(turn_repair.repair_conversations(turn_repair.damage(df), there="there")).collect()}
    want = {c: plain_repair(plain_damage([t for t in turns if t[0] == c])) for c in {t[0] for t in turns}}
    assert got == want
    assert any(v[-1] == hashlib.sha256(b"").hexdigest() for v in want.values())


def test_long_conversations_fold_by_blocks(spark):
    """Blocks give what one fold gives: the cost of a plain run over states, and turns that match the pattern."""
    rng = random.Random(5)
    turns = [(1, t, rng.choice(["user", "assistant", "system"]), f"x{t}." if rng.random() < 0.9 else "cut") for t in range(3 * turn_repair.BLOCK + 7)]
    cheapest = {0: 0, 2: 2, 3: 4}
    faults = plain_faults(turns)
    for (_, _, r, _), fault in zip(turns, faults, strict=True):
        new = {k: v + 3 for k, v in cheapest.items()}
        for a, letter, b in [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]:
            for cost in ([0] if r[0] == letter else []) + ([2] if letter != "s" else []):
                if a in cheapest and fault in (None, "truncated"):
                    new[b] = min(new.get(b, 1 << 30), cheapest[a] + cost + (fault is not None))
        for _ in range(2):
            for a, b in [(0, 2), (1, 2), (2, 3), (3, 2)]:
                if a in new:
                    new[b] = min(new.get(b, 1 << 30), new[a] + 2)
        cheapest = new
    r = turn_repair.repair_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    assert r.cost == min(cheapest.get(0, 1 << 30), cheapest[3])
    assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.repaired))
    assert "".join(t.edit for t in r.repaired) == r.audit.replace("D", "")
    assert len(r.audit.replace("I", "")) == len(turns)


def test_repair_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, place long, fault string")
    assert turn_repair.digest(turn_repair.repair_conversations(turn_repair.damage(df), there="there")).collect() == []


def test_repair_keeps_to_expressions(spark):
    plan = QUERIES["op12_conversation_repair"](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# spelling variants


def plain_variants(docs, shortest=7, least=2, every=31, times=10):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = collections.defaultdict(set)
    letters = sorted({c for w in n for c in w})
    for w in n:
        for k in range(len(w) + 1):
            for x in [w[:k] + w[k + 1 :], *[w[:k] + c + w[k:] for c in letters], *[w[:k] + c + w[k + 1 :] for c in letters]]:
                if x in n and x != w:
                    near[w].add(x)
    form = {w: b for w in n if near[w] and n[b := min(near[w], key=lambda x: (-n[x], x))] >= times * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_variants_against_all_edits(spark):
    """Planted misspellings, chains of forms, ties, doubled letters at the middle, accents and words that exceed a part."""
    rng = random.Random(8)
    base = ["accommodate", "necessary", "schöllühe", "Straßeñé", "aaaaaaaa", "abbbcccdd", "ÀÉÎõüûøþ"]
    docs = []
    for w in base:
        docs.append((len(docs), " ".join([w] * 400)))
        for _ in range(12):
            k = rng.randrange(len(w))
            x = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]])
            docs.append((len(docs), "-".join([x] * rng.choice([1, 2, 2, 3, 39, 40, 41]))))
            y = x[:-1] + "z"
            docs.append((len(docs), "1".join([y] * 2)))
    docs += [(None, None), (None, "nothingness nothingness"), (5, ""), (6, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999), (6, "short words")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 word", "2 n").repartition(5)
    got = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    want = plain_variants(docs)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a chain
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_parts_end_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "PART", 10)
    text = "abcdefghijklm nopqrst\n" * 3 + "uvwxyzabcdef"
    assert "".join(spelling.parts(text)) == text
    assert [w for p in spelling.parts(text) for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


# quality classifier


def test_machine_against_all_pairs():
    """The linear-time logit is the sum over all pairs of features."""
    rng = np.random.default_rng(1)
    model = quality.QualityModel(0.3, rng.normal(size=50), rng.normal(size=(50, quality.FACTORS)))
    begins = np.array([0, 4, 5, 11])
    numbers, values = rng.integers(0, 50, 11), rng.normal(size=11)
    got = quality.logits(model, numbers, values, begins)
    for k in range(3):
        x = list(zip(numbers[begins[k] : begins[k + 1]], values[begins[k] : begins[k + 1]], strict=True))
        pairs = sum(model.vectors[i] @ model.vectors[j] * a * b for p, (i, a) in enumerate(x) for j, b in x[p + 1 :])
        assert abs(got[k] - (0.3 + sum(model.weights[i] * a for i, a in x) + pairs)) < 1e-9


def test_machine_learns_pairs():
    """Which of two features go together decides: a linear model can't tell."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    numbers = np.stack([a, 2 + b], 1).ravel()
    model = quality.fit_machine(numbers, np.ones(4000, np.float32), np.arange(0, 4001, 2), (a == b).astype(float), 4, epochs=40)
    z = quality.logits(model, np.array([0, 2, 0, 3, 1, 2, 1, 3]), np.ones(8), np.array([0, 2, 4, 6, 8]))
    assert list(z > 0) == [True, False, False, True]


def test_features_against_plain_counts():
    """Statistics of some texts by plain Python."""
    import pyarrow as pa

    texts = ["Good words here. And more of them!", "", None, "BUY!! NOW!! NOW!!\nBUY!!", "a | b | c", "été ÊTRE 12,5"]
    numbers, values, begins = quality.features(pa.array(texts), [pa.array([34.0, 0, None, 25, 9, 13])])
    width = 2 * (len(quality.STATISTICS) + 1)
    at = {name: k for k, name in enumerate(quality.STATISTICS)}
    for k, text in enumerate(texts):
        text = text or ""
        raw = text.encode()
        own = numbers[begins[k] : begins[k] + width]
        told = lambda name: (own[2 * at[name]] - quality.WORDS) % quality.EACH  # noqa: E731, B023
        share = lambda x: int(quality.share_bin(np.array([x]))[0])
        size = max(1, len(raw))
        assert told("upper") == share(sum(b"A"[0] <= c <= b"Z"[0] for c in raw) / size)
        assert told("digit") == share(sum(chr(c).isdigit() for c in raw if c < 128) / size)
        assert told("shout") == share(text.count("!") / size)
        assert told("bar") == share(text.count("|") / size)
        assert told("wide") == share(sum(ord(c) > 127 for c in text) / size)
        words = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x7f" else c for c in text))
        assert told("words") == int(np.log2(1 + len(words)))
        assert told("different") == share(len(set(words)) / max(1, len(words)))
        assert told("again") == share(sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)))
        tokens = text.split()
        assert told("shouted") == share(sum("A" <= t[-1] <= "Z" for t in tokens) / max(1, len(tokens)))
        counts = collections.Counter(words)
        assert len(numbers[begins[k] + width : begins[k + 1]]) == len(counts)
        assert abs((values[begins[k] + width : begins[k + 1]] ** 2).sum() - bool(counts)) < 1e-5


def test_held_out_quality(spark):
    """On documents it never saw: good ones stay, most bad ones go."""
    scores = QUERIES["op11_quality_classifier"](spark, BIGGER)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIGGER}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.predicted, r.score) for r in scores.where("held_out").collect() if r.doc_id in labels]
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, p, s in got)
    assert sum(p for y, p, _ in got if y) >= 0.97 * sum(y for y, _, _ in got)
    assert sum(1 - p for y, p, _ in got if not y) >= 0.5 * sum(1 - y for y, _, _ in got)


def test_quality_uses_no_held_out_label(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) quality")
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs.withColumn("lang", docs.source), flipped)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights) and np.array_equal(a.vectors, b.vectors)


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " * 5, 60) for k in range(200)], "doc_id long, text string, n_chars int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    whole = quality.fit_quality(docs, labels)
    assert not np.array_equal(quality.fit_quality(docs, labels, sample=50).weights, whole.weights)
    assert quality.fit_quality(docs, labels, entries=0).share is not None


# pages, conversations, fingerprints


LONG_P = "<p>" + "The long paragraph has many words, and they go on. " * 20 + "</p>"


@pytest.mark.parametrize(("html", "kept"), [
    (f"<article><h1>T</h1>{LONG_P}<section><h2>Results</h2><p>It was so.</p><p>Thus.</p></section><section><h2>End</h2><p>Bye.</p></section></article>", "Results It was so. Thus. End Bye."),
    (f"<article>{LONG_P}<table><tr><th>Year</th><th>N</th></tr><tr><td>1999</td><td>13</td></tr></table></article>", "Year N 1999 13"),
    (f"<article>{LONG_P}<ul><li><a href=x>One link</a></li><li><a href=y>Two links</a></li></ul></article>", "One link Two links"),
    ("<main>" + "".join(f"<section><p>Line {k}.</p></section>" for k in range(6)) + "</main>", "Line 0. Line 1. Line 2. Line 3. Line 4. Line 5."),
    (f"<article>{LONG_P}<section class='search-methods'><h2>M</h2><p>We looked.</p></section></article>", "M We looked."),
    (f"<article>{LONG_P}<div class='reply-letter'><p>Dear all.</p></div></article>", "Dear all."),
    (f"<main><article><div class=body>{LONG_P}</div><p>Afterword.</p></article></main>", "Afterword."),
])
def test_nothing_of_an_article_is_lost(html, kept):
    from runledger.llm.page_text import main_text

    page = f"<html><head><title>x</title></head><body><nav><a href=1>Home</a></nav>{html}<footer>Imprint</footer></body></html>"
    got = main_text(page)
    assert got.endswith(kept) and "Home" not in got and "Imprint" not in got
    assert LONG_P[3:-5].strip() in got or "Line 0." in kept


def test_clutter_of_an_article_goes():
    from runledger.llm.page_text import main_text

    clutter = ("<div class='comment-list'><p>First comment!</p></div><div class=share><a href=x>Share</a></div><aside>Aside</aside><div class='cookie-banner'>Cookies</div>"
               "<div class=search>Find</div><div class='newsletter-signup'><p>Sign up</p></div><form>Form</form>")
    assert main_text(f"<body><article><h1>T</h1>{LONG_P}{clutter}<p>Last words.</p></article></body>") == f"T {LONG_P[3:-5].strip()} Last words."


def test_clusters_choose_where_no_tag_does():
    """No article and no main: ratios tell the body from unmarked menus, link lists and imprints."""
    from runledger.llm.page_text import main_text

    links = "".join(f"<li><a href={k}>Topic number {k}</a></li>" for k in range(9))
    body = f"<h1>Title here</h1>{LONG_P}<h2>Part</h2><p>Short.</p>{LONG_P}"
    page = f"<body><div><ul>{links}</ul></div><div><a href=a>Home</a> <a href=b>News</a></div><div>{body}</div><div><ul>{links}</ul></div><div>All rights</div></body>"
    long = LONG_P[3:-5].strip()
    assert main_text(page) == f"Title here {long} Part Short. {long}"


def region_by_brute_force(lines, sigma=1.0):
    """Which lines are in a cluster, by the definition, one line at a time (text, tags, linked)."""
    import math

    own = [max(0, len(t) - linked) / max(1, tags) for t, tags, linked in lines]
    weight = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(4)]
    near = [sum(weight[abs(j - k)] * own[j] for j in range(max(0, k - 3), min(len(own), k + 4))) / sum(weight[abs(j - k)] for j in range(max(0, k - 3), min(len(own), k + 4))) for k in range(len(own))]
    mean = sum(near) / len(near)
    spread = math.sqrt(sum((x - mean) ** 2 for x in near) / len(near))
    high = [x >= spread and x > 0 for x in near]
    out = []
    for k in range(len(own)):
        a = b = k
        while high[k] and a > 0 and high[a - 1]:
            a -= 1
        while high[k] and b + 1 < len(own) and high[b + 1]:
            b += 1
        alone = [j for j in range(a, b + 1) if high[j] and own[j] >= spread]
        out.append(high[k] and bool(alone) and alone[0] <= k <= alone[-1])
    return out


def test_clusters_against_brute_force():
    from runledger.llm.page_text import Line, content_lines

    rng = random.Random(6)
    for _ in range(200):
        lines = [("x" * rng.choice([3, 5, 40, 300, 800]), rng.randint(0, 9), rng.choice([0, 0, 3])) for _ in range(rng.randint(1, 30))]
        got = content_lines([Line(t, n, linked, 0, "p", 0) for t, n, linked in lines], np.zeros(len(lines), bool))
        assert list(got) == region_by_brute_force(lines)


def test_long_conversations_read_back_in_linear_time(spark):
    """8,000 turns of non-ASCII texts: the mask's text is exact; four times as many turns take no sixteen times as long."""
    import time

    from runledger.llm import chat_format

    took = []
    for n in (2_000, 32_000):
        df = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('äbc <| ', 60) || id text")
        made = chat_format.digest(chat_format.format_conversations(df))
        made.collect()
        began = time.perf_counter()
        r = made.first()
        took.append(time.perf_counter() - began)
        text = "".join("äbc <| " * 60 + str(k) for k in range(1, n, 2))
        assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert took[1] < 60 * max(0.2, took[0])


def plain_walk(text, moves, kinds):
    """The embedding of one text, a step at a time."""
    out, at = [], 0
    for j in range(3 * (len(text) + 1)):
        c = kinds[at] if at < len(text) else 0
        out.append(c)
        at += moves[j % len(moves)][c] if c else 0
    return out


def test_embedding_against_a_plain_walk():
    from runledger.llm import fingerprints as fp

    rng = random.Random(2)
    texts = ["", "a", "ab" * 30, "".join(rng.choice("abcdé日 ") for _ in range(500)), "x" * 9000]
    found, base = fp.embed(texts)
    for k, t in enumerate(texts):
        want = plain_walk(t, fp._MOVES[0], fp.classes(t)) if t else [0, 0, 0]
        assert found[base[k] : base[k] + len(want)].tolist() == want
        levels, samples = fp.sample([t])
        for up in (0, 1):
            assert samples[0, up].tolist() == [want[p] if p < len(want) else 0 for p in fp.places(int(levels[0]) + up)]


def test_near_texts_by_edit_rate(spark):
    """What near_id promises: most pairs of few edits; the likeness of pairs of many falls under the bound."""
    from runledger.llm import fingerprints as fp

    rng = random.Random(9)
    base = [r.text for r in spark.read.parquet(f"{BIGGER}/documents.parquet").where("n_chars between 600 and 4000").orderBy("doc_id").limit(120).collect()]
    rows, pairs = [], {0.001: [], 0.01: []}
    for k, (t, rate) in enumerate((t, r) for t in base for r in pairs):
        x = list(t)
        for _ in range(max(1, int(rate * len(t)))):
            x[rng.randrange(len(x))] = rng.choice("abcdefgh")
        rows += [(2 * k, f"{k}|{t[::-1]}"[::-1]), (2 * k + 1, f"{k}|{''.join(x)[::-1]}"[::-1])]
        pairs[rate].append((2 * k, 2 * k + 1))
    got = {r.doc_id: r.near_id for r in fp.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    share = {rate: sum(got[a] == got[b] for a, b in p) / len(p) for rate, p in pairs.items()}
    print(share)
    assert share[0.001] >= 0.85 and share[0.01] >= 0.4


def test_groups_of_near_copies_cost_in_proportion(spark):
    """600 copies, each with an edit of its own: they come together, without all pairs being tested."""
    from runledger.llm import fingerprints as fp

    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij ") for _ in range(1500))
    rows = []
    for k in range(600):
        at = rng.randrange(len(text))
        rows.append((k, f"{text[:at]}{rng.choice('xyz')}{text[at + 1:]}"))
    got = [r.near_id for r in fp.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert collections.Counter(got).most_common(1)[0][1] >= 570


def test_map_columns_pass_through_the_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "one two three four five six", "a", {"k": 1}), (1, "one two three four five six", "a", {"k": 1}), (2, "one two three four five six", "b", {"k": 2, "j": None}), (3, None, None, None)],
                                 "doc_id long, text string, source string, m map<string,int>").selectExpr("*", "array(named_struct('m', m)) deep")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, step in corpus_pipeline.STAGES[:3]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        if name == "ngram_jaccard_join":
            assert sorted((r.doc_id, r.m) for r in out.collect()) == [(1, {"k": 1}), (3, None)]
        else:
            out.collect()
