"""Runs and what they brought about: rules that propose links to entities, in a fixed order, and what follows from them.

Entities belong to a run's scope (the repository searched for it). Run ids, titles and times are joined on keys of
their own. What a branch or commit names, what is noise, and sessions hold for every run of a scope, so these give a row
for each run and entity of it by definition: ask for the runs that are wanted, not for a large repository's whole history.
A run's first proposal for an entity stands: later rules can't change it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
#: A rule's confidence, and the least one of a resolved link.
RESOLVED, MENTIONED, BRANCH, COMMIT, TEMPORAL, RUN_ID, THRESHOLD = 1.0, 0.1, 0.8, 0.6, 0.4, 1.0, 0.5
#: Fixed values: `#n`, and what closes issues. "fixe" counts, "fix" doesn't.
REFERENCE = r"#(\d+)"
CLOSING = r"(?i)\b(?:resolves?|closes?|fixes?)\s+#?\d+(?:\s*(?:,|and|&)?\s*#?\d+)*"
#: Days in a bucket, by level.
LEVELS = (7, 56, 448, 3584, 28_672, 1 << 24)
PROPOSAL = ["scope", "run_id", "entity_id", "confidence", "method", "rule"]


def references(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCE), F.lit(1)), lambda x: x.cast("long")))


def closing(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLOSING), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("long")))))


def digits(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long")))


def of_kind(entities: DataFrame, kind: str) -> DataFrame:
    return entities.where(F.col("entity_type") == kind)


#: Rows of a scope in one slice of a join by scope.
SLICE = 10_000


def numbered_issues(entities: DataFrame) -> DataFrame:
    """scope, number, issue_id: of several issues with one number the one with the greatest id."""
    return of_kind(entities, "issue").groupBy("scope", "number").agg(F.max("entity_id").alias("issue_id"))


def _proposal(rows: DataFrame, confidence, method: str, rule: int) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return rows.select("scope", "run_id", "entity_id", c.cast("double").alias("confidence"), F.lit(method).alias("method"), F.lit(rule).alias("rule"))


def by_scope(runs: DataFrame, rows: DataFrame, id_: str, how: str = "inner", slice_rows: int = SLICE, keep: bool = False) -> DataFrame:
    """runs with all rows of their scope. A scope's rows are dealt to slices of so many, and its runs go to each slice, so a
    large repository's pairs are made in as many tasks as they need; a scope with many runs and few rows is split by AQE.
    keep: the slice stays, as a key by which pairs can be grouped where they are."""
    slices = F.greatest(F.lit(1), F.ceil(F.col("_n") / slice_rows)).cast("int")
    sizes = rows.groupBy("scope").agg(F.count("*").alias("_n")).select("scope", slices.alias("_slices"))
    dealt = rows.join(sizes, "scope").withColumn("_slice", F.pmod(F.xxhash64(id_), F.col("_slices")).cast("int")).drop("_slices")
    sent = runs.join(sizes, "scope").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    pairs = sent.join(dealt, ["scope", "_slice"], how)
    return pairs if keep else pairs.drop("_slice")


def explicit_run_id(runs: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """An event's payload names the run."""
    named = events.withColumn("run_id", F.coalesce(F.get_json_object("payload", "$.run_id"), F.get_json_object("payload", "$.afk_run_id"))).select("scope", "run_id", "entity_id")
    return _proposal(runs.select("scope", "run_id").join(named, ["scope", "run_id"]).distinct(), RUN_ID, "explicit_run_id", 1)


def title_matches(runs: DataFrame, entities: DataFrame) -> DataFrame:
    """Change requests with a run's title, and how many of them there are."""
    cr = of_kind(entities, "change_request").select("scope", "title", "entity_id", "number", "description", "author", "repository", "state", "external_id")
    pairs = runs.select("scope", "run_id", "title").join(cr, ["scope", "title"])
    return pairs.withColumn("matches", F.count(F.lit(1)).over(W.partitionBy("scope", "run_id")))


def owners(runs: DataFrame, entities: DataFrame) -> DataFrame:
    """The one change request with a run's title; none where several have it."""
    return title_matches(runs, entities).where("matches = 1").drop("matches")


def issue_reference(runs: DataFrame, entities: DataFrame, events: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The owner, the issues that it closes, and those that it names. own: the owners of runs, where they are stored."""
    own = owners(runs, entities) if own is None else own
    closes = closing(F.col("description"))
    named = own.select("scope", "run_id", F.explode(F.array_union(references(F.col("description")), closes)).alias("number"), closes.alias("closed")).join(numbered_issues(entities), ["scope", "number"])
    found = named.select("scope", "run_id", F.col("issue_id").alias("entity_id"), F.when(F.array_contains("closed", F.col("number")), RESOLVED).otherwise(MENTIONED).alias("c"))
    return _proposal(own, RESOLVED, "issue_reference", 2).unionByName(_proposal(found, F.col("c"), "issue_reference", 2))


def _numbered(entities: DataFrame, numbers: Column, kind: str) -> DataFrame:
    return of_kind(entities, kind).select("scope", F.explode(numbers).alias("number")).distinct().join(numbered_issues(entities), ["scope", "number"]).select("scope", F.col("issue_id").alias("entity_id")).distinct()


def scope_proposals(entities: DataFrame) -> DataFrame:
    """scope, entity_id, confidence, method, rule: what branches and commits name, once for each scope, to be stored. It holds for every run of the scope."""
    named = {"branch_issue": (BRANCH, 3, _numbered(entities, digits(F.col("branch")), "change_request")), "commit_issue": (COMMIT, 4, _numbered(entities, references(F.col("title")), "commit"))}
    parts = [rows.select("scope", "entity_id", F.lit(c).cast("double").alias("confidence"), F.lit(m).alias("method"), F.lit(k).alias("rule")) for m, (c, k, rows) in named.items()]
    return parts[0].unionByName(parts[1])


def expand_proposals(runs: DataFrame, proposals: DataFrame) -> DataFrame:
    """The proposals of a scope for the runs asked for."""
    return by_scope(runs.select("scope", "run_id"), proposals, "entity_id").select(*PROPOSAL)


def branch_issue(runs: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Issues whose number stands in a change request's branch."""
    return _proposal(by_scope(runs.select("scope", "run_id"), _numbered(entities, digits(F.col("branch")), "change_request"), "entity_id"), BRANCH, "branch_issue", 3)


def commit_issue(runs: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Issues that a commit's title names."""
    return _proposal(by_scope(runs.select("scope", "run_id"), _numbered(entities, references(F.col("title")), "commit"), "entity_id"), COMMIT, "commit_issue", 4)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two closed times meet; unknown ends never do."""
    return F.coalesce((a_start <= b_end) & (b_start <= a_end), F.lit(False))


def _level(start: Column, end: Column) -> Column:
    """The least level whose buckets are four times as long as the interval, so that few intervals touch two of them."""
    span = (F.unix_seconds(F.greatest(start, end)) - F.unix_seconds(F.least(start, end))) / 86_400.0
    own = F.lit(len(LEVELS) - 1)
    for k in range(len(LEVELS) - 2, -1, -1):
        own = F.when(4 * span <= LEVELS[k], F.lit(k)).otherwise(own)
    return own


def _size(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x * 86_400) for x in LEVELS]), level + 1)


def _buckets(rows: DataFrame, start: str, end: str, others: list[int]) -> DataFrame:
    """rows by level and bucket: on their own level, and on those above it that any of the others has for its own, the buckets that the interval touches, two at most on each."""
    own, low, high = _level(F.col(start), F.col(end)), F.least(start, end), F.greatest(start, end)
    rows = rows.withColumn("level", F.explode(F.concat(F.array(own), F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > own))))
    size = _size(F.col("level"))
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.unix_seconds(low) / size), F.floor(F.unix_seconds(high) / size))))


def temporal(runs: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Entities whose time meets the run's. Two intervals meet once: on the higher of their levels, in the bucket where the later one starts.

    A level's buckets are eight times as long as those of the one before, so an entity that is open for years is a few rows.
    An interval that ends before it starts meets those that hold both of its ends: for the buckets, its ends change places.
    Entities that end before the first run starts, or start after the last one ends, are left out before the join."""
    r = runs.where("started_at is not null and finished_at is not null").select("scope", "run_id", "started_at", "finished_at")
    e = entities.where("entity_type <> 'merge_event' and created_at is not null and updated_at is not null").select("scope", "entity_id", "created_at", "updated_at")
    known = r.agg(F.min(F.unix_micros("started_at")).alias("first"), F.max(F.unix_micros("finished_at")).alias("last"), F.collect_set(_level(F.col("started_at"), F.col("finished_at"))).alias("own")).collect()[0]  # six numbers at most
    e = e.where((F.unix_micros("created_at") <= F.lit(known.last).cast("long")) & (F.unix_micros("updated_at") >= F.lit(known.first).cast("long")))
    of_entities = [x.own for x in e.select(_level(F.col("created_at"), F.col("updated_at")).alias("own")).distinct().collect()]
    met = _buckets(r, "started_at", "finished_at", of_entities).join(_buckets(e, "created_at", "updated_at", known.own), ["scope", "level", "bucket"])
    met = met.where((F.col("level") == F.greatest(_level(F.col("started_at"), F.col("finished_at")), _level(F.col("created_at"), F.col("updated_at")))) & overlap(F.col("started_at"), F.col("finished_at"), F.col("created_at"), F.col("updated_at")))
    later = F.greatest(F.least("started_at", "finished_at"), F.least("created_at", "updated_at"))
    return _proposal(met.where(F.col("bucket") == F.floor(F.unix_seconds(later) / _size(F.col("level")))), TEMPORAL, "temporal", 5)


#: A rule is a function of runs, entities and events; further ones can be appended.
RULES = (explicit_run_id, issue_reference, branch_issue, commit_issue, temporal)


#: Rules that hold for every run of a scope, with the confidence, method and rule of what they propose.
OF_SCOPE = {branch_issue: (BRANCH, "branch_issue", 3, "change_request", lambda: digits(F.col("branch"))), commit_issue: (COMMIT, "commit_issue", 4, "commit", lambda: references(F.col("title")))}
#: Entities of a scope that its runs meet in one task, as an array.
HELD = 1_000


def _least(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(F.struct("rule", (-F.col("confidence")).alias("c"), "method")).alias("p"))


def _held(entities: DataFrame, rules=RULES) -> list[DataFrame]:
    """What rules propose for every run of a scope."""
    return [_numbered(entities, numbers(), kind).select("scope", "entity_id", F.lit(c).cast("double").alias("confidence"), F.lit(m).alias("method"), F.lit(k).alias("rule"))
            for c, m, k, kind, numbers in (OF_SCOPE[rule] for rule in rules if rule in OF_SCOPE)]


def _dealt(entity_id: str, slices: Column) -> Column:
    return F.pmod(F.xxhash64(entity_id), F.coalesce(slices, F.lit(1))).cast("int").alias("_slice")


def _pairs(runs: DataFrame, single: list[DataFrame], held: DataFrame) -> DataFrame:
    """scope, _slice, run_id, entity_id, p: the least proposal of each run and entity.

    single: proposals of single runs. held: scope, entity_id and p (null for none), or what is noise: always, or where a run doesn't know all
    numbers of one of the entries of all. runs: scope, run_id and known, the numbers that a run knows.
    What holds for a whole scope is dealt to slices by entity and stays an array until its runs are there; what rules propose
    for single runs goes to the slice of its entity. So all proposals for a run and an entity meet where they are made, and
    the pairs themselves, by far the most rows, are never shuffled (a broadcast of small lists would leave the pairs undealt)."""
    # an array of (slice, proposals) for each scope's slices; a slice's number of rows is bounded, however large its scope is
    sizes = held.groupBy("scope").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / HELD)).cast("int").alias("_slices"))
    lists = held.join(sizes, "scope").select("scope", _dealt("entity_id", F.col("_slices")), F.struct("entity_id", "p", "always", "all").alias("v")).groupBy("scope", "_slice").agg(F.collect_list("v").alias("held"))
    kind = lists.schema["held"].dataType
    sent = runs.join(sizes, "scope").select("scope", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"), "run_id", "known", F.lit(None).cast(kind).alias("single"))
    for rows in single:
        p = F.struct("rule", (-F.col("confidence")).alias("c"), "method")
        value = F.array(F.struct("entity_id", p.alias("p"), F.lit(False).alias("always"), F.lit(None).cast("array<array<bigint>>").alias("all"))).alias("single")
        sent = sent.unionByName(rows.join(sizes, "scope", "left").select("scope", _dealt("entity_id", F.col("_slices")), "run_id", F.lit(None).cast("array<bigint>").alias("known"), value))
    met = sent.join(lists.hint("merge"), ["scope", "_slice"], "left").select("scope", "_slice", "run_id", "known", F.inline(F.coalesce("single", "held")))
    noisy = F.col("always") | F.exists("all", lambda x: F.size(F.array_except(x, F.coalesce("known", F.array().cast("array<bigint>")))) > 0)
    noise = F.when(noisy, F.struct(F.lit(NOISE).alias("rule"), F.lit(0.0).alias("c"), F.lit("noise").alias("method")))
    met = met.withColumn("p", F.coalesce("p", noise)).where("p is not null")
    return met.groupBy("scope", "_slice", "run_id", "entity_id").agg(F.min("p").alias("p"))


#: The places of lineage and noise after all rules.
LINEAGE, NOISE = 1_000_000, 1_000_001


def proposed(runs: DataFrame, entities: DataFrame, events: DataFrame, rules=RULES, own: DataFrame | None = None) -> DataFrame:
    """scope, _slice, run_id, entity_id, p (rule, c, method): the first rule's proposal for each entity, c being less the confidence. All runs of an entity lie in one slice of a scope, by which they can be grouped where they are."""
    single = [(rule(runs, entities, events, own) if rule is issue_reference else rule(runs, entities, events)).select(*PROPOSAL) for rule in rules if rule not in OF_SCOPE]
    held = _held(entities, rules)
    if not held:
        return _least(reduce(DataFrame.unionByName, single), "scope", "run_id", "entity_id").withColumn("_slice", F.lit(0))
    named = _least(reduce(DataFrame.unionByName, held), "scope", "entity_id").withColumns({"always": F.lit(False), "all": F.lit(None).cast("array<array<bigint>>")})
    return _pairs(runs.select("scope", "run_id").distinct().withColumn("known", F.lit(None).cast("array<bigint>")), single, named)


def correlate(runs: DataFrame, entities: DataFrame, events: DataFrame, rules=RULES) -> DataFrame:
    """scope, run_id, entity_id, confidence, method: the first rule's proposal for each entity."""
    return proposed(runs, entities, events, rules).select("scope", "run_id", "entity_id", (-F.col("p.c")).alias("confidence"), F.col("p.method").alias("method"))


def role(confidence: Column) -> Column:
    return F.when(confidence >= THRESHOLD, "resolved").otherwise("referenced")


def noise_candidates(entities: DataFrame) -> DataFrame:
    """scope, entity_id, named (null for change requests): what is noise to every run of a scope that it isn't bound to, once for each scope."""
    crs = of_kind(entities, "change_request").select("scope", "entity_id", F.lit(None).cast("array<bigint>").alias("named")).distinct()
    return crs.unionByName(of_kind(entities, "commit").select("scope", "entity_id", references(F.col("title")).alias("named")).where(F.size("named") > 0).distinct())


def known_numbers(runs: DataFrame, entities: DataFrame) -> DataFrame:
    """scope, run_id, known: the numbers that a run's owner closes, and its own; a commit that names no other isn't noise."""
    return owners(runs, entities).select("scope", "run_id", _known().alias("known"))


def _known() -> Column:
    number = F.when(F.col("number").isNotNull(), F.array("number")).otherwise(F.array().cast("array<bigint>"))
    return F.concat(closing(F.col("description")), number)


def not_noise(runs: DataFrame, entities: DataFrame, bound: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """scope, run_id, entity_id: the candidates that aren't noise to a run, being bound to it or naming only what it knows.

    A run's noise is its scope's candidates without these: the anti-set has a few rows a run, where noise has one for each entity."""
    candidates = noise_candidates(entities) if candidates is None else candidates
    key = ["scope", "run_id", "entity_id"]
    linked = bound.select(*key).join(candidates.select("scope", "entity_id").distinct(), ["scope", "entity_id"], "left_semi").select(*key)
    # only commits that name a known number can name no other
    known = known_numbers(runs, entities)
    titles = candidates.where("named is not null").groupBy("scope", "entity_id").agg(F.collect_set("named").alias("all"))  # of copies of a commit, each counts
    named = titles.select("scope", "entity_id", "all", F.explode(F.array_distinct(F.flatten("all"))).alias("n"))
    meet = known.select("scope", "run_id", "known", F.explode(F.array_distinct("known")).alias("n")).join(named, ["scope", "n"])
    tame = meet.where(F.forall("all", lambda x: F.size(F.array_except(x, F.col("known"))) == 0))
    return linked.unionByName(tame.select(*key)).distinct()


def noise_counts(runs: DataFrame, entities: DataFrame, bound: DataFrame) -> DataFrame:
    """scope, run_id, noise: how many entities are noise to each run, without a row for each of them."""
    every = noise_candidates(entities)
    total = every.groupBy("scope").agg(F.countDistinct("entity_id").alias("all"))
    less = not_noise(runs, entities, bound, every).groupBy("scope", "run_id").agg(F.count("*").alias("less"))
    rows = runs.select("scope", "run_id").distinct().join(total, "scope").join(less, ["scope", "run_id"], "left")
    return rows.select("scope", "run_id", (F.col("all") - F.coalesce("less", F.lit(0))).alias("noise"))


def entity_links(runs: DataFrame, entities: DataFrame, correlations: DataFrame, noise: bool = True) -> DataFrame:
    """Links with role and source: correlated ones, the owner's commits and reviews, and noise, which meet where pairs are made (`_pairs`)."""
    own = owners(runs, entities).select("scope", "run_id", F.col("entity_id").alias("owner_id"), F.col("external_id").alias("owning_id"), "number", "description")
    sure = own.join(correlations.select("scope", "run_id", F.col("entity_id").alias("owner_id"), "confidence"), ["scope", "run_id", "owner_id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(RESOLVED)))
    return _links(runs, entities, [correlations.select("scope", "run_id", "entity_id", "confidence", "method", F.lit(0).alias("rule"))], [], sure, noise)


def linked(runs: DataFrame, entities: DataFrame, events: DataFrame, noise: bool = True) -> DataFrame:
    """The entity_links of what RULES propose, whose correlations needn't be shuffled either. An owner's own link comes from one of the first two rules, so it is certain."""
    own = stage(owners(runs, entities).select("scope", "run_id", "entity_id", "external_id", "number", "description"), "owners")
    single = [(rule(runs, entities, events, own) if rule is issue_reference else rule(runs, entities, events)).select(*PROPOSAL) for rule in RULES if rule not in OF_SCOPE]
    sure = own.select("scope", "run_id", F.col("external_id").alias("owning_id"), "number", "description", F.lit(RESOLVED).alias("confidence"))
    return _links(runs, entities, single, _held(entities), sure, noise)


def _links(runs: DataFrame, entities: DataFrame, single: list[DataFrame], held: list[DataFrame], sure: DataFrame, noise: bool) -> DataFrame:
    kin = entities.where("entity_type in ('commit', 'review')").select("scope", "entity_id", F.col("owning_change_request_id").alias("owning_id"))
    lineage = sure.join(kin, ["scope", "owning_id"]).select("scope", "run_id", "entity_id", "confidence", F.lit("lineage").alias("method"), F.lit(LINEAGE).alias("rule"))
    none = {"p": F.lit(None).cast("struct<rule:int,c:double,method:string>"), "named": F.lit(None).cast("array<bigint>"), "always": F.lit(False)}
    parts = [rows.select("scope", "entity_id", F.struct("rule", (-F.col("confidence")).alias("c"), "method").alias("p"), none["named"].alias("named"), none["always"].alias("always")) for rows in held]
    every = noise_candidates(entities).select("scope", "entity_id", none["p"].alias("p"), "named", F.col("named").isNull().alias("always"))
    parts.append(every if noise else every.where("false"))
    named = reduce(DataFrame.unionByName, parts).groupBy("scope", "entity_id").agg(F.min("p").alias("p"), F.max("always").alias("always"), F.collect_set("named").alias("all"))
    ids = runs.select("scope", "run_id").distinct()
    if noise:
        known = sure.select("scope", "run_id", _known().alias("known"))
        ids = ids.join(known, ["scope", "run_id"], "left")
    else:
        ids = ids.withColumn("known", F.lit(None).cast("array<bigint>"))
    rule = F.col("p.rule")
    confidence = F.when(rule == NOISE, 0.0).otherwise(-F.col("p.c")).alias("confidence")
    found = _pairs(ids, [*single, lineage], named).select("scope", "run_id", "entity_id", rule.alias("_rule"), confidence)
    return found.select("scope", "run_id", "entity_id", F.when(F.col("_rule") == NOISE, "noise").otherwise(role(F.col("confidence"))).alias("role"), "confidence",
                        F.when(F.col("_rule") == LINEAGE, "owning_change_request").otherwise("direct").alias("source"))


def session_links(runs: DataFrame, entities: DataFrame, sessions: DataFrame, carried: tuple[str, ...] = (), own: DataFrame | None = None) -> DataFrame:
    """Sessions of a run's scope and the first that holds: same agent as the owner's author, client, project, overlapping time. carried: columns of sessions that come along."""
    own = (owners(runs, entities) if own is None else own).select("scope", "run_id", F.col("author").alias("run_agent"), F.col("repository").alias("run_project"))
    pairs = runs.select("scope", "run_id", "started_at", "finished_at", F.col("client").alias("run_client")).join(own, ["scope", "run_id"], "left")
    pairs = by_scope(pairs, sessions, "session_id", keep=True)
    method = (F.when(F.col("agent") == F.col("run_agent"), "agent_identity").when(F.col("client") == F.col("run_client"), "client_identity")
              .when(F.col("project") == F.col("run_project"), "project_match")
              .when(overlap(F.col("started_at"), F.col("finished_at"), F.col("session_started_at"), F.col("session_finished_at")), "temporal_overlap"))
    return pairs.select("scope", "run_id", "session_id", method.alias("method"), *carried).where("method is not null")


def unresolved(runs: DataFrame, entities: DataFrame, correlations: DataFrame) -> DataFrame:
    """Runs with several owners (ambiguous, with the candidates), and runs with neither owner nor link (unmatched)."""
    several = title_matches(runs, entities).where("matches > 1").groupBy("scope", "run_id").agg(F.array_join(F.sort_array(F.collect_list("entity_id")), ",").alias("candidates"))
    key = ["scope", "run_id"]
    none = runs.select(*key).join(title_matches(runs, entities).select(*key).distinct(), key, "left_anti").join(correlations.select(*key).distinct(), key, "left_anti")
    return several.select(*key, F.lit("ambiguous").alias("reason"), "candidates").unionByName(none.select(*key, F.lit("unmatched").alias("reason"), F.lit("").alias("candidates")))


def outcomes(runs: DataFrame, entities: DataFrame, correlations: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Of runs with an owner: merged, closed or open, the issues resolved, and the merge."""
    own = (owners(runs, entities) if own is None else own).select("scope", "run_id", F.col("entity_id").alias("owner_id"), "number", "state")
    merges = of_kind(entities, "merge_event").groupBy("scope", "number").agg(F.min("entity_id").alias("merge_event_id"), F.min_by("created_at", "entity_id").alias("merged_at"))
    issues = correlations.where((F.col("confidence") >= THRESHOLD) & F.col("entity_id").startswith("issue:")).groupBy("scope", "run_id").agg(F.array_join(F.sort_array(F.collect_set("entity_id")), ",").alias("resolved_issues"))
    state = F.lower(F.coalesce("state", F.lit("")))
    return (own.join(merges, ["scope", "number"], "left").join(issues, ["scope", "run_id"], "left")
            .select("scope", "run_id", "owner_id", F.when(F.col("merge_event_id").isNotNull() | (state == "merged"), "merged").when(state == "closed", "closed").otherwise("open").alias("status"),
                    F.coalesce("resolved_issues", F.lit("")).alias("resolved_issues"), "merge_event_id", "merged_at"))


def dedupe_entities(entities: DataFrame, runs: DataFrame, order: str = "arrival_seq") -> DataFrame:
    """One copy of each entity for each run: that of the run's owner, else the first."""
    own = owners(runs, entities).select("scope", "run_id", F.col("external_id").alias("_owning"))
    pairs = by_scope(runs.select("scope", "run_id").join(own, ["scope", "run_id"], "left"), entities.select("scope", "entity_id", "owning_change_request_id", order), "entity_id", keep=True)
    best = F.min(F.struct((~F.coalesce(F.col("owning_change_request_id") == F.col("_owning"), F.lit(False))).alias("a"), F.col(order).alias("b"), F.col("owning_change_request_id").alias("c")))
    return pairs.groupBy("scope", "_slice", "run_id", "entity_id").agg(best["c"].alias("owning_change_request_id")).drop("_slice")


def match_buckets(correlations: DataFrame) -> DataFrame:
    """Numbers of explicit, high (threshold or more) and inferred links."""
    n = lambda c: F.count(F.when(c, 1))
    sure = F.col("method") == "explicit_run_id"
    high = F.col("confidence") >= THRESHOLD
    return correlations.agg(n(sure).alias("explicit"), n(~sure & high).alias("high"), n(~sure & ~high).alias("inferred"))


def run_usage(links: DataFrame, facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each run's tokens, cost (null if none is known) and agents over its sessions, each counted once."""
    own = links.select("scope", "run_id", "session_id").distinct()
    sums = facts.groupBy("session_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("estimated_cost_usd").alias("c"))
    return own.join(sums, "session_id", "left").join(sessions.select("session_id", "agent"), "session_id", "left").groupBy("scope", "run_id").agg(
        F.coalesce(F.sum("i"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum("o"), F.lit(0)).cast("long").alias("output_tokens"),
        F.sum("c").alias("estimated_cost_usd"), F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("agents"))


def scope_usage(runs: DataFrame, entities: DataFrame, run_sessions: DataFrame, facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """run_usage of the session_links of runs. Sums go to the sessions before these meet the runs, so that pairs, by far the most rows, are
    added up where they are made and never shuffled; what leaves a slice is a row for each of its runs."""
    sums = facts.groupBy("session_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("estimated_cost_usd").alias("c"))
    used = sums.join(sessions.select("session_id", "agent"), "session_id", "full_outer").groupBy("session_id").agg(
        F.sum("i").alias("_i"), F.sum("o").alias("_o"), F.sum("c").alias("_c"), F.sort_array(F.collect_set("agent")).alias("_agents"))
    names = ("_i", "_o", "_c", "_agents")
    pairs = session_links(runs, entities, run_sessions.join(used, "session_id", "left"), ("_slice", *names)).drop("method").distinct()  # a session counts once for a run
    part = pairs.groupBy("scope", "_slice", "run_id").agg(*[F.sum(c).alias(c) for c in names[:3]], F.array_distinct(F.flatten(F.collect_set("_agents"))).alias("_agents"))
    return part.groupBy("scope", "run_id").agg(
        F.coalesce(F.sum("_i"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum("_o"), F.lit(0)).cast("long").alias("output_tokens"),
        F.sum("_c").alias("estimated_cost_usd"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("_agents")))), ",").alias("agents"))


def superseded_links(pairs: DataFrame) -> DataFrame:
    """proposed pairs as links that know whether another run has their entity with more confidence; all runs of an entity lie in one slice, so this is told where the pairs are."""
    c = -F.col("p.c")
    most = F.max(c).over(W.partitionBy("scope", "_slice", "entity_id"))
    return pairs.select("scope", "run_id", "entity_id", c.alias("confidence"), F.col("p.method").alias("method"), (c < most).alias("superseded"))


def reconstruct(runs: DataFrame, links: DataFrame, entities: DataFrame, events: DataFrame, sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Every run read back as one nested row: its own columns, entities, entity_links, correlations, events, session_links and outcome.

    Links that are superseded don't count. A linked entity is there once, if it's stored; a correlation for each link with a method, all events of all
    linked entities. sessions: session_links of runs; results: their outcomes. What is known of an entity meets its links by
    entity, all parts of a run meet in one shuffle by run."""
    key = ["scope", "run_id"]
    info, payload = F.struct("repository", "owning_change_request_id"), F.struct("payload")
    known = entities.select("scope", "entity_id", info.alias("info")).unionByName(events.select("scope", "entity_id", payload.alias("event")), allowMissingColumns=True)
    about = known.groupBy("scope", "entity_id").agg(F.min("info").alias("info"), F.collect_list("event").alias("happened"))
    live = links.where("not superseded").join(about, ["scope", "entity_id"], "left")
    # one item for each link crosses the shuffle, the lists are made of it where a run's items are
    item = F.struct("entity_id", "confidence", "method", "info", F.coalesce("happened", F.array().cast(about.schema["happened"].dataType)).alias("happened"))
    parts = [runs.select(*key, F.struct(*[c for c in runs.columns if c not in key]).alias("run")),
             live.select(*key, item.alias("item")),
             sessions.select(*key, F.struct("session_id", "method").alias("session_links")),
             results.select(*key, F.struct(*[c for c in results.columns if c not in key]).alias("outcome"))]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = every.groupBy(*key).agg(F.max("run").alias("run"), F.sort_array(F.collect_list("item")).alias("items"), F.sort_array(F.collect_list("session_links")).alias("session_links"), F.max("outcome").alias("outcome")).where("run is not null")
    entities_ = F.array_distinct(F.transform(F.filter("items", lambda x: x["info"].isNotNull()), lambda x: F.struct(x["entity_id"].alias("entity_id"), x["info"]["repository"].alias("repository"), x["info"]["owning_change_request_id"].alias("owning_change_request_id"))))
    links_ = F.transform("items", lambda x: F.struct(x["entity_id"].alias("entity_id"), role(x["confidence"]).alias("role"), x["confidence"].alias("confidence")))
    found = F.transform(F.filter("items", lambda x: x["method"].isNotNull()), lambda x: F.struct(F.concat_ws(":", F.col("run_id"), x["entity_id"]).alias("correlation_id"), *[x[n].alias(n) for n in ("entity_id", "confidence", "method")]))
    happened = F.sort_array(F.flatten(F.transform("items", lambda x: F.transform(x["happened"], lambda y: F.struct(x["entity_id"].alias("entity_id"), y["payload"].alias("payload"))))))
    return rows.select(*key, "run.*", entities_.alias("entities"), links_.alias("entity_links"), found.alias("correlations"), happened.alias("events"), "session_links", "outcome")
