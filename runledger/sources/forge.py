"""Code-forge API dumps (JSON lines, one API object each) as entity and event rows.

Each reader gives rows with the fields used here and null where a field is missing or of another kind. Objects are
selected by creation time, both ends included; objects without one pass.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USER = "struct<login:string,username:string>"
SCHEMAS = {
    "issues": f"number long, title string, state string, user {USER}, closed_by {USER}, created_at string, updated_at string, closed_at string, pull_request string, description string",
    "pulls": f"number long, title string, state string, body string, user {USER}, merged_by {USER}, head struct<ref:string,sha:string>, requested_reviewers array<{USER}>, merge_commit_sha string, "
             "created_at string, updated_at string, closed_at string, merged_at string",
    "reviews": f"pull long, id long, state string, commit_id string, user {USER}, submitted_at string",
    "commits": f"pull long, sha string, author {USER}, commit struct<message:string,author:struct<name:string,date:string>>",
    "check_runs": "pull long, id long, conclusion string, completed_at string",
    "merge_requests": f"iid long, title string, state string, description string, source_branch string, author {USER}, merged_by {USER}, created_at string, updated_at string, closed_at string, merged_at string",
    "merge_request_commits": "iid long, id string, title string, author_name string, authored_date string, created_at string",
    "approvals": "iid long, updated_at string, approved_by array<struct<user:struct<id:long,username:string>,created_at:string>>",
    "pipelines": "iid long, id long, status string, ref string, finished_at string, updated_at string",
}
#: Check conclusions that count as failures, and the second forge's states.
FAILURES = ("failure", "timed_out", "action_required", "cancelled")
ENDINGS = {"success": "pipeline.succeeded", "failed": "pipeline.failed"}
STATES = {"opened": "open", "closed": "closed", "locked": "closed", "merged": "merged"}
ENTITY = "entity_id entity_type provider repository number title state author head_ref created_at updated_at owning_change_request_id".split()
EVENT = "event_id event_type provider repository entity_id occurred_at actor payload".split()


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).json(path)


def when(c: str) -> Column:
    """ISO time, null where it can't be read."""
    return F.try_to_timestamp(F.col(c))


def within(rows: DataFrame, since: datetime | None, until: datetime | None, c: str = "created_at") -> DataFrame:
    if since:
        rows = rows.where(when(c).isNull() | (when(c) >= F.lit(since).cast("timestamp")))
    return rows.where(when(c).isNull() | (when(c) <= F.lit(until).cast("timestamp"))) if until else rows


def _rows(rows: DataFrame, names: list[str], provider: str, repository: str, **columns: Column) -> DataFrame:
    fixed = {"provider": F.lit(provider), "repository": F.lit(repository)} | columns
    types = {"number": "long", "created_at": "timestamp", "updated_at": "timestamp", "occurred_at": "timestamp"}
    return rows.select(*[fixed.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in names])


def name(kind: str, c: Column) -> Column:
    return F.concat(F.lit(kind + ":"), c.cast("string"))


def entities(repository: str, issues: DataFrame, pulls: DataFrame, reviews: DataFrame, commits: DataFrame, provider: str = "github") -> DataFrame:
    """Issues, change requests, merges, reviews and commits; issues that are change requests don't count as issues."""
    def make(rows, **c):
        return _rows(rows, ENTITY, provider, repository, **c)

    base = {"number": F.col("number"), "title": F.col("title"), "state": F.col("state"), "author": F.col("user.login"), "created_at": when("created_at"), "updated_at": when("updated_at")}
    plain, pulls = issues.where("number is not null and pull_request is null"), pulls.where("number is not null")
    state = F.nullif(F.lower(F.coalesce("state", F.lit(""))), F.lit(""))
    return reduce(DataFrame.unionByName, [
        make(plain, entity_id=name("issue", F.col("number")), entity_type=F.lit("issue"), **base),
        make(pulls, entity_id=name("change_request", F.col("number")), entity_type=F.lit("change_request"), head_ref=F.col("head.ref"), **base),
        make(pulls.where(when("merged_at").isNotNull()), entity_id=name("merge_event", F.col("number")), entity_type=F.lit("merge_event"), number=F.col("number"),
             title=F.concat(F.lit("merge "), F.col("number")), state=F.lit("merged"), author=F.coalesce("merged_by.login", "user.login"), created_at=when("merged_at")),
        make(reviews.where("id is not null"), entity_id=name("review", F.col("id")), entity_type=F.lit("review"), title=F.concat_ws(" ", F.lit("review"), state), state=state,
             author=F.col("user.login"), created_at=when("submitted_at"), owning_change_request_id=F.col("pull")),
        make(commits.where("sha is not null"), entity_id=name("commit", F.col("sha")), entity_type=F.lit("commit"), title=F.col("commit.message"),
             author=F.coalesce("author.login", "commit.author.name"), created_at=when("commit.author.date"), owning_change_request_id=F.col("pull")),
    ])


def events(repository: str, issues: DataFrame, pulls: DataFrame, reviews: DataFrame, check_runs: DataFrame, provider: str = "github") -> DataFrame:
    """Openings, closings, merges (a merged request isn't also closed), review requests, verdicts and pipelines."""
    def make(rows, kind, entity, at, suffix=None, event_id=None, **c):
        out = _rows(rows, EVENT, provider, repository, event_id=event_id if event_id is not None else F.concat(entity, F.lit(":"), suffix), event_type=kind if isinstance(kind, Column) else F.lit(kind),
                    entity_id=entity, occurred_at=at, **c)
        return out.where("occurred_at is not null and event_type is not null")

    plain, pulls = issues.where("number is not null and pull_request is null"), pulls.where("number is not null")
    issue, cr, of = name("issue", F.col("number")), name("change_request", F.col("number")), name("change_request", F.col("pull"))
    asked = pulls.select("number", F.coalesce(when("updated_at"), when("created_at")).alias("at"), F.explode("requested_reviewers.login").alias("login")).where("login is not null")
    verdict = F.lower("state")
    kind = F.when(verdict == "approved", "change_request.approved").when(verdict == "changes_requested", "change_request.changes_requested")
    run = F.lower("conclusion")
    result = F.when(run == "success", "pipeline.succeeded").when(run.isin(*FAILURES), "pipeline.failed")
    merged = when("merged_at").isNotNull()
    return reduce(DataFrame.unionByName, [
        make(plain, "issue.opened", issue, when("created_at"), F.lit("opened"), actor=F.col("user.login")),
        make(plain, "issue.closed", issue, when("closed_at"), F.lit("closed"), actor=F.coalesce("closed_by.login", "user.login")),
        make(pulls, "change_request.opened", cr, when("created_at"), F.lit("opened"), actor=F.col("user.login")),
        make(asked, "change_request.review_requested", cr, F.col("at"), F.concat(F.lit("review_requested:"), F.col("login")), payload=F.to_json(F.struct(F.col("login").alias("reviewer")))),
        make(pulls, "change_request.merged", cr, when("merged_at"), F.lit("merged"), actor=F.coalesce("merged_by.login", "user.login"), payload=F.to_json(F.struct(F.nullif("merge_commit_sha", F.lit("")).alias("commit_sha")))),
        make(pulls.where(~merged & (F.col("state") == "closed")), "change_request.closed", cr, when("closed_at"), F.lit("closed"), actor=F.col("user.login")),
        make(reviews.where("id is not null"), kind, of, when("submitted_at"), event_id=name("review", F.col("id")), actor=F.col("user.login"), payload=F.to_json(F.struct(F.col("id").alias("review_id"), "commit_id"))),
        make(check_runs.where("id is not null"), result, of, when("completed_at"), event_id=name("check_run", F.col("id"))),
    ])


def merge_requests(rows: DataFrame) -> DataFrame:
    """The second forge's merge requests in the shape of pulls."""
    state = F.coalesce(*[F.when(F.col("state") == a, b) for a, b in STATES.items()], F.col("state"))
    user = lambda c: F.struct(F.coalesce(f"{c}.login", f"{c}.username").alias("login"), F.col(f"{c}.username").alias("username"))
    return rows.select(F.col("iid").alias("number"), "title", state.alias("state"), F.col("description").alias("body"), user("author").alias("user"), user("merged_by").alias("merged_by"),
                       F.struct(F.col("source_branch").alias("ref"), F.lit(None).cast("string").alias("sha")).alias("head"), F.array().cast(f"array<{USER}>").alias("requested_reviewers"),
                       F.lit(None).cast("string").alias("merge_commit_sha"), "created_at", "updated_at", "closed_at", "merged_at")


def approval_rows(approvals: DataFrame) -> DataFrame:
    """One row for each approval of a merge request: iid, user_id, username, at (its own time, else the request's last change)."""
    each = approvals.where("iid is not null").select("iid", "updated_at", F.explode("approved_by").alias("a")).select("iid", "updated_at", "a.created_at", F.col("a.user.id").alias("user_id"), F.col("a.user.username").alias("username"))
    return each.where("user_id is not null").select("iid", "user_id", "username", F.coalesce(when("created_at"), when("updated_at")).alias("at"))


def approval_entities(repository: str, approvals: DataFrame, provider: str = "gitlab") -> DataFrame:
    rows = approval_rows(approvals)
    return _rows(rows, ENTITY, provider, repository, entity_id=F.concat(name("review", F.col("iid")), F.lit(":"), F.col("user_id").cast("string")), entity_type=F.lit("review"), title=F.concat(F.lit("approval by "), F.col("username")),
                 state=F.lit("approved"), author=F.col("username"), created_at=F.col("at"), owning_change_request_id=F.col("iid"))


def pipeline_events(repository: str, pipelines: DataFrame, approvals: DataFrame, provider: str = "gitlab") -> DataFrame:
    """Approvals, and pipelines that ended, in order of time and id."""
    kind = F.coalesce(*[F.when(F.col("status") == a, b) for a, b in ENDINGS.items()])
    runs = _rows(pipelines.where("id is not null"), EVENT, provider, repository, event_id=name("pipeline", F.col("id")), event_type=kind, entity_id=name("change_request", F.col("iid")),
                 occurred_at=F.coalesce(when("finished_at"), when("updated_at")), payload=F.to_json(F.struct(F.col("id").alias("pipeline_id"), "status", "ref")))
    rows = approval_rows(approvals)
    of = name("change_request", F.col("iid"))
    given = _rows(rows, EVENT, provider, repository, event_id=F.concat(of, F.lit(":approved:"), F.col("user_id").cast("string")), event_type=F.lit("change_request.approved"), entity_id=of, occurred_at=F.col("at"), actor=F.col("username"))
    return runs.unionByName(given).where("occurred_at is not null and event_type is not null").orderBy("occurred_at", "event_id")


def merge_request_commits(repository: str, commits: DataFrame, provider: str = "gitlab") -> DataFrame:
    """Commits of the second forge's merge requests as entities; iid: the request that a commit was read from."""
    return _rows(commits.where("id is not null"), ENTITY, provider, repository, entity_id=name("commit", F.col("id")), entity_type=F.lit("commit"), title=F.col("title"), author=F.col("author_name"),
                 created_at=F.coalesce(when("authored_date"), when("created_at")), owning_change_request_id=F.col("iid"))
