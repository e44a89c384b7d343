"""Issue closures: link states of change requests, episodes of issues, and what closed them.

Facts are observations (repository, entity_type, external_id, event_type, occurred_at, observed_via, links); links is
the snapshot of issues that a change request declares to close, or null where it says nothing: an issue's number, or
repository#number where it's another repository's. A column `mentions` may hold issues that it refers to, in the same way. Late facts change
nothing in the rules: an issue's episodes follow from all its facts in order of time. The folds over time are written
as aggregates and windows by change request or issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CR, ISSUE = ["repository", "cr_id"], ["repository", "issue_id"]


def named(link: Column, repository: Column) -> tuple[Column, Column]:
    """An issue's repository and number."""
    other = F.instr(link, "#") > 0
    return F.when(other, F.substring_index(link, "#", 1)).otherwise(repository), F.when(other, F.substring_index(link, "#", -1)).otherwise(link)


def _touched(facts: DataFrame) -> DataFrame:
    """Facts of change requests with one row for each issue that they name, as issue_repository and issue_id."""
    none = F.array().cast("array<string>")
    every = F.coalesce("links", none)
    if "mentions" in facts.columns:
        every = F.concat(every, F.coalesce("mentions", none))
    rows = facts.where("entity_type = 'change_request'").withColumn("_link", F.explode(every))
    where, number = named(F.col("_link"), F.col("repository"))
    return rows.withColumn("issue_repository", where).withColumn("issue_id", number).drop("_link")


def naming(facts: DataFrame) -> DataFrame:
    """issue_repository, issue_id, repository, external_id: which issue a change request names, each pair once."""
    return _touched(facts).select("issue_repository", "issue_id", "repository", "external_id").distinct()


def link_states(facts: DataFrame) -> DataFrame:
    """repository, cr_id, issue_repository, issue_id, state: active, parked or revoked.

    Snapshots of one instant agree, or the only one seen by webhook wins; else what all name is active and what some
    name is parked. The last instant decides; links known from earlier ones are revoked."""
    snaps = facts.where("entity_type = 'change_request' and links is not null").select(
        "repository", F.col("external_id").alias("cr_id"), "occurred_at", F.sort_array(F.array_distinct("links")).alias("snap"), (F.col("observed_via") == "webhook").alias("hook"))
    groups = snaps.groupBy(*CR, "occurred_at").agg(F.collect_set("snap").alias("every"), F.collect_set(F.when(F.col("hook"), F.col("snap"))).alias("hooks"))
    one = F.when(F.size("every") == 1, F.get("every", F.lit(0))).when(F.size("hooks") == 1, F.get("hooks", F.lit(0)))
    common = F.aggregate("every", F.get("every", F.lit(0)), F.array_intersect)
    union = F.array_distinct(F.flatten("every"))
    groups = groups.select(*CR, "occurred_at", F.coalesce(one, common).alias("active"), F.coalesce(one, union).alias("named"))
    last = groups.groupBy(*CR).agg(F.max_by(F.struct("active", "named"), "occurred_at").alias("last"))
    known = groups.select(*CR, F.explode("named").alias("link")).distinct()
    state = F.when(F.array_contains("last.active", F.col("link")), "active").when(F.array_contains("last.named", F.col("link")), "parked").otherwise("revoked")
    where, number = named(F.col("link"), F.col("repository"))
    return known.join(last, CR).select(*CR, where.alias("issue_repository"), number.alias("issue_id"), state.alias("state"))


def _of_issues(links: DataFrame) -> DataFrame:
    """Links by issue; a change request of another repository is named with it."""
    cr = F.when(F.col("repository") == F.col("issue_repository"), F.col("cr_id")).otherwise(F.concat("repository", F.lit("#"), "cr_id"))
    return links.withColumn("cr_id", cr).withColumn("repository", F.col("issue_repository")).drop("issue_repository")


def merged_at(facts: DataFrame) -> DataFrame:
    return facts.where("event_type = 'change_request.merged'").groupBy("repository", F.col("external_id").alias("cr_id")).agg(F.min("occurred_at").alias("merged_at"))


def intervals(facts: DataFrame) -> DataFrame:
    """repository, issue_id, segment, opened_at, closed_at: one interval for each close and one after the last.

    An interval opens at its last reopening, else its first opening."""
    own = facts.where("event_type in ('issue.opened', 'issue.reopened', 'issue.closed')").select("repository", F.col("external_id").alias("issue_id"), "event_type", "occurred_at")
    closed = (F.col("event_type") == "issue.closed").cast("int")
    before = F.coalesce(F.sum(closed).over(W.partitionBy(*ISSUE).orderBy("occurred_at", "event_type").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("occurred_at"))
    return own.withColumn("segment", before).groupBy(*ISSUE, "segment").agg(
        F.coalesce(F.max(at("issue.reopened")), F.min(at("issue.opened"))).alias("opened_at"), F.max(at("issue.closed")).alias("closed_at"))


def episodes(facts: DataFrame) -> DataFrame:
    """repository, issue_id, segment, opened_at, closed_at, status, cr_id (attributed), found (status before superseding), candidates."""
    links = _of_issues(link_states(facts).where("state <> 'revoked'").join(merged_at(facts), CR, "left"))
    declared = links.groupBy(*ISSUE).agg(
        F.collect_list(F.struct("cr_id", "merged_at", (F.col("state") == "active").alias("active"))).alias("links"))
    spans = intervals(facts)
    has_active = F.exists("links", lambda x: x["active"])
    silent = declared.where(has_active).join(spans.select(*ISSUE).distinct(), ISSUE, "left_anti").select(*ISSUE, F.lit(0).cast("long").alias("segment"), F.lit(None).cast("timestamp").alias("opened_at"), F.lit(None).cast("timestamp").alias("closed_at"))
    rows = spans.unionByName(silent).join(declared, ISSUE, "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<cr_id:string,merged_at:timestamp,active:boolean>>")))
    open_ = F.col("closed_at").isNull()
    # an open interval counts where something is declared or an episode went before; one of nothing but late openings has a start
    rows = rows.where(~open_ | (F.col("segment") > 0) & F.col("opened_at").isNotNull() | F.exists("links", lambda x: x["active"]) & (F.col("opened_at").isNotNull() | (F.col("segment") == 0)))
    fit = F.filter("links", lambda x: x["merged_at"] < F.col("closed_at"))
    rows = rows.withColumn("fit", fit)
    active = F.filter("fit", lambda x: x["active"])
    parked = F.exists("fit", lambda x: ~x["active"])
    closed = F.when(parked | (F.size(active) > 1), "ambiguous").when(F.size(active) == 1, "inferred").otherwise("unmatched")
    merged = F.exists("links", lambda x: x["active"] & x["merged_at"].isNotNull())
    rows = rows.withColumn("found", F.when(open_, F.when(merged, "awaiting_closure").otherwise("pending")).otherwise(closed))
    is_last = F.lead("segment").over(W.partitionBy(*ISSUE).orderBy("segment")).isNull()
    names = F.sort_array(F.array_distinct(F.transform("fit", lambda x: x["cr_id"])))
    return rows.withColumn("last", is_last).select(
        *ISSUE, "segment", "opened_at", "closed_at", F.when(F.col("last"), F.col("found")).otherwise("superseded").alias("status"),
        F.when(F.col("found") == "inferred", F.get(active, F.lit(0))["cr_id"]).alias("cr_id"), "found", F.array_join(F.when(F.col("found") == "ambiguous", names).otherwise(F.array().cast("array<string>")), ",").alias("candidates"))


def unresolved(found: DataFrame) -> DataFrame:
    """Closes without one cause, superseded ones too: reason and candidates."""
    return found.where("found in ('unmatched', 'ambiguous')").select(*ISSUE, "closed_at", F.col("found").alias("reason"), "candidates")


def histories(found: DataFrame, links: DataFrame) -> DataFrame:
    """Each issue's episodes (superseded ones too) in order of close, open ones last, its closes without one cause, and all that ever declared to close it."""
    late = lambda c: F.struct(F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(c))
    item = F.struct(late("closed_at").alias("closed"), late("opened_at").alias("opened"), "segment", "status", "cr_id")
    open_ = F.when(F.col("found").isin("unmatched", "ambiguous"), F.struct("closed_at", F.col("found").alias("reason"), "candidates"))
    rows = found.groupBy(*ISSUE).agg(F.sort_array(F.collect_list(item)).alias("episodes"), F.sort_array(F.collect_list(open_)).alias("unresolved"))
    evidence = _of_issues(links).groupBy(*ISSUE).agg(F.sort_array(F.collect_list(F.struct("cr_id", "state"))).alias("evidence"))
    return rows.join(evidence, ISSUE, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<cr_id:string,state:string>>")))


def issues_within(facts: DataFrame, start, end) -> DataFrame:
    """Issues all of whose own facts lie between start and end."""
    own = facts.where("entity_type = 'issue'").groupBy("repository", F.col("external_id").alias("issue_id")).agg(F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b"))
    return own.where((F.col("a") >= F.lit(start).cast("timestamp")) & (F.col("b") <= F.lit(end).cast("timestamp"))).select(*ISSUE)


def affected(new: DataFrame, facts: DataFrame) -> DataFrame:
    """Issues that new facts touch: their own, and all that a changed change request ever named."""
    own = new.where("entity_type = 'issue'").select("repository", F.col("external_id").alias("issue_id"))
    crs = new.where("entity_type = 'change_request'").select("repository", "external_id").distinct()
    touched = _touched(facts.join(crs, ["repository", "external_id"], "left_semi")).select(F.col("issue_repository").alias("repository"), "issue_id")
    return own.unionByName(touched).distinct()


def facts_of(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """The facts that the episodes of some issues hang on."""
    own = facts.where("entity_type = 'issue'").join(issues.withColumnRenamed("issue_id", "external_id"), ["repository", "external_id"], "left_semi")
    wanted = issues.select(F.col("repository").alias("issue_repository"), "issue_id")
    naming = _touched(facts).join(wanted, ["issue_repository", "issue_id"], "left_semi").select("repository", "external_id").distinct()
    return own.unionByName(facts.where("entity_type = 'change_request'").join(naming, ["repository", "external_id"], "left_semi"))


def reconcile(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Stored and computed episodes matched by close (open with open), with action: insert, update, keep or supersede."""
    key = [*ISSUE, "closed_at"]
    a = stored.select(*ISSUE, F.col("closed_at").alias("old_closed"), F.col("status").alias("old_status"), F.col("cr_id").alias("old_cr"), F.lit(True).alias("_old"))
    b = computed.select(*key, "status", "cr_id", F.lit(True).alias("_new"))
    both = a.alias("a").join(b.alias("b"), (F.col("a.repository") == F.col("b.repository")) & (F.col("a.issue_id") == F.col("b.issue_id")) & F.col("old_closed").eqNullSafe(F.col("closed_at")), "full_outer")
    same = F.col("old_status").eqNullSafe(F.col("status")) & F.col("old_cr").eqNullSafe(F.col("cr_id"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "supersede").when(same, "keep").otherwise("update")
    return both.select(F.coalesce("a.repository", "b.repository").alias("repository"), F.coalesce("a.issue_id", "b.issue_id").alias("issue_id"),
                       F.coalesce("closed_at", "old_closed").alias("closed_at"), F.when(action == "supersede", "superseded").otherwise(F.col("status")).alias("status"), F.coalesce("cr_id", F.when(F.col("_new").isNull(), F.col("old_cr"))).alias("cr_id"), action.alias("action"))
