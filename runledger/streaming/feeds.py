"""The two event feeds as Structured Streaming: usage records, and normalised forge events.

Sources give rows with a text column `value` (Kafka, or files of JSON lines). What can't be used goes to a dead-letter
table with its reason. Micro-batches append only what the stored table doesn't have, so a batch that is replayed
after a lost executor or driver changes nothing and tells the same again, however late it comes; offsets are kept in the
checkpoint. Stored tables are found by key: a batch reads what may hold its own keys.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..operators import closure as E
from ..operators import merge as M
from ..operators import reporting as G
from ..session import drop, stage
from ..sources.tables import Folder, KeyedTable, Snapshot, having

USAGE = ("source_record_id string, client_id long, source_database_id long, session_id string, model_name string, input_tokens string, output_tokens string, cached_tokens string, "
         "reasoning_tokens long, cache_read_tokens long, cache_write_tokens long, estimated_cost_usd decimal(18,6), reported_at timestamp, provider string, arrival_seq long")
EVENTS = ("schema_version string, event_type string, provider string, delivery_id string, resource struct<type:string,repository_url:string,number:long>, action string, occurred_at timestamp, ingested_at timestamp, "
          "actor string, redacted_payload struct<reference:struct<provider:string,delivery_id:string>>, issue_links struct<references:array<struct<repository:string,number:string>>,declares_closure:array<struct<repository:string,number:string>>>")
#: The versions of a usage batch that are read, and its lists.
BATCH_VERSIONS = ("1.0", "1.1", "1.2", "1.3")
BATCH = {
    "records": USAGE,
    "session_contexts": "external_session_id string, parent_external_session_id string, external_project_id string, source_directory string, source_path string, title string, slug string, version string, session_model string, session_cost decimal(18,6), code_change_count long, code_change_additions long, code_change_deletions long, source_created_at long, source_updated_at long",
    "projects": "external_project_id string, worktree string, vcs string, name string, display_name string, icon string, icon_color string, source_created_at long, source_updated_at long",
    "project_directories": "external_project_id string, directory string, directory_type string, strategy string, source_created_at long",
    "session_todos": "external_session_id string, content string, position long, status string, priority string, content_hash string, source_created_at long",
    "messages": "external_message_id string, external_session_id string, role string, agent string, mode string, cost_usd decimal(18,6), input_tokens long, output_tokens long, parent_external_session_id string, source_created_at long, data string",
    "parts": "external_part_id string, external_message_id string, external_session_id string, part_type string, source_created_at long, data string",
}
DELIVERIES = "provider string, delivery_id string, event_type string, occurred_at string, payload string"
BINDINGS = ("awx_job struct<job_id:string,job_template_id:string>, external_session_id string, resource struct<provider:string,repository:string,resource_type:string,resource_number:string>, outcome string, source_event_id string, "
            "branch string, title string, started_at timestamp, finished_at timestamp, failure_reason string")
#: How a job may end.
ENDINGS = ("completed", "failed", "cancelled")
#: The actions that a resource may have, and the canonical name of those that have another.
ACTIONS = {
    "issue": ("closed", "edited", "opened", "reopened", "updated"),
    "pull_request": ("closed", "edited", "merged", "opened", "reopened"),
    "merge_request": ("closed", "merged", "opened", "reopened", "updated"),
}
RENAMED = {"edited": "updated"}


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic as a stream of texts (needs Spark's Kafka package)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.options(**options).text(path)


def parsed_usage(raw: DataFrame) -> DataFrame:
    """Usage records with status and reason; what isn't JSON or lacks its key is rejected."""
    rows = raw.select("value", F.from_json("value", USAGE, {"mode": "PERMISSIVE"}).alias("r")).select("value", "r.*")
    rows = M.validate_tokens(rows)
    keyless = F.col("source_record_id").isNull() | F.col("client_id").isNull() | F.col("source_database_id").isNull()
    return rows.withColumn("reason", F.when(keyless, "Malformed record").otherwise(F.col("reason"))).withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))


def _quoted(c: Column) -> Column:
    return F.when(c.isNull(), "None").otherwise(F.concat(F.lit("'"), c, F.lit("'")))


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def parsed_events(raw: DataFrame) -> DataFrame:
    """Normalised events with the reason of the first rule that they break, and their canonical fields."""
    rows = raw.select("value", F.from_json("value", EVENTS, {"mode": "PERMISSIVE"}).alias("e")).select("value", "e.*")
    kind, repo = F.col("resource.type"), C.repository(F.col("resource.repository_url"))
    ref = F.col("redacted_payload.reference")
    allowed = F.coalesce(*[F.when(kind == k, F.col("action").isin(*v)) for k, v in ACTIONS.items()], F.lit(False))
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    action = F.coalesce(*[F.when(kind == k, F.concat(F.lit("Unsupported action: "), _quoted(F.col("action")), F.lit(f" for resource type '{k}' (supported: {_listed(v)})"))) for k, v in ACTIONS.items()])
    reason = (F.when(F.col("delivery_id").isNull() | F.col("provider").isNull(), "Malformed event")
              .when(bad(F.col("schema_version") == "1.0"), F.concat(F.lit("Unsupported schema version: "), _quoted(F.col("schema_version")), F.lit(" (supported: ['1.0'])")))
              .when(bad(F.col("event_type") == "normalized"), F.concat(F.lit("Unsupported event type: "), _quoted(F.col("event_type")), F.lit(" (supported: 'normalized')")))
              .when(bad(kind.isin(*ACTIONS)), F.concat(F.lit("Unsupported resource type: "), _quoted(kind), F.lit(f" (supported: {_listed(ACTIONS)})")))
              .when(~allowed, action)
              .when(repo.isNull(), F.concat(F.lit("Invalid repository identity: "), _quoted(F.col("resource.repository_url")), F.lit(" — must be an absolute HTTP(S) URL with a valid hostname and path")))
              .when(bad(ref["provider"] == F.col("provider")), F.concat(F.lit("Reference mismatch: redacted_payload.reference.provider="), _quoted(ref["provider"]), F.lit(" != envelope.provider="), _quoted(F.col("provider"))))
              .when(bad(ref["delivery_id"] == F.col("delivery_id")), F.concat(F.lit("Reference mismatch: redacted_payload.reference.delivery_id="), _quoted(ref["delivery_id"]), F.lit(" != envelope.delivery_id="), _quoted(F.col("delivery_id")))))
    entity, external = C.resource_type(kind), F.coalesce(F.col("resource.number").cast("string"), F.lit(""))
    step = F.coalesce(*[F.when(F.col("action") == a, b) for a, b in RENAMED.items()], F.col("action"))
    event_type, at = F.concat(entity, F.lit("."), step), F.coalesce("occurred_at", "ingested_at")
    # a snapshot is one where either list has an item, even if none can be read
    listed = F.coalesce(F.size("issue_links.declares_closure") > 0, F.lit(False)) | F.coalesce(F.size("issue_links.references") > 0, F.lit(False))

    def issues(field: str) -> Column:
        def link(x: Column) -> Column:
            other = C.repository(x["repository"])
            return F.when(other == repo, x["number"]).otherwise(F.concat(other, F.lit("#"), x["number"]))

        known = F.filter(F.transform(f"issue_links.{field}", link), lambda x: x.isNotNull())
        return F.when(listed, F.coalesce(known, F.array().cast("array<string>")))

    return rows.select("value", reason.alias("reason"), "provider", "delivery_id", repo.alias("repository"), entity.alias("entity_type"), external.alias("external_id"), event_type.alias("event_type"), at.alias("occurred_at"), "actor",
                       F.lit("webhook").alias("observed_via"), issues("declares_closure").alias("links"), issues("references").alias("mentions"), C.observation_key(F.col("provider"), repo, entity, external, event_type, at).alias("observation_key"))


def parsed_batch(raw: DataFrame) -> dict[str, DataFrame]:
    """The tables of usage batches by the name of their list, each row with its source database and batch (replay_id); rejected: batches of another version."""
    lists = ", ".join(f"{k} array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _columns(v))}>>" for k, v in BATCH.items())
    rows = raw.select("value", F.from_json("value", f"schema_version string, collector_version string, source_database_id long, replay_id string, {lists}", {"mode": "PERMISSIVE"}).alias("b")).select("value", "b.*")
    known = F.coalesce(F.col("schema_version").isin(*BATCH_VERSIONS), F.lit(False)) & F.col("source_database_id").isNotNull()
    out = {"rejected": rows.where(~known).select("value", F.concat(F.lit("Unsupported schema version: "), _quoted(F.col("schema_version"))).alias("reason"))}
    for name in BATCH:
        item = rows.where(known).select(F.col("source_database_id").alias("_database"), "replay_id", F.explode(name).alias("r")).select("_database", "replay_id", "r.*").drop("source_database_id")
        out[name] = item.withColumnRenamed("_database", "source_database_id")
    return out


def _columns(schema: str) -> list[str]:
    return re.split(r",\s*(?![^(]*\))", schema)


def parsed_deliveries(raw: DataFrame) -> DataFrame:
    """Reporting deliveries with their reason; a time must carry its offset, and is given in UTC. The resource is read from the payload,
    and null where it names none: such a delivery is stored all the same."""
    rows = raw.select("value", F.from_json("value", DELIVERIES, {"mode": "PERMISSIVE"}).alias("d")).select("value", "d.*")
    zoned = F.col("occurred_at").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    at = F.when(zoned, F.try_to_timestamp("occurred_at"))
    reason = (F.when(F.col("provider").isNull() | F.col("delivery_id").isNull() | F.col("event_type").isNull(), "Malformed delivery")
              .when(~F.coalesce(zoned, F.lit(False)), "occurred_at must carry an offset").when(at.isNull(), "occurred_at can't be read"))
    named = {k: v.alias(k) for k, v in G.payload_identity().items()}
    return rows.select("value", reason.alias("reason"), "provider", "delivery_id", "event_type", at.alias("occurred_at"), "payload", *named.values(), F.get_json_object("payload", "$.resource.state").alias("state"))


def parsed_bindings(raw: DataFrame) -> DataFrame:
    """Execution bindings with the reason of the first rule that they break."""
    rows = raw.select("value", F.from_json("value", BINDINGS, {"mode": "PERMISSIVE"}).alias("b")).select("value", "b.*")
    repo = C.repository(F.col("resource.repository"))
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    reason = (F.when(bad(F.col("awx_job.job_id").rlike(r"^\d+$")), "job_id must be a number").when(F.col("external_session_id").isNull(), "external_session_id is missing")
              .when(bad(F.col("resource.provider").isin("github", "gitlab")), "Unknown provider").when(repo.isNull(), "Invalid repository identity")
              .when(bad(F.col("resource.resource_type") == "change_request"), "resource_type must be change_request").when(F.col("resource.resource_number").isNull(), "resource_number is missing")
              .when(bad(F.col("outcome").isin(*ENDINGS)), "Unknown outcome").when(F.length("failure_reason") > 1000, "failure_reason is too long")
              .when(F.col("finished_at") < F.col("started_at"), "finished_at is before started_at"))
    return rows.select("value", reason.alias("reason"), F.col("awx_job.job_id").alias("job_id"), F.col("awx_job.job_template_id").alias("job_template_id"), "external_session_id", F.col("resource.provider").alias("provider"),
                       repo.alias("repository"), F.col("resource.resource_type").alias("resource_type"), F.col("resource.resource_number").alias("resource_number"), "outcome", "source_event_id", "branch", "title", "started_at", "finished_at", "failure_reason")


def _stored(spark: SparkSession, path: str, like: StructType) -> DataFrame:
    """A table that may not be there yet."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    return spark.read.schema(like).parquet(path) if there else spark.createDataFrame([], like)


def merge_batch(rows: DataFrame, table: KeyedTable, order: list[str], batch: str, compared: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Appends the first row of each key that the table doesn't have: (each row's key with its status and reason, the rows that were appended).

    The row that is stored is accepted, one that compares equal to it is a duplicate, any other is in conflict with it; of
    rows that tie in order one is stored. A batch that comes again finds what it stored itself under its name, leaves that
    alone, and tells the same as the first time. Both results are staged tables."""
    key = table.key
    fields = [*key, *[c for c in compared if c not in key], *[c for c in order if c not in key and c not in compared]]
    rows = stage(rows.withColumn("_id", F.monotonically_increasing_id()), "batch")
    old = table.lookup(rows, but=batch)
    both = old.select(*fields, F.lit(0).alias("_new"), F.lit(-1).cast("long").alias("_id")).unionByName(rows.select(*fields, F.lit(1).alias("_new"), "_id"))
    rest = [c for c in fields if c not in order]
    first = both.groupBy(*key).agg(F.min(F.struct("_new", *order, *rest, "_id")).alias("_first"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"_rows.{c}").eqNullSafe(F.col("_keys._first")[c])
    own = (F.col("_keys._first._new") == 1) & (F.col("_keys._first._id") == F.col("_rows._id"))
    told = having(rows, first, key, "inner").select("_rows.*", own.alias("_own"), same.alias("_same"))
    told = stage(told.select(*rows.columns, F.when(F.col("_own"), "accepted").when(F.col("_same"), "duplicate").otherwise("conflict").alias("_status")), "told")
    fresh = told.where("_status = 'accepted'").select(*[c for c in rows.columns if c != "_id"])
    table.append(fresh, batch)
    reason = F.when(F.col("_status") == "duplicate", M.IDEMPOTENT).when(F.col("_status") == "conflict", M.DIVERGENT)
    drop(rows)
    return told.select(*key, F.col("_status").alias("status"), reason.alias("reason")), fresh


def batch_name(spark: SparkSession, checkpoint: str, number: int) -> str:
    """A batch's name: its number, and the id that its query keeps in the checkpoint, so that a new checkpoint's batches are others."""
    known = json.loads(Folder(spark, checkpoint).text("metadata"))["id"]
    return f"{known}-{number:09d}"


def run_stream(source: DataFrame, parse, key: list[str], order: list[str], table: str, dead_letters: str, checkpoint: str, after=None, compared: list[str] = (), ledger: str | None = None, topic: str = "", **trigger):
    """Starts a feed: good rows go to table (each key once), others to dead_letters with value, reason, topic and time.

    ledger: where each row's key, status and reason go, by batch. after: called with the rows that the batch has stored,
    and its name, to bring what hangs on them up to date."""
    spark = source.sparkSession
    good = parse(source).drop("value", "reason")
    stored = KeyedTable(spark, table, good.schema, key)

    def batch(rows: DataFrame, number: int) -> None:
        rows, name = rows.persist(), batch_name(spark, checkpoint, number)
        try:
            told, fresh = merge_batch(rows.where("reason is null").drop("value", "reason"), stored, order, name, compared)
            if ledger:
                told.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/batch={name}")
            dead = rows.where("reason is not null").select("value", "reason", F.lit(topic).alias("original_topic"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("dead_lettered_at"))
            dead.write.mode("overwrite").parquet(f"{dead_letters.rstrip('/')}/batch={name}")
            if after:
                after(fresh, name)
            drop(told)
        finally:
            rows.unpersist()

    return parse(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def usage_feed(source: DataFrame, table: str, dead_letters: str, checkpoint: str, ledger: str | None = None, topic: str = "", **trigger):
    values = [*M.BASE_TOKENS, "estimated_cost_usd"]
    return run_stream(source, lambda s: parsed_usage(s).drop("status"), ["client_id", "source_database_id", "source_record_id"], ["arrival_seq", "reported_at"], table, dead_letters, checkpoint, None, values, ledger, topic, **trigger)


def event_feed(source: DataFrame, table: str, dead_letters: str, checkpoint: str, after=None, ledger: str | None = None, topic: str = "", **trigger):
    return run_stream(source, parsed_events, ["observation_key"], ["delivery_id"], table, dead_letters, checkpoint, after, (), ledger, topic, **trigger)


def delivery_feed(source: DataFrame, table: str, dead_letters: str, checkpoint: str, ledger: str | None = None, **trigger):
    return run_stream(source, parsed_deliveries, ["provider", "delivery_id"], ["occurred_at"], table, dead_letters, checkpoint, None, ["event_type", "payload"], ledger, **trigger)


def binding_feed(source: DataFrame, table: str, dead_letters: str, checkpoint: str, ledger: str | None = None, **trigger):
    """Execution bindings: a job is bound once; the same again is a duplicate, anything else a conflict."""
    values = ["job_template_id", "external_session_id", "provider", "repository", "resource_type", "resource_number", "outcome", "source_event_id", "branch", "title", "started_at", "finished_at", "failure_reason"]
    return run_stream(source, parsed_bindings, ["job_id"], ["started_at"], table, dead_letters, checkpoint, None, values, ledger, **trigger)


def resource_states(spark: SparkSession, path: str, buckets: int = 64) -> Snapshot:
    state = ("provider string, repository string, resource_type string, number string, parts map<string,struct<value:string,occurred_at:timestamp,delivery_id:string>>, "
             "last_occurred_at timestamp, last_delivery_id string, deliveries long")
    return Snapshot(spark, path, state, G.RESOURCE, buckets)


def reporting_refresh(spark: SparkSession, path: str, buckets: int = 64):
    """An `after` step of the delivery feed: merges a batch's deliveries into the stored state of their resources.

    A batch that comes again would count its deliveries twice, so its name is kept with the state that it went into."""
    stored = resource_states(spark, path, buckets)

    def after(fresh: DataFrame, batch: str) -> None:
        if not stored.has_batch(batch):
            stored.upsert(stage(G.forward_state(fresh.where("repository is not null")), "state"), G.merge_into, batch)

    return after


def reporting_state(spark: SparkSession, path: str) -> DataFrame:
    """The resources' merged payloads, with who wrote each key."""
    return G.rendered(resource_states(spark, path).read())


class ClosureHistory:
    """Facts by issue and by change request, which issue is named by whom, and the current episodes: all a batch needs to bring episodes up to date.

    A batch's facts are dealt out once, on arrival. What is read for it are the rows of the issues that it touches (their
    own, and those of change requests that ever named them); of the episodes, the hash buckets of these issues."""

    FACT = "provider string, delivery_id string, repository string, entity_type string, external_id string, event_type string, occurred_at timestamp, actor string, observed_via string, links array<string>, mentions array<string>, observation_key string"
    EPISODE = "repository string, issue_id string, segment long, opened_at timestamp, closed_at timestamp, status string, cr_id string, found string, candidates string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        path = path.rstrip("/")
        self.facts = {kind: KeyedTable(spark, f"{path}/{kind}", self.FACT, ["repository", "external_id"]) for kind in ("issue", "change_request")}
        self.named = KeyedTable(spark, f"{path}/named", "issue_repository string, issue_id string, repository string, external_id string", ["issue_repository", "issue_id"])
        self.episodes = Snapshot(spark, f"{path}/episodes", self.EPISODE, E.ISSUE, buckets)

    def add(self, fresh: DataFrame, batch: str) -> None:
        """Deals out new facts and recomputes the episodes of the issues that they touch."""
        for kind, table in self.facts.items():
            table.append(fresh.where(F.col("entity_type") == kind), batch)
        self.named.append(E.naming(fresh), batch)
        issues = stage(self.touched(fresh), "issues")
        found = stage(E.episodes(self.facts_of(issues)).join(issues, E.ISSUE, "left_semi"), "episodes")
        self.episodes.replace(issues, found)
        drop(issues, found)

    def touched(self, fresh: DataFrame) -> DataFrame:
        """The issues of new facts, and all that a change request among them ever named."""
        crs = fresh.where("entity_type = 'change_request'").select("repository", "external_id").distinct()
        return E.affected(fresh, self.facts["change_request"].lookup(crs))

    def facts_of(self, issues: DataFrame) -> DataFrame:
        own = self.facts["issue"].lookup(issues.select("repository", F.col("issue_id").alias("external_id")))
        crs = self.named.lookup(issues.select(F.col("repository").alias("issue_repository"), "issue_id")).select("repository", "external_id").distinct()
        return own.unionByName(self.facts["change_request"].lookup(crs))

    def compact(self) -> None:
        for table in (*self.facts.values(), self.named):
            table.compact()


def closure_refresh(spark: SparkSession, history: str):
    """An `after` step of the event feed: brings the episodes at history up to date. `current_episodes` reads them."""
    return ClosureHistory(spark, history).add


def current_episodes(spark: SparkSession, history: str) -> DataFrame:
    return ClosureHistory(spark, history).episodes.read()


def expired(dead: DataFrame, now, max_age_days: int) -> DataFrame:
    """Dead letters that are older than the limit, with a key to find them by after escalation."""
    rows = dead.where(C.dead_letter_class(F.col("dead_lettered_at"), now, max_age_days) == "expired")
    return rows.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(dead.columns))), 256))


def sweep(dead: DataFrame, now, max_age_days: int, escalated: str) -> None:
    """Appends the dead letters that have expired to the escalated ones, each once."""
    old = expired(dead, now, max_age_days)
    old.join(_stored(dead.sparkSession, escalated, old.schema).select("key"), "key", "left_anti").select(*old.columns).dropDuplicates(["key"]).write.mode("append").parquet(escalated)
