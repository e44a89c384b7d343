"""Column functions of the usage model: labels, states, buckets, normalised fields. All are built-in expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TIME_MS = 1 << 62
UNKNOWN = "unknown"
#: Substrings of model names and their vendors, in order of priority.
VENDORS = (
    ("OpenAI", ("gpt", "o1", "o3", "o4", "davinci")), ("Anthropic", ("claude", "haiku", "sonnet", "opus")),
    ("Google", ("gemini", "gemma")), ("Meta/Mistral", ("llama", "mistral", "mixtral")), ("DeepSeek", ("deepseek",)),
    ("Cohere", ("command", "cohere")), ("xAI", ("grok",)),
)


def blank_to_null(c: Column) -> Column:
    """White text is null; other text stays as it is."""
    return F.when(F.trim(c) != "", c)


def without_suffix(c: Column) -> Column:
    """A label without its trailing -<digits>; empty is null."""
    return F.nullif(F.regexp_replace(c, r"-\d+$", ""), F.lit(""))


def project_label(display_name: Column, name: Column, worktree: Column, project_id: Column) -> Column:
    """First of display name, name, last part of the work tree, id; ids over 12 characters are cut, others lose their suffix."""
    folder = F.when(worktree.isNotNull() & ~worktree.isin("", "/"), without_suffix(F.regexp_extract(worktree, r"([^/]+)$", 1)))
    short = F.when(F.length(project_id) > 12, F.concat(F.substring(project_id, 1, 12), F.lit("…"))).otherwise(without_suffix(project_id))
    return F.coalesce(without_suffix(display_name), without_suffix(name), folder, short, F.lit(UNKNOWN))


def run_status(last_message_at: Column, message_count: Column, parent: Column, now: datetime,
               quiet_minutes: int = 15, stale_hours: int = 2, unknown_hours: int = 48) -> Column:
    """State of a run at one fixed time; the limits are strict, so an age of exactly 15 minutes is no longer running."""
    t = F.lit(now).cast("timestamp")
    later = lambda n, unit: last_message_at > t - F.expr(f"INTERVAL {n} {unit}")
    return (F.when((message_count == 0) | last_message_at.isNull(), UNKNOWN)
            .when(later(quiet_minutes, "MINUTES"), "running")
            .when(later(stale_hours, "HOURS") & parent.isNull(), "completed")
            .when(later(stale_hours, "HOURS"), "blocked")
            .when(later(unknown_hours, "HOURS"), "stale").otherwise(UNKNOWN))


def derived_title(agent: Column, external_id: Column) -> Column:
    cut = F.substring(external_id, 1, 12)
    return F.when(agent.isNotNull() & external_id.isNotNull(), F.concat(agent, F.lit(" — "), cut)).otherwise(F.coalesce(agent, cut))


def cache_hit_ratio(cache_read: Column, input_tokens: Column) -> Column:
    """Four digits, on decimals; null where there is nothing to divide by."""
    total = input_tokens + cache_read
    return F.when(total > 0, F.round(cache_read.cast("decimal(20,0)") / total.cast("decimal(20,0)"), 4))


def provider_key(provider: Column) -> Column:
    return F.coalesce(F.nullif(provider, F.lit("")), F.lit(UNKNOWN))


def cached_tokens(cache_read: Column, cache_write: Column, wire: Column) -> Column:
    return F.when(cache_read.isNotNull() & cache_write.isNotNull(), cache_read + cache_write).otherwise(wire)


def time_of(tz: Column, ms: Column) -> Column:
    """A time given as such, else as milliseconds."""
    return F.coalesce(tz, F.timestamp_millis(ms))


def bucket(ts: Column, unit: str) -> Column:
    """Start of the day, week (Monday) or month as text with its offset."""
    return F.date_format(F.date_trunc(unit, ts), "yyyy-MM-dd HH:mm:ssx")


def model_display(json: Column) -> Column:
    """{providerID, id} as "provider / id"; whichever is there; other text as it is."""
    provider, model = F.get_json_object(json, "$.providerID"), F.get_json_object(json, "$.id")
    both = F.nullif(F.concat_ws(" / ", F.nullif(provider, F.lit("")), F.nullif(model, F.lit(""))), F.lit(""))
    return F.coalesce(both, json)


def vendor(model: Column) -> Column:
    low, out = F.lower(model), None
    for name, parts in VENDORS:
        hit = low.rlike("|".join(parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def repository(url: Column) -> Column:
    """host[:port]/path of an http(s) address: lower-case host, no default port, no .git, no outer slashes; else null."""
    part = lambda k: F.regexp_extract(F.trim(url), r"^(?i)(https?)://(?:[^/@?#]*@)?([^/:?#]+)(?::(\d+))?([^?#]*)", k)
    scheme, host, port = F.lower(part(1)), F.lower(part(2)), part(3)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(part(4), r"/+$", ""), r"\.git$", ""), r"^/+|/+$", "")
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when((host != "") & (path != ""), F.concat(host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), F.lit("/"), path))


def resource_type(kind: Column) -> Column:
    return F.when(kind == "issue", "issue").when(kind.isin("pull_request", "merge_request", "change_request"), "change_request")


def observation_key(provider: Column, repo: Column, entity_type: Column, external_id: Column, event_type: Column, occurred_at: Column) -> Column:
    """sha256 of the identity as sorted, compact JSON. Full seconds have no fraction."""
    micros = F.unix_micros(occurred_at) % 1000000
    text = F.concat(F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == 0, "").otherwise(F.date_format(occurred_at, ".SSSSSS")), F.lit("+00:00"))
    body = F.to_json(F.struct(entity_type.alias("entity_type"), event_type.alias("event_type"), external_id.alias("external_id"),
                              text.alias("occurred_at"), provider.alias("provider"), repo.alias("repository")))
    return F.sha2(body, 256)


def split_entity(entity_id: Column) -> tuple[Column, Column]:
    """type and external id, at the first colon."""
    at = F.instr(entity_id, ":")
    return F.substring(entity_id, F.lit(1), at - 1), F.substring(entity_id, at + 1, F.length(entity_id))


def dead_letter_class(dead_lettered_at: Column, now: datetime, max_age_days: int) -> Column:
    """expired where older than the limit; what can't be read is kept."""
    age = F.lit(now).cast("timestamp") - F.try_to_timestamp(dead_lettered_at)
    return F.when(age > F.expr(f"INTERVAL {max_age_days} DAYS"), "expired").otherwise("retain")


def health(last_seen: Column, now: datetime, limit_seconds: int = 300) -> Column:
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(last_seen)
    return F.when(last_seen.isNull(), UNKNOWN).when(age <= limit_seconds * 1_000_000, "healthy").otherwise("stale")


def cursor(ms: Column, row_id: Column) -> Column:
    """Page cursor: base64url of ms:id, with a late time for none."""
    text = F.concat(F.coalesce(ms, F.lit(NO_TIME_MS)).cast("string"), F.lit(":"), row_id)
    return F.translate(F.base64(text.cast("binary")), "+/", "-_")


def read_cursor(c: Column) -> tuple[Column, Column]:
    text = F.unbase64(F.translate(c, "-_", "+/")).cast("string")
    at = F.instr(text, ":")
    return F.substring(text, F.lit(1), at - 1).cast("long"), F.substring(text, at + 1, F.length(text))


def crockford(seed: Column) -> Column:
    """Deterministic 16-character ending of an id: the first ten bytes of sha256, in Crockford's base 32."""
    hexa = F.substring(F.sha2(seed, 256), 1, 20)
    half = lambda a: F.lpad(F.conv(F.substring(hexa, a, 10), 16, 32), 8, "0")
    return F.translate(F.lower(F.concat(half(1), half(11))), "0123456789abcdefghijklmnopqrstuv", "0123456789ABCDEFGHJKMNPQRSTVWXYZ")


def ulid(ms: Column, seed: Column) -> Column:
    head = F.translate(F.lower(F.lpad(F.conv(ms.cast("string"), 10, 32), 10, "0")), "0123456789abcdefghijklmnopqrstuv", "0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    return F.concat(head, crockford(seed))


def explorer_url(base: str, **fields: Column) -> Column:
    """Link to the log explorer: the fields as compact JSON, percent-encoded."""
    return F.concat(F.lit(base + "?q="), F.url_encode(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))))


def entity_display(entity_type: Column, external_id: Column) -> Column:
    return F.concat(entity_type, F.lit(":"), external_id)


def provisional(role: Column) -> Column:
    """A link that isn't resolved may still change."""
    return ~F.coalesce(role == "resolved", F.lit(False))


def project_name(name: Column, worktree: Column) -> Column:
    """A project's name, else the last part of its work tree (either slash)."""
    return F.when(name.isNull() & worktree.isNotNull() & ~worktree.isin("", "/"), F.regexp_replace(worktree, r"^.*[\\/]", "")).otherwise(name)


def canonical_json(*columns: Column) -> Column:
    """{"data": ..., "schema_version": 1} with the given (alphabetical) fields; times as UTC with Z, with microseconds where they have any."""
    text = F.to_json(F.struct(F.struct(*columns).alias("data"), F.lit(1).alias("schema_version")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})
    return F.regexp_replace(text, r'(?<=T\d\d:\d\d:\d\d)\.000000Z"', 'Z"')
