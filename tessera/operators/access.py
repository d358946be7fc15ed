"""Who may see or do what, and predicates over logs and JSON columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sensitive keys of logged metadata.
SENSITIVE = ("api_key", "authorization", "cookie", "password", "prompt", "query", "secret", "session", "token")
#: Patterns of secrets in messages, and the message's most characters.
SECRETS = r"sk-ant-[A-Za-z0-9_-]{8,}|sk-[A-Za-z0-9_-]{8,}|AIza[0-9A-Za-z_-]{20,}"
NAMED_SECRETS = r"""(?i)(api[_-]?key|authorization|bearer)(["'\s:=]+)([A-Za-z0-9_\-]{40,})"""
MESSAGE_CHARS = 500
#: Kinds of errors and the texts that tell them, in order; the first that fits wins.
ERROR_KINDS = (
    ("auth_failed", ("401", "unauthor", "invalid api key", "invalid_api_key")),
    ("rate_limited", ("429", "rate", "quota")),
    ("timeout", ("timeout", "timed out")),
    ("unreachable", ("connection", "network", "unreachable", "dns")),
    ("misconfigured", ("not configured", "client not connected", "invalid url", "missing", "misconfigured")),
)


def prefixed(column: str, prefix: str) -> Column:
    """Whether a name begins with the text, in any case."""
    return F.startswith(F.lower(F.col(column)), F.lit(prefix.lower()))


def status_family(column: str, family: str) -> Column:
    """Whether a status code is of a family such as ``5xx``."""
    low = int(family[0]) * 100
    return (F.col(column) >= low) & (F.col(column) < low + 100)


def access_filter(equals: Mapping[str, Any] | None = None, path: str | None = None, status: str | None = None, actions: Sequence[str] | None = None) -> Column:
    """One predicate over an access log; methods are compared in upper case, and what isn't given doesn't restrict."""
    keep = F.lit(True)
    for name, value in (equals or {}).items():
        if value is not None:
            keep = keep & (F.col(name) == F.lit(value.upper() if name == "method" else value))
    if path is not None:
        keep = keep & F.contains(F.lower(F.col("path")), F.lit(path.lower()))
    if status is not None:
        keep = keep & status_family("status_code", status)
    if actions is not None:
        keep = keep & F.col("action").isin(*actions)
    return keep


def json_text(column: str, path: str) -> Column:
    """Text at a JSON path; null where there is none."""
    return F.get_json_object(F.col(column), path)


def json_has(column: str, key: str) -> Column:
    """Whether a JSON object has the key, its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.col(column)), key), F.lit(False))


def tenant_visible(field: str, tenant: str | None, everyone: bool = False) -> Column:
    """Whether a row belongs to the tenant; all rows for an administrator of everyone, none without a tenant."""
    return F.lit(True) if everyone else F.lit(False) if tenant is None else F.coalesce(F.col(field) == tenant, F.lit(False))


def with_tenant(rows: DataFrame, field: str, tenant: str | None, everyone: bool = False) -> DataFrame:
    """Rows as they may be written: a tenant's key forces its field; an administrator of everyone must have filled it (else ``error``); others may not write."""
    if tenant is not None:
        return rows.withColumn(field, F.lit(tenant)).withColumn("error", F.lit(None).cast("string"))
    if not everyone:
        return rows.withColumn("error", F.lit("denied"))
    return rows.withColumn("error", F.when(F.coalesce(F.col(field), F.lit("")) == "", "required"))


def pinned(rows: DataFrame, collection: str, pin: str | None) -> DataFrame:
    """Rows of the pinned collection; others look absent."""
    return rows if pin is None else rows.where(F.col(collection) == pin)


def hook_matches(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Rows (event_id, hook_id): active hooks that ask for the event and for its collection, or for all.

    events: event_id, event, collection; hooks: hook_id, events, collections (null
    for all), active. The join is by event name.
    """
    asked = hooks.where("active").select("hook_id", "collections", F.explode(F.array_distinct("events")).alias("event"))
    found = events.join(asked, "event").where(F.col("collections").isNull() | F.array_contains("collections", F.col("collection")))
    return found.select("event_id", "hook_id")


def scope_allows(granted: Column, required: Column) -> Column:
    """Whether one of the granted ``resource:action`` scopes covers the required one; ``*`` covers all, and no grants allow everything."""
    resource = lambda s: F.split_part(s, F.lit(":"), F.lit(1))
    action = lambda s: F.substring(s, F.instr(s, ":") + 1, F.length(s))

    def covers(g: Column) -> Column:
        whole = (F.instr(g, ":") > 1) & (F.instr(g, ":") < F.length(g))
        return whole & ((resource(g) == "*") | (resource(g) == resource(required))) & ((action(g) == "*") | (action(g) == action(required)))

    return F.coalesce(F.size(granted) == 0, F.lit(True)) | F.coalesce(F.exists(granted, covers), F.lit(False))


def keeps_one(rows: DataFrame, role: str, guarded: str) -> DataFrame:
    """Rows that may be removed: all but those of the guarded role, unless there are several of it."""
    several = rows.agg((F.count_if(F.col(role) == guarded) > 1).alias("several"))
    # One row.
    return rows.crossJoin(F.broadcast(several)).where((F.col(role) != guarded) | F.col("several")).drop("several")


def scrubbed(message: Column) -> Column:
    """A message without secrets, cut to its most characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(message, SECRETS, "[REDACTED]"), NAMED_SECRETS, "$1$2[REDACTED]"), 1, MESSAGE_CHARS)


def error_kind(message: Column) -> Column:
    """Kind of an error by its text, once secrets are out of it: a key's digits aren't a status."""
    low, found = F.lower(scrubbed(message)), F.lit("unknown")
    for kind, tokens in reversed(ERROR_KINDS):
        some = F.lit(False)
        for t in tokens:
            some = some | F.contains(low, F.lit(t))
        found = F.when(some, kind).otherwise(found)
    return found


def redacted(entries: Column, most: int = 32, chars: int = 300) -> Column:
    """A map of texts as it may be logged: the first ``most`` entries, sensitive ones hidden, long values cut."""
    first = F.slice(F.map_entries(entries), 1, most)
    safe = lambda e: F.when(F.lower(e["key"]).isin(*SENSITIVE), "[REDACTED]").when(F.length(e["value"]) > chars, F.concat(F.substring(e["value"], 1, chars), F.lit("..."))).otherwise(e["value"])
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.substring(e["key"], 1, 80).alias("key"), safe(e).alias("value"))))


#: JSON kinds of a metadata schema and how a value's text must look.
_KINDS = {"string": r'^"', "integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$", "boolean": r"^(true|false)$", "object": r"^\{", "array": r"^\["}


def metadata_error(column: str, schema: Mapping[str, Any]) -> Column:
    """The first rule of a metadata schema that a JSON object breaks, as ``field:rule``; null if it is valid.

    Required fields come first, then each property's type, enum, pattern, lengths and bounds.
    """
    if schema.get("type", "object") != "object":
        raise ValueError("the schema's top type must be object")
    rules: list[Column] = [F.when(~json_has(column, key), F.lit(f"{key}:required")) for key in schema.get("required", [])]
    for key, spec in schema.get("properties", {}).items():
        raw = F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "variant")
        shown, text, number = F.to_json(raw), json_text(column, f"$.{key}"), F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "double")
        has, is_text = json_has(column, key), F.startswith(shown, F.lit('"'))
        checks = []
        if "type" in spec:
            checks.append(("type", ~F.regexp_like(shown, F.lit(_KINDS[spec["type"]]))))
        if "enum" in spec:
            checks.append(("enum", ~text.isin(*[str(v) for v in spec["enum"]])))
        if "pattern" in spec:
            checks.append(("pattern", is_text & ~F.regexp_like(text, F.lit(f"^(?:{spec['pattern']})$"))))
        if "minLength" in spec:
            checks.append(("minLength", is_text & (F.length(text) < spec["minLength"])))
        if "maxLength" in spec:
            checks.append(("maxLength", is_text & (F.length(text) > spec["maxLength"])))
        plain = ~is_text & ~shown.isin("true", "false")
        if "minimum" in spec:
            checks.append(("minimum", plain & (number < spec["minimum"])))
        if "maximum" in spec:
            checks.append(("maximum", plain & (number > spec["maximum"])))
        rules += [F.when(has & F.coalesce(bad, F.lit(rule == "type")), F.lit(f"{key}:{rule}")) for rule, bad in checks]
    return F.coalesce(*rules, F.lit(None).cast("string"))
