"""What may leave as telemetry: allow-lists for attributes, routes, names and messages, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes by kind of value, methods, route segments, metric labels and messages.
STRING_ATTRIBUTES = ("gen_ai.operation.name", "gen_ai.provider.name", "gen_ai.request.model", "gen_ai.response.model", "error.type", "http.scheme", "url.scheme")
METHOD_ATTRIBUTES = ("http.request.method", "http.method")
NUMBER_ATTRIBUTES = ("http.response.status_code", "http.status_code", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.usage.cached_tokens", "gen_ai.tool_calls.count")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
METRIC_ATTRIBUTES = ("operation", "operation_type", "provider", "model", "scope", "status", "budget", "source", "type", "state", "phase", "outcome", "mode", "result", "signal")
ROUTE_SEGMENTS = (
    "v1 v2 default banks documents operations mental-models entities memories retain recall reflect stats config profile mission "
    "strategies observations consolidate health version metrics dry-run import export sync tags batch list search {id}"
).split()
EVENTS = (("failed", "operation failed"), ("error", "runtime error"), ("consolidat", "consolidation event"), ("extract", "extraction event"), ("completed", "operation completed"), ("worker", "worker event"), ("started", "runtime started"), ("shutdown", "runtime stopping"))
_WORD = r"\A[A-Za-z0-9_.:/-]{1,120}\z"
TOKEN_BUCKETS = ("0-100", "100-500", "500-1k", "1k-5k", "5k-10k", "10k-50k", "50k+")


def safe_route(route: Column) -> Column:
    """A route with its identifiers hidden, if all of its segments are known; else ``/other``."""
    plain = F.regexp_replace(F.substring_index(route, "?", 1), r"/(banks|documents|operations|mental-models|entities)/[^/]+", "/$1/{id}")
    known = F.forall(F.filter(F.split(plain, "/"), lambda s: s != ""), lambda s: s.isin(*ROUTE_SEGMENTS))
    return F.when(route.isNull(), F.lit(None).cast("string")).when((F.length(plain) <= 200) & known, plain).otherwise("/other")


def _entries(attributes: Column, keep) -> Column:
    """Map entries for which ``keep(key, value)`` gives a value."""
    pairs = F.transform(F.map_entries(attributes), lambda e: F.struct(e["key"].alias("key"), keep(e["key"], e["value"]).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def _safe(key: Column, value: Column, strings: Sequence[str]) -> Column:
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return (
        F.when(key.isin(*NUMBER_ATTRIBUTES), F.when(finite, value))
        .when(key.isin(*METHOD_ATTRIBUTES), F.when(value.isin(*METHODS), value))
        .when(key.isin(*strings), F.when(F.rlike(value, F.lit(_WORD)), value))
        .when(key == "http.route", safe_route(value))
    )


def safe_attributes(attributes: Column, more: Sequence[str] = ()) -> Column:
    """Entries of a map<string,string> that a span may show; ``more`` are further string attributes."""
    return _entries(attributes, lambda k, v: _safe(k, v, [*STRING_ATTRIBUTES, *more]))


def safe_metric_attributes(attributes: Column, more: Sequence[str] = ()) -> Column:
    """The same for metrics, which have labels of their own."""

    def keep(k: Column, v: Column) -> Column:
        own = (
            F.when(k == "method", F.when(v.isin(*METHODS), v))
            .when(k.isin(*METRIC_ATTRIBUTES), F.when(F.rlike(v, F.lit(_WORD)), v))
            .when(k.isin("http.target", "endpoint", "route"), safe_route(v))
            .when(k == "success", F.when(v.isin("true", "false"), v))
            .when(k == "token_bucket", F.when(v.isin(*TOKEN_BUCKETS), v))
            .when(k == "status_code", F.when(F.rlike(v, F.lit(r"\A[1-5][0-9]{2}\z")), v))
            .when(k == "status_class", F.when(F.rlike(v, F.lit(r"\A[1-5]xx\z")), v))
            .when(k == "max_tokens", F.when(F.rlike(v, F.lit(r"\A[0-9]{1,6}\z")), v))
        )
        return F.coalesce(own, _safe(k, v, [*STRING_ATTRIBUTES, *more]))

    return _entries(attributes, keep)


def safe_name(name: Column, prefix: str = "loomtrace") -> Column:
    """A span's name: a method with its route, a name of our own, or a general one."""
    method = F.substring_index(name, " ", 1)
    route = F.substring(name, F.length(method) + 2, F.length(name))
    own = F.rlike(name, F.lit(rf"\A{prefix}\.[a-z_]+\z"))
    return F.when(name.contains(" ") & method.isin("GET", "POST", "PUT", "PATCH", "DELETE"), F.concat_ws(" ", method, safe_route(route))).when(own, name).otherwise(f"{prefix}.operation")


def event_of(message: Column) -> Column:
    """The kind of a log message; free text never leaves."""
    text, out = F.lower(message), None
    for part, kind in EVENTS:
        out = (F if out is None else out).when(text.contains(part), kind)
    return out.otherwise("runtime event")


def exported(spans, attributes: str = "attributes", name: str = "name", message: str | None = None):
    """Spans as they may be exported: names, attributes and messages through the allow-lists, nothing else but ids, times and outcome."""
    free = [c for c in ("trace_id", "span_id", "parent_id", "started_at", "ended_at", "outcome") if c in spans.columns]
    return spans.select(*free, safe_name(F.col(name)).alias("name"), safe_attributes(F.col(attributes)).alias("attributes"), *([event_of(F.col(message)).alias("event")] if message else []))
