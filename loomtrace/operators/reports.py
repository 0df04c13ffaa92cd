"""Inventory, pilot selection, verification, cleanup and repair plans, health."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import EPOCH, SOURCES
from .state import SESSION_KEY, unrecorded


def inventory(results: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Counts and sums of each source and in total (source null), zeros for sources without sessions.

    ``results(source, status, source_bytes, canonical_bytes, canonical_turns, redactions)``.
    """
    names = {"eligible": "eligible", "empty": "empty_after_normalization", "subagents": "excluded_subagent", "configured": "excluded_configured", "ambiguous": "ambiguous", "malformed": "malformed", "too_large": "too_large", "errors": "error"}
    loaded = F.col("status").isin("eligible", "empty_after_normalization", "too_large")
    sums = [F.coalesce(F.sum(F.when(loaded, F.col(c))), F.lit(0)).alias(c) for c in ("source_bytes", "canonical_bytes", "canonical_turns", "redactions")]
    each = results.rollup("source").agg(F.grouping_id().alias("total"), F.count("*").alias("discovered"), *[F.count_if(F.col("status") == s).alias(n) for n, s in names.items()], *sums)
    spine = results.sparkSession.createDataFrame([(s, int(s is None)) for s in [*sources, None]], "source string, total int")
    found = spine.source.eqNullSafe(each.source) & (spine.total == each.total)  # a session without a source counts in the total alone
    return spine.join(each, found, "left").select(spine.source, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in each.columns[2:]])


def sizes_once(rows: DataFrame, path: str, size: str, order: str) -> Column:
    """Size of a file on its first row only."""
    return F.when(F.row_number().over(Window.partitionBy(path).orderBy(order)) == 1, F.col(size)).otherwise(0)


def gaps(references: DataFrame) -> DataFrame:
    """Sessions whose identifier or start time had to be made up."""
    return references.agg(F.count_if(F.col("native_session_id").startswith("fallback-")).alias("missing_identifiers"), F.count_if(F.col("started_at").isNull() | (F.col("started_at") == EPOCH)).alias("missing_timestamps"))


def largest(results: DataFrame, n: int = 20) -> DataFrame:
    return results.where("canonical_bytes is not null").orderBy(F.desc("canonical_bytes"), "source", "native_session_id").limit(n)


def pilot(results: DataFrame, count: int = 200, include_largest: bool = False, sources: Sequence[str] = SOURCES, max_bytes: int | None = None) -> DataFrame:
    """A sample of ``count`` sessions with its order ``pick``: the smallest of each source, optionally the
    largest, then deciles in turn, then the rest one source after the other.

    Ranks are per source; only picked positions (at most ``count`` a source) go on.
    """
    rows = results.where("canonical_bytes is not null")
    if max_bytes is not None:
        rows = rows.where(F.col("canonical_bytes") <= max_bytes)
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    by = Window.partitionBy("source").orderBy("canonical_bytes", "native_session_id")
    rows = rows.withColumn("s", rank).where("s > 0").withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy("source")))
    present = rows.select("s").distinct().count()
    extremes = include_largest and count >= 2 * present
    steps = 9 if include_largest else 10
    early = [F.struct(F.lit(0).alias("phase"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("at"))]
    if extremes:
        early.append(F.struct(F.lit(1).alias("phase"), F.lit(0).alias("k"), (F.col("n") - 1).alias("at")))
    early += [F.struct(F.lit(2).alias("phase"), F.lit(d).alias("k"), F.floor((F.col("n") - 1) * d / steps).alias("at")) for d in range(10)]
    first = F.array_min(F.transform(F.filter(F.array(*early), lambda e: e["at"] == F.col("i")), lambda e: F.struct(e["phase"], e["k"])))
    marked = rows.withColumn("e", first)
    chosen = marked.where("e is not null").select(*results.columns, "s", F.col("e.phase").alias("phase"), F.col("e.k").alias("k"))
    rest = marked.where("e is null").withColumn("k", F.row_number().over(by)).where(F.col("k") <= count).select(*results.columns, "s", F.lit(3).alias("phase"), "k")
    ordered = chosen.unionByName(rest).orderBy("phase", "k", "s").limit(count)
    return ordered.withColumn("pick", F.row_number().over(Window.orderBy("phase", "k", "s"))).drop("phase", "k", "s")


def pilot_totals(picked: DataFrame, times: int = 2) -> DataFrame:
    """One row: sessions of a pilot, their bytes, and the input tokens of ``times`` readings."""
    tokens = F.ceil(F.col("canonical_bytes") / 4) * times
    return picked.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("canonical_bytes"), F.lit(0)).cast("bigint").alias("canonical_bytes"), F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("estimated_tokens"))


def imported_documents(sessions: DataFrame, generations: DataFrame) -> DataFrame:
    """How many documents have a completed generation."""
    done = generations.where("state = 'completed'").select(*SESSION_KEY).distinct()
    return sessions.join(done, list(SESSION_KEY), "left_semi").agg(F.countDistinct("document_id").alias("documents"))


#: Outcomes of a scan, in the order in which they are reported.
OUTCOMES = ("queued", "unchanged", "active", "empty", "error", "source_missing", "excluded", "configured", "ambiguous")


def scan_counts(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row: sessions discovered and of each outcome; a missing source was not discovered."""
    return outcomes.agg(F.count_if(F.col(outcome) != "source_missing").alias("discovered"), *[F.count_if(F.col(outcome) == o).alias(o) for o in OUTCOMES])


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    """One row: artifacts by classification."""
    kinds = {"subagents": "subagent", "configured": "configured-exclusion", "ambiguous": "ambiguous", "primary": "primary"}
    return artifacts.agg(F.count("*").alias("artifacts"), *[F.count_if(F.col("classification") == k).alias(n) for n, k in kinds.items()])


def health_counts(errors: DataFrame, candidates: DataFrame, sessions: DataFrame, artifacts: DataFrame, sources: DataFrame, generations: DataFrame, policy: str, stale_before: str) -> DataFrame:
    """``name``, ``n``: scan errors, deferred sessions, unprocessed ones, stale sources and uncertain operations.

    Unprocessed are primary sessions whose current hash is not acknowledged under the
    policy, and those that artifacts name and the state does not know.
    """
    current = (F.col("acknowledged_hash") == F.col("canonical_hash")) & (F.col("acknowledged_policy") == policy)
    open_ = sessions.where((F.col("classification") == "primary") & ~F.col("status").isin("empty_after_normalization", "source_missing") & (F.col("canonical_bytes") > 0) & ~F.coalesce(current, F.lit(False)))
    parts = {
        "scan_errors": errors, "deferred": candidates, "stale_sources": sources.where(F.col("enabled") & (F.col("last_scan_completed_at").isNull() | (F.col("last_scan_completed_at") < stale_before))),
        "uncertain": generations.where("state in ('submitted', 'processing') and error is not null"),
    }
    rows = open_.select(F.lit("unprocessed").alias("name")).unionByName(unrecorded(artifacts, sessions).select(F.lit("unprocessed").alias("name")))
    for name, part in parts.items():
        rows = rows.unionByName(part.select(F.lit(name).alias("name")))
    names = rows.sparkSession.createDataFrame([(n,) for n in ("unprocessed", *parts)], "name string")
    return names.join(rows.groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


LISTS = {"artifacts": ("source", "native_session_id", "locator"), "sessions": ("source", "native_session_id"), "jobs": ("created_at", "job_id"), "generations": ("queued_at",)}


def listed(table: DataFrame, name: str) -> DataFrame:
    """A state table in the order in which it is listed, made definite by its other columns."""
    order = LISTS[name]
    return table.orderBy(*order, *[c for c in table.columns if c not in order])


def discovery_order(references: DataFrame, started: str = "started_at") -> list[Column]:
    """Start time, those without one last, then source and session (by bytes)."""
    return [F.asc_nulls_last(started), F.col("source"), F.col("native_session_id")]


def discovery_page(references: DataFrame, offset: int = 0, limit: int | None = None, sources: Sequence[str] | None = None, ids: Sequence[str] | None = None, started: str = "started_at") -> DataFrame:
    """References of a scan: chosen sources and sessions, in order, from an offset on."""
    if sources is not None:
        references = references.where(F.col("source").isin(*sources))
    if ids is not None:
        references = references.where(F.col("native_session_id").isin(*ids))
    page = references.orderBy(*discovery_order(references, started)).offset(offset)
    return page if limit is None else page.limit(limit)


def owner_conflicts(references: DataFrame, origin: str = "origin") -> DataFrame:
    """Sessions that more than one origin claims."""
    return references.groupBy(*SESSION_KEY).agg(F.countDistinct(origin).alias("origins")).where("origins > 1")


#: Characters of a report, at most.
REPORT_CHARS = 100 << 20


def write_report(rows: DataFrame, path: str) -> None:
    """A report as one JSON file, readable by its owner alone; it appears whole or not at all.

    Rows come from one partition after another and are never held together.  A report
    over ``REPORT_CHARS`` is refused: that is a table, to be written as one.
    """
    folder = os.path.dirname(os.path.abspath(path))
    handle, part = tempfile.mkstemp(dir=folder, prefix=".report-")
    try:
        with os.fdopen(handle, "w") as f:
            size = 0
            for k, line in enumerate(rows.toJSON().toLocalIterator()):
                size += len(line) + 2
                if size > REPORT_CHARS:
                    raise ValueError(f"a report of more than {REPORT_CHARS} characters")
                f.write((",\n" if k else "[") + line)
            f.write("]\n" if size else "[]\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def state_counts(generations: DataFrame, state: str = "state") -> DataFrame:
    return generations.groupBy(state).agg(F.count("*").alias("n"))


def bucket_counts(generations: DataFrame, state: str = "state") -> DataFrame:
    """One row: total and fixed buckets, everything else under ``other``."""
    fixed = ("completed", "queued", "submitted", "processing")
    return generations.agg(F.count("*").alias("total"), *[F.count_if(F.col(state) == s).alias(s) for s in fixed], F.count_if(~F.col(state).isin(*fixed) | F.col(state).isNull()).alias("other"))


def latest(generations: DataFrame, keys: Sequence[str] = SESSION_KEY, at: str = "queued_at", tie: str = "canonical_hash") -> DataFrame:
    """The last row of each key by time, then by ``tie``: a partial aggregate, rows of a key are never sorted."""
    rest = [c for c in generations.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")))
    return generations.groupBy(*keys).agg(last.alias("_last")).select(*[F.col("_last")[c].alias(c) if c in rest else F.col(c) for c in generations.columns])


def reconcile(local: DataFrame, remote: DataFrame, key: str, hash_: str) -> DataFrame:
    """Every key with ``verdict``: missing (only local), unexpected (only remote), mismatch or match.

    ``local`` has ``expected`` (should it be remote?) and ``excluded`` besides the key and hash.
    """
    left, right = local.select(key, "expected", "excluded", F.col(hash_).alias("lh")), remote.select(key, F.col(hash_).alias("rh"), F.lit(True).alias("there"))
    there, expected, excluded = (F.coalesce(F.col(c), F.lit(False)) for c in ("there", "expected", "excluded"))
    verdict = F.when(there & excluded, "excluded_present").when(there & ~expected, "unexpected").when(~there & expected, "missing").when(there & ~F.col("lh").eqNullSafe(F.col("rh")), "mismatch").when(there, "match").otherwise("absent")
    return left.join(right, key, "full_outer").select(key, verdict.alias("verdict"))


def readiness(facts: DataFrame) -> DataFrame:
    """Readiness booleans over one row of counters."""
    zero = lambda *names: F.forall(F.array(*[F.col(n) for n in names]), lambda x: x == 0)
    out = facts.withColumn("document_accounting_ready", zero("pending", "failed", "missing", "excluded_present", "unexpected", "mismatches"))
    out = out.withColumn("source_coverage_ready", zero("scan_errors", "deferred", "unprocessed", "stale_sources"))
    out = out.withColumn("remote_idle", zero("active_operations", "pending_consolidation", "failed_consolidation"))
    out = out.withColumn("idempotency_ready", F.col("document_accounting_ready") & F.col("remote_idle") & F.col("bank_ready"))
    out = out.withColumn("activation_ready", F.col("idempotency_ready") & F.col("source_coverage_ready") & F.col("auto_consolidation"))
    return out.withColumn("continuous_ready", F.col("activation_ready") & F.col("running") & ~F.col("paused") & F.col("last_error").isNull())


def cleanup_jobs(generations: DataFrame, sessions: DataFrame, groups: DataFrame, tombstones: DataFrame, artifacts: DataFrame, include_ambiguous: bool = False) -> DataFrame:
    """Generations whose session is not primary any more, with the job that removes each.

    ``groups(source, native_session_id, kind)``, ``artifacts(source, native_session_id, locator, kind)``.
    For Claude the artifact at the session's own place decides.
    """
    doc = F.coalesce("document_id", F.concat(F.lit("agent-session:"), F.col("source"), F.lit(":"), F.col("native_session_id")))
    s = sessions.select(*SESSION_KEY, "document_id", "locator", F.col("status").alias("session_status"))
    g = generations.where(~F.col("state").isin("excluded", "superseded")).join(s, list(SESSION_KEY), "left").withColumn("document_id", doc)
    g = g.join(groups.select(*SESSION_KEY, F.col("kind").alias("group_kind")), list(SESSION_KEY), "left")
    g = g.join(tombstones.select(*SESSION_KEY, "document_id").distinct().withColumn("buried", F.lit(True)), [*SESSION_KEY, "document_id"], "left")
    g = g.join(artifacts.select(*SESSION_KEY, "locator", F.col("kind").alias("own_kind")), [*SESSION_KEY, "locator"], "left")
    scoped = (F.col("source") == "claude") & F.col("group_kind").isNotNull() & F.col("session_status").isNotNull()
    kind = F.when(scoped, F.col("own_kind")).when(F.col("buried"), F.lit("configured-exclusion")).otherwise(F.col("group_kind"))
    kept = F.coalesce((F.col("session_status") == "ambiguous_preserved") & (F.col("kind") != "configured-exclusion"), F.lit(False)) | (F.col("kind") == "ambiguous")
    g = g.withColumn("kind", kind).where("kind is not null and kind <> 'primary'")
    g = g if include_ambiguous else g.where(~kept)
    job = F.sha2(F.concat_ws("\n", F.lit("subagent-cleanup-v1"), "kind", "source", "native_session_id", "canonical_hash"), 256)
    return g.select(job.alias("job_id"), "kind", *SESSION_KEY, "document_id", "canonical_hash", "operation_id")


def plan_hash(rows: DataFrame, *order: str) -> DataFrame:
    """SHA-256 of a plan: another one wherever a row changes, the same for any order of rows.

    Rows hash as JSON of their columns (``order`` first), sorted hashes of a bucket hash
    to one, and those of the 4,096 buckets to the plan's: no task holds all rows.
    """
    line = F.sha2(F.to_json(F.struct(*[F.col(c) for c in (*order, *[c for c in rows.columns if c not in order])]), {"ignoreNullFields": "false"}), 256)
    hashed = rows.select(line.alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    buckets = hashed.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "h"))), "\n"), 256).alias("plan_hash"))


def repair_targets(sessions: DataFrame, remote: DataFrame, policy: str) -> DataFrame:
    """Imported sessions under an older policy, with whether the remote document agrees."""
    old = sessions.where((F.col("status") == "imported") & ~F.col("acknowledged_policy").eqNullSafe(F.lit(policy)))
    return old.join(remote.select("document_id", F.col("content_hash").alias("remote_hash")), "document_id", "left").withColumn("agrees", F.col("remote_hash").eqNullSafe(F.col("acknowledged_hash")))


def health(heartbeats: DataFrame, as_of: Column, interval_s: int = 900) -> DataFrame:
    """``age_s``, ``running``, ``stale`` of ``heartbeats(name, heartbeat_at, scanned_at)`` at a given time."""
    age = (F.unix_millis(as_of) - F.unix_millis("heartbeat_at")) / 1000
    scan = (F.unix_millis(as_of) - F.unix_millis("scanned_at")) / 1000
    return heartbeats.select("name", F.floor(age).alias("age_s"), F.coalesce(age < 45, F.lit(False)).alias("running"), F.coalesce(scan > max(600, 2 * interval_s), F.lit(True)).alias("stale"))


def issues(status: DataFrame) -> DataFrame:
    """Ordered list of what is wrong, from one row of status flags."""
    cases = (
        ("paused", "importer paused"), ("not_running", "importer not running"), ("stale_sources", "sources stale"), ("feed_stale", "feed stale"),
        ("cycle_error", "last cycle failed"), ("scan_errors", "scan errors"), ("uncertain", "uncertain operations"), ("unhealthy", "service unhealthy"), ("disconnected", "service unreachable"),
    )
    rest = F.array_compact(F.array(*[F.when(F.col(c).cast("boolean"), t) for c, t in cases[2:]]))
    head = F.when(F.col("paused"), F.array(F.lit(cases[0][1]))).when(F.col("not_running"), F.array(F.lit(cases[1][1]))).otherwise(F.array().cast("array<string>"))
    return status.withColumn("issues", F.concat(head, rest))


def windows(events: DataFrame, at: str, every: str, start: Column, end: Column, *aggregates: Column) -> DataFrame:
    """Aggregates of each tumbling window between two times; a window without events shows zero ``n``."""
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(start, end, F.expr(f"interval {every}"))).alias("window_start"))
    got = events.groupBy(F.window(at, every)["start"].alias("window_start")).agg(F.count("*").alias("n"), *aggregates)
    return spine.join(got, "window_start", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def manifest_diff(old: DataFrame, new: DataFrame, key: str, *compared: str) -> DataFrame:
    """Keys that were added, removed or changed."""
    a = old.select(key, *[F.col(c).alias(f"o_{c}") for c in compared], F.lit(True).alias("o"))
    b = new.select(key, *[F.col(c).alias(f"n_{c}") for c in compared], F.lit(True).alias("n"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~same, "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def retained(rows: DataFrame, name: str, keep: int, current: str | None = None) -> DataFrame:
    """The newest by name, and the current one."""
    top = rows.orderBy(F.desc(name)).limit(keep).select(name)
    if current is not None:
        top = top.unionByName(rows.where(F.col(name) == current).select(name))
    return rows.join(top.distinct(), name, "left_semi")


def recall_hits(results: DataFrame, floor: float = 0.01, n: int = 6) -> DataFrame:
    """``results(pos, id, type, text, document_id, score)``: floor, first of each, first few."""
    kept = results.where(F.col("score").isNull() | (F.col("score") >= floor))
    key = F.coalesce("id", F.concat_ws("\n", F.coalesce("type", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("document_id", F.lit(""))))
    return kept.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("_rn = 1").drop("_rn").orderBy("pos").limit(n)


def stage_times(spans: DataFrame, stage: str, seconds: str, outcome: str) -> DataFrame:
    return spans.groupBy(stage, outcome).agg(F.count("*").alias("n"), F.percentile_approx(seconds, [0.5, 0.95], 10_000).alias("p50_p95"), F.max(seconds).alias("longest"))


def failure_rate(runs: DataFrame, failed: Column, most: float) -> DataFrame:
    rate = F.coalesce(F.avg(failed.cast("double")), F.lit(0.0))
    return runs.agg(rate.alias("rate"), (rate > most).alias("abort"))
