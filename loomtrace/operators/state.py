"""Keyed upserts, status transitions and scan bookkeeping over table snapshots.

Built-in tables cannot MERGE, so an update is a join of the snapshot with its changes;
the result replaces the snapshot.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROTECTED = ("excluded_subagent", "excluded_ambiguous", "excluded_configured", "ambiguous_preserved", "cleanup_pending")
ACTIVE = ("queued", "submitted", "processing")
LIVE = (*ACTIVE, "completed", "failed")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """Insert or update by key; columns in ``keep`` stay where the change has null.

    Changes must have one row a key.  Keys compare null-safe.
    """
    keep = set(keep)
    old, new = table.alias("o"), changes.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]

    def value(c: str) -> Column:
        if c in keys:
            return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        if c not in changes.columns:
            return F.col(f"o.{c}")
        changed = F.coalesce(f"n.{c}", f"o.{c}") if c in keep else F.col(f"n.{c}")
        return F.when(F.col("_new"), changed).otherwise(F.col(f"o.{c}")).alias(c)

    return old.join(new, on, "full_outer").select(*map(value, table.columns))


def one(changes: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One change a key: the last by ``order`` (all other columns where none is given).

    A partial aggregate: rows of a key are never gathered.
    """
    rest = [c for c in changes.columns if c not in keys]
    if not rest:
        return changes.distinct()
    by = F.struct(*[F.col(c) for c in (*order, *[c for c in rest if c not in order])])
    return changes.groupBy(*keys).agg(F.max(by).alias("last")).select(*keys, *[F.col("last")[c].alias(c) for c in rest])


def delete(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def update(table: DataFrame, targets: DataFrame, keys: Sequence[str], where: Column, **values: Column) -> DataFrame:
    """``values`` for rows whose key is a target and that pass ``where`` (both over the old row)."""
    marked = table.join(targets.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.coalesce(where, F.lit(False))
    return marked.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


SESSION_KEY = ("source", "native_session_id")
GENERATION_KEY = (*SESSION_KEY, "canonical_hash")


def mark_missing(sessions: DataFrame, known_gone: DataFrame, at: str) -> DataFrame:
    """Sessions no longer found keep their document; protected statuses stay."""
    return update(sessions, known_gone, SESSION_KEY, ~F.col("status").isin(*PROTECTED), status=F.lit("source_missing"), last_seen_at=F.lit(at))


def mark_seen(sessions: DataFrame, seen: DataFrame, at: str, restored: str = "discovered") -> DataFrame:
    """Sessions found again: fingerprint, size and time are those of ``seen``, place and origin where it has them.

    A session that was missing gets its status back (``restored``, or a column of that
    name in ``seen``); protected ones stay as they are.
    """
    replaced, kept = [[c for c in names if c in seen.columns and c in sessions.columns] for names in (("fingerprint", "size", "mtime"), ("locator", "origin"))]
    given = one(seen.select(*SESSION_KEY, *replaced, *kept, *(["restored"] if "restored" in seen.columns else [])), SESSION_KEY)
    new = given.select(*SESSION_KEY, *[F.col(c).alias(f"_{c}") for c in given.columns[2:]], F.lit(True).alias("_seen"))
    got = sessions.join(new, list(SESSION_KEY), "left")
    hit = F.coalesce(F.col("_seen"), F.lit(False)) & ~F.coalesce(F.col("status").isin(*PROTECTED), F.lit(False))
    back = F.col("_restored") if "restored" in seen.columns else F.lit(restored)
    values = {"status": F.when(F.col("status") == "source_missing", back).otherwise(F.col("status")), "last_seen_at": F.lit(at), "last_error": F.lit(None).cast("string")}
    values |= {c: F.col(f"_{c}") for c in replaced} | {c: F.coalesce(f"_{c}", c) for c in kept}
    return got.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in sessions.columns])


def set_status(sessions: DataFrame, targets: DataFrame, status: str | None, at: str, **classification: Column) -> DataFrame:
    """Overwrite status (null keeps it) and any classification columns."""
    return update(sessions, targets, SESSION_KEY, F.lit(True), status=F.coalesce(F.lit(status).cast("string"), "status"), last_seen_at=F.lit(at), **classification)


def set_generation(generations: DataFrame, targets: DataFrame, state: str, **fields: Column) -> DataFrame:
    """New state; given fields win only where they are not null, an error is always replaced."""
    values = {k: F.coalesce(v, F.col(k)) for k, v in fields.items() if k != "error"}
    return update(generations, targets, GENERATION_KEY, F.lit(True), state=F.lit(state), error=fields.get("error", F.lit(None).cast("string")), **values)


def acknowledge(sessions: DataFrame, generations: DataFrame) -> DataFrame:
    """Completed generations become the acknowledged hash; a current one makes the session imported.

    Of several of a session the one completed last is acknowledged (ties: queued last,
    then the larger hash); generations in another state than completed do nothing.
    """
    done = generations.where("state = 'completed'") if "state" in generations.columns else generations
    order = [F.col(c) if c in done.columns else F.lit(None).cast("string") for c in ("completed_at", "queued_at")]
    last = F.max(F.struct(order[0].alias("a"), order[1].alias("b"), F.col("canonical_hash").alias("hash"), F.col("retain_policy_version").alias("policy")))
    done = done.groupBy(*SESSION_KEY).agg(last.alias("_last"), F.collect_set("canonical_hash").alias("_all")).select(*SESSION_KEY, F.col("_last.hash").alias("_hash"), F.col("_last.policy").alias("_policy"), "_all")
    got = sessions.join(done, list(SESSION_KEY), "left")
    hit = F.col("_hash").isNotNull()
    imported = hit & F.array_contains("_all", F.col("canonical_hash")) & F.col("status").isin("discovered", "imported")
    values = {"acknowledged_hash": F.coalesce("_hash", "acknowledged_hash"), "acknowledged_policy": F.coalesce("_policy", "acknowledged_policy"), "status": F.when(imported, "imported").otherwise(F.col("status"))}
    return got.select(*[values[c].alias(c) if c in values else F.col(c) for c in sessions.columns])


def conflicts(generations: DataFrame) -> DataFrame:
    """Generations with another one of their session in flight: anti-join with an inequality, as a window."""
    busy = F.count_if(F.col("state").isin("submitted", "processing")).over(Window.partitionBy(*SESSION_KEY))
    own = F.col("state").isin("submitted", "processing").cast("int")
    return generations.withColumn("conflict", busy - own > 0)


def claim(generations: DataFrame, sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """Claim targets: queued or failed ones of a primary, unprotected session without another in flight
    become processing with one more attempt; of several targets of a session the oldest."""
    usable = sessions.where((F.col("classification") == "primary") & ~F.col("status").isin(*PROTECTED)).select(*SESSION_KEY)
    free = conflicts(generations).where("not conflict").where(F.col("state").isin("queued", "failed")).join(targets.select(*GENERATION_KEY), list(GENERATION_KEY), "left_semi").join(usable, list(SESSION_KEY), "left_semi")
    first = free.withColumn("rn", F.row_number().over(Window.partitionBy(*SESSION_KEY).orderBy("queued_at", "canonical_hash"))).where("rn = 1")
    return update(generations, first, GENERATION_KEY, F.lit(True), state=F.lit("processing"), attempt_count=F.col("attempt_count") + 1, error=F.lit(None).cast("string"))


def finish(generations: DataFrame, sessions: DataFrame, targets: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Targets are completed, and their sessions acknowledge them."""
    done = set_generation(generations, targets, "completed", completed_at=F.lit(at)) if "completed_at" in generations.columns else set_generation(generations, targets, "completed")
    return done, acknowledge(sessions, done.join(targets.select(*GENERATION_KEY).distinct(), list(GENERATION_KEY), "left_semi"))


def supersede(generations: DataFrame, keep: DataFrame) -> DataFrame:
    """Other versions of kept sessions that wait or failed are superseded: ``keep(source, native_session_id, keep_hash)``, the last by hash if there are several."""
    got = generations.join(one(keep.select(*SESSION_KEY, "keep_hash"), SESSION_KEY), list(SESSION_KEY), "left")
    old = (F.col("canonical_hash") != F.col("keep_hash")) & F.col("state").isin("discovered", "queued", "failed")
    return got.select(*[F.when(F.coalesce(old, F.lit(False)), "superseded").otherwise(F.col("state")).alias("state") if c == "state" else F.col(c) for c in generations.columns])


def cancel_queued(generations: DataFrame) -> DataFrame:
    waits = F.col("state").isin("queued", "failed")
    return generations.withColumn("error", F.when(waits, "Cancelled before import").otherwise(F.col("error"))).withColumn("state", F.when(waits, "superseded").otherwise(F.col("state")))


def reset_failed(generations: DataFrame, sessions: DataFrame) -> DataFrame:
    primary = sessions.where("classification = 'primary'")
    return update(generations, primary, SESSION_KEY, F.col("state") == "failed", state=F.lit("queued"), attempt_count=F.lit(0), error=F.lit(None).cast("string"))


def cleanup_pending(generations: DataFrame, targets: DataFrame) -> DataFrame:
    return update(generations, targets, SESSION_KEY, F.col("state").isin(*LIVE), state=F.lit("cleanup_pending"))


def plan_cleanup(jobs: DataFrame, new: DataFrame, generations: DataFrame, sessions: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, generations and sessions with new cleanup jobs planned; a known job id does nothing.

    A job's generation waits for cleanup if it is live, and so does its session unless it
    is excluded already.  ``new(job_id, kind, source, native_session_id, canonical_hash)``.
    """
    added = one(new, ["job_id"]).join(jobs.select("job_id").distinct(), "job_id", "left_anti")
    plan = F.concat(F.lit("Cleanup planned: "), F.col("_kind"))
    kinds = one(added.select(*GENERATION_KEY, F.col("kind").alias("_kind")), GENERATION_KEY)
    live = F.col("_kind").isNotNull() & F.col("state").isin(*LIVE)
    g = generations.join(kinds, list(GENERATION_KEY), "left")
    g = g.select(*[F.when(live, {"state": F.lit("cleanup_pending"), "error": plan}[c]).otherwise(F.col(c)).alias(c) if c in ("state", "error") else F.col(c) for c in generations.columns])
    s = sessions.join(one(added.select(*SESSION_KEY, F.col("kind").alias("_kind")), SESSION_KEY), list(SESSION_KEY), "left")
    hit = F.col("_kind").isNotNull() & ~F.coalesce(F.col("status").isin("excluded_subagent", "excluded_ambiguous", "excluded_configured", "cleanup_pending"), F.lit(False))
    values = {"status": F.lit("cleanup_pending"), "last_seen_at": F.lit(at), "last_error": plan}
    s = s.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in sessions.columns])
    return jobs.unionByName(added.withColumn("phase", F.lit("planned")).select(jobs.columns)), g, s


def finalize_excluded(generations: DataFrame, sessions: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned generations are excluded, and their sessions by kind: ``targets(source, native_session_id, kind)``.

    Of several kinds of a session the last decides: by ``created_at`` and ``job_id`` where targets have them, then by kind.
    """
    order = [c for c in ("created_at", "job_id") if c in targets.columns]
    kinds = one(targets.select(*SESSION_KEY, *order, F.col("kind").alias("_kind")), SESSION_KEY, *order).select(*SESSION_KEY, "_kind")
    marked = sessions.join(kinds, list(SESSION_KEY), "left")
    name = F.when(F.col("_kind") == "subagent", "excluded_subagent").when(F.col("_kind") == "configured-exclusion", "excluded_configured").when(F.col("_kind").isNotNull(), "excluded_ambiguous").otherwise(F.col("status"))
    values = {"status": name, "classification": F.coalesce("_kind", "classification") if "classification" in sessions.columns else None}
    kept = marked.select(*[values[c].alias(c) if c in values else F.col(c) for c in sessions.columns])
    return update(generations, targets, SESSION_KEY, F.col("state") == "cleanup_pending", state=F.lit("excluded")), kept


def requeue_after_cleanup(generations: DataFrame, new_ids: DataFrame) -> DataFrame:
    """``new_ids`` has the generation key and ``new_operation_id`` (the last, if there are several): queued afresh."""
    got = generations.join(one(new_ids.select(*GENERATION_KEY, "new_operation_id"), GENERATION_KEY), list(GENERATION_KEY), "left")
    hit = F.col("new_operation_id").isNotNull() & (F.col("state") == "cleanup_pending")
    none = F.lit(None).cast("string")
    values = {"state": F.lit("queued"), "operation_id": F.col("new_operation_id"), "attempt_count": F.lit(0), "submitted_at": none, "completed_at": none}
    return got.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in generations.columns])


#: Characters kept of an error, of a place and of a source.
ERROR_CHARS, SOURCE_ERROR_CHARS = 1_000, 2_000


def record_errors(errors: DataFrame, new: DataFrame) -> DataFrame:
    """Errors by place with new ones recorded, the latest of each: ``(source, locator, error, observed_at)``."""
    cut = new.select("source", "locator", F.left("error", F.lit(ERROR_CHARS)).alias("error"), "observed_at")
    return upsert(errors, one(cut, ["source", "locator"], "observed_at"), ["source", "locator"])


def clear_errors(errors: DataFrame, healed: DataFrame) -> DataFrame:
    return delete(errors, healed, ["source", "locator"])


def track_sources(sources: DataFrame, roots: DataFrame, at: str) -> DataFrame:
    """Sources of a scan that begins: a new one is enabled, a known one keeps all but root and start."""
    given = one(roots.select("source", "root"), ["source"]).select("source", "root", F.lit(at).alias("last_scan_started_at"))
    new = given.join(sources.select("source"), "source", "left_anti").withColumn("enabled", F.lit(True))
    known = upsert(sources, given.join(sources.select("source"), "source", "left_semi"), ["source"])
    return known.unionByName(new, allowMissingColumns=True)


def scan_finished(sources: DataFrame, outcome: DataFrame, at: str) -> DataFrame:
    """``outcome(source, error)``: without an error the scan is complete, else the source shows it, cut."""
    got = sources.join(one(outcome.select("source", F.lit(True).alias("_done"), F.left("error", F.lit(SOURCE_ERROR_CHARS)).alias("_error")), ["source"]), "source", "left")
    fine = F.col("_done") & F.col("_error").isNull()
    values = {"last_scan_completed_at": F.when(fine, F.lit(at)).otherwise(F.col("last_scan_completed_at")), "last_error": F.when(F.coalesce("_done", F.lit(False)), F.col("_error")).otherwise(F.col("last_error"))}
    return got.select(*[values[c].alias(c) if c in values else F.col(c) for c in sources.columns])


def heartbeat(status: DataFrame, pid: int, at: str, phase: str, error: str | None = None) -> DataFrame:
    """The one row of the daemon's status, replaced: ``(id, pid, heartbeat_at, phase, last_error)``."""
    row = status.sparkSession.createDataFrame([(1, pid, at, phase, error and error[:ERROR_CHARS])], "id int, pid int, heartbeat_at string, phase string, last_error string")
    return upsert(status, row, ["id"])


def unrecorded(artifacts: DataFrame, sessions: DataFrame, kind: str = "primary") -> DataFrame:
    """Sessions that artifacts of a kind name and the state does not know, once each."""
    return artifacts.where(F.col("classification") == kind).select(*SESSION_KEY).distinct().join(sessions.select(*SESSION_KEY), list(SESSION_KEY), "left_anti")


def clear_missing_errors(errors: DataFrame, discovered: DataFrame) -> DataFrame:
    """Errors of places that are still discovered."""
    return errors.join(discovered.select("source", "locator").distinct(), ["source", "locator"], "left_semi")


def missing_sessions(known: DataFrame, seen: DataFrame, healthy: Sequence[str], filtered: bool = False) -> DataFrame:
    """Known sessions not seen, of sources that were scanned whole and without error."""
    if filtered:
        return known.limit(0)
    return known.where(F.col("source").isin(*healthy)).join(seen.select(*SESSION_KEY).distinct(), list(SESSION_KEY), "left_anti")


def settle(observations: DataFrame, keys: Sequence[str], at: Column, fingerprint: str, seconds: int) -> DataFrame:
    """Each observation with ``settled``: is its fingerprint unchanged for ``seconds`` since first seen?

    The first observation of a fingerprint is never settled.
    """
    order = Window.partitionBy(*keys).orderBy("_at", "_tie")
    # looks at the same moment: by the caller's tie, else by fingerprint, which any run repeats
    rows = observations.withColumn("_at", at.cast("timestamp")).withColumn("_tie", F.col(fingerprint) if "_tie" not in observations.columns else F.col("_tie"))
    fresh = F.coalesce(F.lag(fingerprint).over(order) != F.col(fingerprint), F.lit(True)).cast("int")
    rows = rows.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order))
    island = Window.partitionBy(*keys, "island")
    since = F.min("_at").over(island)
    settled = (F.col("_fresh") == 0) & ((F.unix_micros("_at") - F.unix_micros(since)) >= seconds * 1_000_000)
    return rows.withColumn("settled", settled).drop("_fresh", "_tie")
