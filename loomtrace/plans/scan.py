"""One scan: discovered references against the state, to outcomes and the state after it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import queue
from ..operators.canonical import checkpoint
from ..operators.state import PROTECTED, SESSION_KEY, cleanup_pending, delete, mark_missing, mark_seen, missing_sessions, one, record_errors, supersede, upsert
from ..settings import RETAIN


class Tables(NamedTuple):
    """State that a scan reads and replaces."""

    sessions: DataFrame
    generations: DataFrame
    candidates: DataFrame
    errors: DataFrame
    indexed: DataFrame


class Scan(NamedTuple):
    """What a scan found (``source``, ``native_session_id``, ``locator``, ``outcome``) and the state after it."""

    outcomes: DataFrame
    tables: Tables


def decide(references: DataFrame, tables: Tables, settle_seconds: int, at: str, force: bool = False) -> DataFrame:
    """References with ``outcome``: excluded, configured, ambiguous, unchanged, active, or load.

    ``references(source, native_session_id, locator, origin, kind, fingerprint, size,
    mtime)``, one a session, with the effective verdict ``kind``.  A session preserved as
    ambiguous stays so unless it is excluded by configuration.  A changed one is loaded
    when its fingerprint has stood still for ``settle_seconds`` since it was first seen.
    """
    s = tables.sessions.select(*SESSION_KEY, "document_id", "status", "canonical_hash", "acknowledged_hash", "acknowledged_policy", F.col("fingerprint").alias("_known"))
    flying = tables.generations.where(F.col("state").isin("queued", "submitted", "processing", "failed")).select(*SESSION_KEY, "canonical_hash").distinct().withColumn("_flying", F.lit(True))
    seen = one(tables.candidates.select(*SESSION_KEY, F.col("fingerprint").alias("_seen"), "first_seen"), SESSION_KEY)
    got = references.join(s, list(SESSION_KEY), "left").join(flying, [*SESSION_KEY, "canonical_hash"], "left").join(tables.indexed.select("document_id", "indexed_hash"), "document_id", "left").join(seen, list(SESSION_KEY), "left")
    acknowledged = (F.col("acknowledged_hash") == F.col("canonical_hash")) & (F.col("acknowledged_policy") == RETAIN)
    current = (F.col("indexed_hash") == F.col("canonical_hash")) & (F.coalesce(acknowledged, F.lit(False)) | F.col("_flying").isNotNull())
    empty = F.col("status") == "empty_after_normalization"
    same = F.col("canonical_hash").isNotNull() & (empty | F.coalesce(current, F.lit(False))) & (F.col("_known") == F.col("fingerprint")) & F.lit(not force)
    waited = F.unix_seconds(F.lit(at).cast("timestamp")) - F.unix_seconds(F.col("first_seen").cast("timestamp"))
    settled = F.lit(force or settle_seconds == 0) | F.coalesce((F.col("_seen") == F.col("fingerprint")) & (waited >= settle_seconds), F.lit(False))
    preserved = (F.col("status") == "ambiguous_preserved") & (F.col("kind") != "configured-exclusion")
    outcome = (
        F.when(F.coalesce(preserved, F.lit(False)), "ambiguous").when(F.col("kind") == "subagent", "excluded").when(F.col("kind") == "configured-exclusion", "configured").when(F.col("kind") != "primary", "ambiguous")
        .when(F.coalesce(same, F.lit(False)), "unchanged").when(settled, "load").otherwise("active")
    )
    first = F.when(F.coalesce(F.col("_seen") == F.col("fingerprint"), F.lit(False)), F.col("first_seen")).otherwise(F.lit(at))
    return got.select(*references.columns, outcome.alias("outcome"), F.col("status").alias("known_status"), F.coalesce(preserved, F.lit(False)).alias("preserved"), first.alias("first_seen"))


def scan(references: DataFrame, loaded: DataFrame, tables: Tables, healthy: list[str], bank: str, at: str, settle_seconds: int = 3600, force: bool = False, whole: bool = True) -> Scan:
    """One scan with the sessions it loaded.

    ``loaded`` has, for references that :func:`decide` wants loaded, their document_id,
    canonical_hash, canonical_bytes, canonical_turns, status and error; one that is not
    there counts as an error.  A scan of chosen sessions (not ``whole``) marks none as
    missing, nor does a source that is not ``healthy`` or had an error.
    """
    decided = decide(references, tables, settle_seconds, at, force)
    content = ["document_id", "canonical_hash", "canonical_bytes", "canonical_turns", "status", "error"]
    got = decided.join(one(loaded.select(*SESSION_KEY, *content), SESSION_KEY), list(SESSION_KEY), "left")
    bad = (F.col("outcome") == "load") & (F.col("error").isNotNull() | F.col("canonical_hash").isNull())
    got = got.withColumns({"outcome": F.when(bad, "error").otherwise(F.col("outcome")), "error": F.when(bad, F.coalesce("error", F.lit("source was not read")))})
    got = checkpoint(got)  # what follows reads it many times
    of = lambda *names: got.where(F.col("outcome").isin(*names))

    # sessions: seen again, loaded, reclassified
    latest = tables.generations.groupBy(*SESSION_KEY).agg(F.max_by("state", F.struct("queued_at", "canonical_hash")).alias("_latest"))
    back = of("unchanged").join(latest, list(SESSION_KEY), "left").withColumn("restored", F.when(F.col("_latest") == "completed", "imported").otherwise("discovered"))
    sessions = mark_seen(tables.sessions, back, at)
    fresh = of("load").select(*SESSION_KEY, "document_id", "locator", "origin", "fingerprint", "size", "mtime", "canonical_hash", "canonical_bytes", "canonical_turns", F.when(F.col("status") == "empty_after_normalization", F.col("status")).otherwise("discovered").alias("status"), F.lit("primary").alias("classification"), F.lit(at).alias("last_seen_at"), F.lit(None).cast("string").alias("last_error"))
    sessions = upsert(sessions, fresh.select(*[c for c in fresh.columns if c in tables.sessions.columns]), SESSION_KEY, keep=["canonical_hash", "canonical_bytes", "canonical_turns"])
    place = tables.sessions.select(*SESSION_KEY, F.col("locator").alias("_place"))
    out = of("excluded", "configured", "ambiguous").where("not preserved").join(place, list(SESSION_KEY)).where((F.col("source") != "claude") | (F.col("_place") == F.col("locator"))).join(latest, list(SESSION_KEY), "left")
    keep = (F.col("kind") == "ambiguous") & (F.col("_latest") == "completed")
    name = F.when(F.col("kind") == "subagent", "excluded_subagent").when(F.col("kind") == "configured-exclusion", "excluded_configured").when(F.coalesce(keep, F.lit(False)), "ambiguous_preserved").otherwise("excluded_ambiguous")
    out = checkpoint(out.select(*SESSION_KEY, F.col("kind").alias("_kind"), name.alias("_status")))
    sessions = sessions.join(out, list(SESSION_KEY), "left").select(*[F.coalesce({"classification": "_kind", "status": "_status"}[c], c).alias(c) if c in ("classification", "status") else F.col(c) for c in tables.sessions.columns])
    sessions = checkpoint(sessions)
    hurt = {r[0] for r in of("error").select("source").distinct().collect()}
    gone = missing_sessions(sessions, references.where("kind = 'primary'"), [s for s in healthy if s not in hurt], filtered=not whole)
    gone = checkpoint(gone.where(~F.col("status").isin(*PROTECTED, "source_missing")))
    sessions = mark_missing(sessions, gone, at)

    # generations: cleanup, older versions, new ones
    generations = cleanup_pending(tables.generations, out.where("_status <> 'ambiguous_preserved'"))
    kept = of("load").where("status is null or status <> 'empty_after_normalization'").select(*SESSION_KEY, F.col("canonical_hash").alias("keep_hash"))
    generations = checkpoint(supersede(generations, kept))
    ready = sessions.join(of("load").select(*SESSION_KEY), list(SESSION_KEY), "left_semi")
    new = checkpoint(queue.enqueue(ready, generations, bank, RETAIN, at))
    generations = upsert(generations, new.select(*[c for c in new.columns if c in generations.columns]), ["source", "native_session_id", "canonical_hash"])
    sessions = sessions.join(new.select(*SESSION_KEY, F.lit(True).alias("_new")), list(SESSION_KEY), "left").join(of("load").select(*SESSION_KEY, F.lit(True).alias("_loaded")), list(SESSION_KEY), "left")
    known = F.col("_loaded") & F.col("_new").isNull() & (F.col("status") != "empty_after_normalization") & (F.col("acknowledged_hash") == F.col("canonical_hash"))
    sessions = sessions.select(*[F.when(F.coalesce(known, F.lit(False)), "imported").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in tables.sessions.columns])

    # candidates, errors and the index
    waiting = upsert(delete(tables.candidates, got.where("outcome <> 'active'"), list(SESSION_KEY)), of("active").select(*SESSION_KEY, "fingerprint", "first_seen"), SESSION_KEY)
    errors = delete(tables.errors, got.where("outcome not in ('error', 'active')"), ["source", "locator"])
    errors = record_errors(errors, of("error").select("source", "locator", "error", F.lit(at).alias("observed_at")))
    leave = tables.sessions.join(out.select(*SESSION_KEY).unionByName(got.where("preserved").select(*SESSION_KEY)), list(SESSION_KEY), "left_semi").select("document_id")
    leave = leave.unionByName(of("load").where("status = 'empty_after_normalization'").select("document_id"))
    indexed = upsert(delete(tables.indexed, leave, ["document_id"]), of("load").where("status is null or status <> 'empty_after_normalization'").select("document_id", F.col("canonical_hash").alias("indexed_hash")), ["document_id"])

    named = F.when(F.col("outcome") == "load", F.when(F.col("status") == "empty_after_normalization", "empty").when(F.col("_new").isNotNull(), "queued").otherwise("loaded")).otherwise(F.col("outcome"))
    outcomes = got.join(new.select(*SESSION_KEY, F.lit(True).alias("_new")), list(SESSION_KEY), "left").select(*SESSION_KEY, "locator", named.alias("outcome"))
    outcomes = outcomes.unionByName(gone.select(*SESSION_KEY, "locator", F.lit("source_missing").alias("outcome")))
    return Scan(outcomes, Tables(sessions, generations, waiting, errors, indexed))
