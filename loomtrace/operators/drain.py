"""The write path after a scan: what to do with each claimed generation, what a reply means, cleanup and repair.

The service is a table of replies here; a step maps tables to tables, so it can be run
again after a failure.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..settings import RETAIN
from .canonical import checkpoint
from .queue import next_operation_ids, reserve
from .state import GENERATION_KEY, SESSION_KEY, acknowledge, cleanup_pending, delete, finalize_excluded, one, update, upsert

# Remote states of an operation.
FAILED = ("failed", "cancelled", "error", "rejected")
ENDED = ("completed", "failed", "cancelled", "error")
LOCAL = ("prepared", "ready", "rejected")


def actions(generations: DataFrame, sessions: DataFrame, operations: DataFrame, classified: DataFrame, bank: str) -> DataFrame:
    """Claimed generations with ``action`` and the ``operation_id`` to use.

    ``operations(operation_id, remote_status)``, ``classified(source, native_session_id,
    kind)`` is the live verdict.  A session that is not primary any more is excluded (or
    preserved, if ambiguous, acknowledged and not yet submitted); a terminal failure is
    submitted again under the next operation id; what was submitted is polled; the rest
    is submitted.
    """
    g = generations.where(F.col("state").isin("processing", "submitted"))
    s = sessions.select(*SESSION_KEY, "document_id", "acknowledged_hash", "acknowledged_policy")
    got = g.join(s, list(SESSION_KEY)).join(operations.select("operation_id", "remote_status"), "operation_id", "left").join(one(classified.select(*SESSION_KEY, "kind"), SESSION_KEY), list(SESSION_KEY), "left")
    kind, remote = F.coalesce("kind", F.lit("primary")), F.col("remote_status")
    polled = remote.isNotNull() & ~remote.isin(*FAILED, "prepared", "ready")
    preserved = (kind == "ambiguous") & F.col("acknowledged_hash").isNotNull() & remote.isNull()
    action = F.when(polled, "poll").when(kind != "primary", F.when(preserved, "preserve").otherwise("exclude")).when(remote.isin(*FAILED), "resubmit").otherwise("submit")
    got = checkpoint(got.withColumn("action", action))
    again = got.where("action = 'resubmit'")
    ids = next_operation_ids(again, generations.select("operation_id").unionByName(operations.select("operation_id")), bank).withColumnRenamed("operation_id", "_new")
    got = got.join(ids, ["document_id", "canonical_hash"], "left")
    return got.select(*GENERATION_KEY, "document_id", F.coalesce(F.when(F.col("action") == "resubmit", F.col("_new")), "operation_id").alias("operation_id"), F.col("operation_id").alias("previous_id"), "action", "kind")


#: What a held action says.
HELD = {"refuse": "historical repairs require a reviewed plan", "conflict": "the remote document changed outside of the repair", "over_budget": "the approved budget is exceeded", "no_space": "free space is below the approved minimum"}
SENDS = ("submit", "resubmit", "replace")


def guard(todo: DataFrame, generations: DataFrame, sessions: DataFrame, remote: DataFrame, repairing: bool = False, free_bytes: int | None = None, least_free: int | None = None) -> DataFrame:
    """Actions with repairs held or prepared, before anything is sent.

    A generation marked ``repair`` is refused outside of a repair (unless its policy is
    acknowledged by now: then it is no repair any more).  In one, the remote document
    (``remote(document_id, content_hash)``) must have the acknowledged content or the new
    one, and is then replaced; another content is a conflict, no document a plain submit.
    With less space than the approval asks for nothing is sent.
    """
    marked = one(generations.select(*GENERATION_KEY, F.coalesce("repair", F.lit(False)).alias("_repair"), F.col("retain_policy_version").alias("_policy")), GENERATION_KEY)
    known = one(sessions.select(*SESSION_KEY, F.col("acknowledged_hash").alias("_ack"), F.col("acknowledged_policy").alias("_acked")), SESSION_KEY)
    there = one(remote.select("document_id", F.col("content_hash").alias("_remote"), F.lit(True).alias("_there")), ["document_id"])
    got = todo.join(marked, list(GENERATION_KEY), "left").join(known, list(SESSION_KEY), "left").join(there, "document_id", "left")
    repair = F.col("_repair") & ~F.col("_acked").eqNullSafe(F.col("_policy")) & F.col("action").isin("submit", "resubmit")
    ours = F.coalesce((F.col("_remote") == F.col("_ack")) | (F.col("_remote") == F.col("canonical_hash")), F.lit(False))
    allowed = F.when(F.col("_there").isNull(), F.col("action")).when(ours, "replace").otherwise("conflict") if repairing else F.lit("refuse")
    action = F.when(F.coalesce(repair, F.lit(False)), allowed).otherwise(F.col("action"))
    if least_free is not None and (free_bytes or 0) < least_free:
        action = F.when(action.isin(*SENDS), "no_space").otherwise(action)
    return got.withColumn("action", action).select(todo.columns)


class Budgeted(NamedTuple):
    """Actions that a budget admits, and all reservations after it."""

    todo: DataFrame
    reservations: DataFrame


def budget(todo: DataFrame, sizes: DataFrame, reservations: DataFrame, max_tokens: int | None, max_cost: float, usd_in: float, usd_out: float) -> Budgeted:
    """Reserve budget for what is sent, in the order of operations; what it does not admit is held as ``over_budget``.

    ``sizes(source, native_session_id, canonical_hash, canonical_bytes)``,
    ``reservations(operation_id, tokens, cost)``.  An operation that has a reservation
    keeps it and costs nothing again.
    """
    tokens = C.estimate_tokens(F.coalesce("canonical_bytes", F.lit(0)))
    sends = todo.where(F.col("action").isin(*SENDS)).join(one(sizes.select(*GENERATION_KEY, "canonical_bytes"), GENERATION_KEY), list(GENERATION_KEY), "left")
    asked = sends.select(F.col("operation_id").alias("pos"), "operation_id", tokens.cast("bigint").alias("tokens"), C.estimate_cost(tokens, usd_in, usd_out).alias("cost"))
    asked = checkpoint(asked.join(reservations.select("operation_id").distinct(), "operation_id", "left_anti"))
    spent = reservations.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("cost"), F.lit(0.0))).first()
    found = checkpoint(reserve(asked, max_tokens, max_cost, spent=(int(spent[0]), float(spent[1]))))
    over = found.where(~F.col("admitted")).select("operation_id", F.lit(True).alias("_over"))
    held = todo.join(over.distinct(), "operation_id", "left").withColumn("action", F.when(F.col("_over") & F.col("action").isin(*SENDS), "over_budget").otherwise(F.col("action")))
    return Budgeted(held.select(todo.columns), reservations.select("operation_id", "tokens", "cost").unionByName(found.where("admitted").select("operation_id", "tokens", "cost")))


class State(NamedTuple):
    """The tables that a drain changes."""

    generations: DataFrame
    sessions: DataFrame
    operations: DataFrame


def apply(state: State, done: DataFrame, replies: DataFrame, at: str) -> State:
    """The state after actions and what came of them.

    ``done`` is from :func:`actions`; ``replies(operation_id, status, error)`` has a row
    for each that was polled or sent: ``completed``, a failure of the operation,
    ``not_found`` (submitted again by the next round), ``pending`` or ``unknown`` (no
    reply in time: it stays submitted).  Nothing completes twice: a repeated reply finds
    its generation completed.
    """
    got = done.join(one(replies.select("operation_id", "status", "error"), ["operation_id"]), "operation_id", "left")
    failed = F.col("status").isin(*FAILED)
    new = (
        F.when(F.col("action").isin("refuse", "over_budget", "no_space"), "failed").when(F.col("action") == "conflict", "submitted")
        .when(F.col("action") == "preserve", "superseded").when(F.col("action") == "exclude", "cleanup_pending").when(F.col("status") == "completed", "completed")
        .when(failed, "failed").when(F.col("status") == "not_found", "processing").otherwise("submitted")
    )
    held = F.create_map(*[F.lit(x) for pair in HELD.items() for x in pair])[F.col("action")]
    got = checkpoint(got.withColumn("_new_state", new).withColumn("error", F.coalesce(held, F.col("error"))))
    new = F.col("_new_state")
    moved = one(got.select(*GENERATION_KEY, F.col("operation_id").alias("_id"), new.alias("_state"), F.col("error").alias("_error")), GENERATION_KEY)
    g = state.generations.join(moved, list(GENERATION_KEY), "left")
    hit = F.col("_state").isNotNull() & F.col("state").isin("processing", "submitted")
    values = {"state": F.col("_state"), "operation_id": F.col("_id"), "error": F.when(F.col("_state") == "completed", None).otherwise(F.col("_error")), "submitted_at": F.when(F.col("_state") == "submitted", F.coalesce("submitted_at", F.lit(at))).otherwise(F.col("submitted_at")), "completed_at": F.when(F.col("_state") == "completed", F.lit(at)).otherwise(F.col("completed_at"))}
    g = g.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in state.generations.columns])
    sessions = acknowledge(state.sessions, g.join(moved.where("_state = 'completed'").select(*GENERATION_KEY), list(GENERATION_KEY), "left_semi"))
    kinds = got.where(F.col("action").isin("exclude", "preserve")).select(*SESSION_KEY, "kind", "action")
    name = F.when(F.col("action") == "preserve", "ambiguous_preserved").when(F.col("kind") == "subagent", "excluded_subagent").when(F.col("kind") == "configured-exclusion", "excluded_configured").otherwise("excluded_ambiguous")
    out = one(kinds.select(*SESSION_KEY, "kind", name.alias("_status")), SESSION_KEY).withColumnRenamed("kind", "_kind")
    sessions = sessions.join(out, list(SESSION_KEY), "left").select(*[F.coalesce({"status": "_status", "classification": "_kind"}[c], c).alias(c) if c in ("status", "classification") else F.col(c) for c in state.sessions.columns])
    g = cleanup_pending(g, kinds.where("action = 'exclude'"))
    seen = got.where(~F.col("action").isin("exclude", "preserve", "refuse", "over_budget", "no_space")).select("operation_id", F.when(F.col("status") == "not_found", "ready").otherwise(F.coalesce("status", F.lit("pending"))).alias("remote_status"))
    return State(g, sessions, upsert(state.operations.select("operation_id", "remote_status"), one(seen, ["operation_id"]), ["operation_id"]))


def settle_operations(jobs: DataFrame, operations: DataFrame) -> DataFrame:
    """Planned jobs with ``settle``: what their operation needs before its document may go.

    ``none`` (not submitted, or ended), ``cancel`` (pending), ``wait`` (processing), or
    ``poll`` where its state is unknown.
    """
    got = jobs.where("phase = 'planned'").join(operations.select(F.col("operation_id").alias("old_operation_id"), "remote_status"), "old_operation_id", "left")
    remote = F.col("remote_status")
    needs = F.when(F.col("old_operation_id").isNull() | remote.isin(*LOCAL, *ENDED), "none").when(remote == "pending", "cancel").when(remote == "processing", "wait").otherwise("poll")
    return got.select(*jobs.columns, "remote_status", needs.alias("settle"))


class Cleanup(NamedTuple):
    """State after a round of cleanup, and the documents to delete remotely."""

    jobs: DataFrame
    generations: DataFrame
    sessions: DataFrame
    reservations: DataFrame
    deletions: DataFrame


def advance_cleanup(jobs: DataFrame, generations: DataFrame, sessions: DataFrame, operations: DataFrame, reservations: DataFrame, remote: DataFrame) -> Cleanup:
    """One round: settled jobs whose document is gone become ``remote_deleted``, and those before it ``state_finalized``.

    ``remote(document_id)`` lists what the service has now.  A settled job whose document
    is still there stays planned and names it in ``deletions``; deleting twice does no
    harm.  Finalized jobs exclude their generation and session and free their budget.
    """
    settled = settle_operations(jobs, operations).where("settle = 'none'")
    there = remote.select("document_id").distinct()
    deletions = settled.join(there, "document_id", "left_semi").select("document_id").distinct()
    gone = settled.join(there, "document_id", "left_anti").select("job_id")
    final = jobs.where("phase = 'remote_deleted'")
    phases = gone.select("job_id", F.lit("remote_deleted").alias("_phase")).unionByName(final.select("job_id", F.lit("state_finalized").alias("_phase")))
    moved = jobs.join(one(phases, ["job_id"]), "job_id", "left").select(*[F.coalesce("_phase", c).alias(c) if c == "phase" else F.col(c) for c in jobs.columns])
    g, s = finalize_excluded(generations.join(final.select(*GENERATION_KEY).distinct(), list(GENERATION_KEY), "left_semi"), sessions, final)
    rest = delete(generations, final, list(GENERATION_KEY))
    left = reservations.join(final.select(F.col("old_operation_id").alias("operation_id")).distinct(), "operation_id", "left_anti").select(reservations.columns)
    return Cleanup(moved, rest.unionByName(g), s, left, deletions)


def cleanup_summary(jobs: DataFrame) -> DataFrame:
    """One row: jobs by phase."""
    return jobs.agg(*[F.count_if(F.col("phase") == p).alias(p) for p in ("planned", "remote_deleted", "state_finalized")])


def next_repairs(plan: DataFrame, sessions: DataFrame, generations: DataFrame, inflight: int = 4, policy: str = RETAIN) -> DataFrame:
    """Targets of a repair plan to scan next: unfinished, not busy, as many as twice ``inflight`` leaves room for.

    Work outside of the plan, a failed or blocked generation, or a target that is no
    primary session any more stops the repair; an error on a running one holds it.
    """
    open_ = generations.where(F.col("state").isin("queued", "submitted", "processing", "failed", "cleanup_pending"))
    strange = open_.join(plan.select(*SESSION_KEY), list(SESSION_KEY), "left_anti").limit(1).count()
    row = open_.agg(F.count("*").alias("n"), F.count_if(F.col("state").isin("failed", "cleanup_pending")).alias("stuck"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
    now = plan.select(*SESSION_KEY).join(sessions.select(*SESSION_KEY, "classification", "status", "acknowledged_policy"), list(SESSION_KEY), "left")
    unfit = now.where(~F.coalesce((F.col("classification") == "primary") & (F.col("status") != "ambiguous_preserved"), F.lit(False))).limit(1).count()
    if strange or row.stuck or unfit:
        raise RuntimeError("work outside of the plan is pending" if strange else "the repair has unresolved errors" if row.stuck else "a target is no eligible primary session")
    room = 0 if row.errors else max(2, 2 * inflight) - row.n
    todo = now.where(~F.col("acknowledged_policy").eqNullSafe(F.lit(policy))).join(open_.select(*SESSION_KEY).distinct(), list(SESSION_KEY), "left_anti").select(*SESSION_KEY)
    return todo.orderBy(*SESSION_KEY).limit(max(0, room))


def repair_verified(plan: DataFrame, sessions: DataFrame, remote: DataFrame) -> DataFrame:
    """Targets whose remote document is not the acknowledged one; a repair is complete without any."""
    got = plan.select(*SESSION_KEY).join(sessions.select(*SESSION_KEY, "document_id", "acknowledged_hash"), list(SESSION_KEY), "left").join(remote.select("document_id", F.col("content_hash").alias("remote_hash")), "document_id", "left")
    return got.where(~F.col("remote_hash").eqNullSafe(F.col("acknowledged_hash")) | F.col("acknowledged_hash").isNull())


def work_adapters(work: DataFrame, sessions: DataFrame, adapters: DataFrame, local: str) -> DataFrame:
    """Work with the ``root`` of the adapter that reads it: ``adapters(source, origin, root)``; null where there is none."""
    s = sessions.select(*SESSION_KEY, F.coalesce("origin", F.lit(local)).alias("origin"))
    return work.join(s, list(SESSION_KEY)).join(F.broadcast(adapters), ["source", "origin"], "left")


def migrate(tables: dict[str, DataFrame], version: int) -> tuple[dict[str, DataFrame], int]:
    """State tables of an older schema brought to the present one, step by step; present ones come back as they are.

    2: classification of sessions.  4: what was acknowledged (the generation completed
    last), policies and repairs, and failed generations whose operation has not ended are
    submitted again.  5: origin of sessions.
    """
    t = dict(tables)

    def add(name: str, **columns: Column) -> None:
        t[name] = t[name].select("*", *[v.alias(c) for c, v in columns.items() if c not in t[name].columns])

    none = F.lit(None).cast("string")
    if version < 2:
        add("sessions", classification=F.lit("primary"), classification_reason=F.lit("legacy-unclassified"), classification_policy_version=F.lit("3"))
    if version < 4:
        add("sessions", acknowledged_hash=none, acknowledged_policy=none)
        add("generations", retain_policy_version=F.lit("1"), repair=F.lit(False))
        last = t["generations"].where("state = 'completed'").groupBy(*SESSION_KEY).agg(F.max_by("canonical_hash", F.struct("completed_at", "queued_at", "canonical_hash")).alias("_hash"))
        values = {"acknowledged_hash": F.col("_hash"), "acknowledged_policy": F.when(F.col("_hash").isNotNull(), "1")}
        t["sessions"] = t["sessions"].join(last, list(SESSION_KEY), "left").select(*[values[c].alias(c) if c in values else F.col(c) for c in t["sessions"].columns])
        open_ = t["operations"].where(~F.coalesce(F.col("remote_status"), F.lit("unknown")).isin(*ENDED)).select("operation_id")
        t["generations"] = update(t["generations"], open_, ["operation_id"], F.col("state") == "failed", state=F.lit("submitted"))
    if version < 5:
        add("sessions", origin=F.lit("desktop"))
    return t, 5
