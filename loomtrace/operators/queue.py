"""Work queue: eligibility, order, identifiers, budget, enqueueing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .canonical import checkpoint
from .state import ACTIVE, GENERATION_KEY, SESSION_KEY

#: Requests that one task of a round reads in order, about.
BLOCK_ROWS = 100_000


def eligible(max_attempts: int, state: str = "state", attempts: str = "attempt_count") -> Column:
    return F.col(state).isin(*ACTIVE) | ((F.col(state) == "failed") & (F.col(attempts) < max_attempts))


def candidates(generations: DataFrame, limit: int, max_attempts: int = 3) -> DataFrame:
    """Active work first, then queued, then failed; oldest first, then by operation."""
    order = F.when(F.col("state").isin("submitted", "processing"), 0).when(F.col("state") == "queued", 1).otherwise(2)
    return generations.where(eligible(max_attempts)).orderBy(order, "queued_at", "operation_id").limit(limit)


def pending(generations: DataFrame, max_attempts: int = 3) -> DataFrame:
    return generations.where(eligible(max_attempts)).agg(F.count("*").alias("pending"))


def next_operation_ids(wanted: DataFrame, used: DataFrame, bank: str) -> DataFrame:
    """First unused of the base identifier and its replays: ``wanted(document_id, canonical_hash)``.

    A document or hash that is null gets none.  There is no last replay.  Each round tests one identifier of the rows that have none
    yet, twice as many rounds of them at a time, so rows are few and rounds grow with
    the logarithm of the longest run of used ones.
    """
    taken = used.select(F.col("operation_id").alias("operation_id")).distinct()
    left = wanted.select("document_id", "canonical_hash").where("document_id is not null and canonical_hash is not null").distinct()
    name = C.operation_id(F.lit(bank), F.col("document_id"), F.col("canonical_hash"))
    replay = C.operation_id(F.lit(bank), F.col("document_id"), F.col("canonical_hash"), F.lit("replay"), F.col("n").cast("string"))
    out, begin, width = None, 0, 1
    while True:
        each = left.select("document_id", "canonical_hash", F.explode(F.sequence(F.lit(begin), F.lit(begin + width - 1))).alias("n"))
        named = each.select("document_id", "canonical_hash", "n", F.when(F.col("n") == 0, name).otherwise(replay).alias("operation_id"))
        free = named.join(taken, "operation_id", "left_anti").groupBy("document_id", "canonical_hash").agg(F.min_by("operation_id", "n").alias("operation_id"))
        free = checkpoint(free)
        out = free if out is None else out.unionByName(free)
        left = checkpoint(left.join(free, ["document_id", "canonical_hash"], "left_anti"))
        if not left.limit(1).count():
            return out
        begin, width = begin + width, width * 2


class Admission(NamedTuple):
    """Requests with ``admitted``, and in how many rounds that was found."""

    requests: DataFrame
    rounds: int


def reserve(requests: DataFrame, max_tokens: int | None, max_cost: float, group: str | None = None, spent: tuple[int, float] = (0, 0.0), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Requests with ``admitted``, as :func:`admission` finds it."""
    return admission(requests, max_tokens, max_cost, group, spent, block_rows).requests


def admission(requests: DataFrame, max_tokens: int | None, max_cost: float, group: str | None = None, spent: tuple[int, float] = (0, 0.0), block_rows: int = BLOCK_ROWS) -> Admission:
    """Greedy admission in order of ``pos``: a request over a cap is skipped and later ones still tried.

    ``requests(pos, operation_id, tokens, cost)``; a repeated operation is admitted as
    before and costs nothing; ``spent`` is what was reserved earlier; null sizes count
    nothing.  Costs are added as decimals of twelve places.

    The order of a group is cut into blocks of about ``block_rows``.  A round drops what
    exceeds the rest of a budget by itself (totals only grow, so it can never fit), adds
    up the blocks of what is left, and admits all blocks before the first that would
    pass a cap.  That one block is read in order, by one task that holds two totals; the
    next round begins behind it with what it has left.  So there are no more rounds than
    blocks, mostly two or three, and a group is never in one task.
    """
    key = F.col(group) if group else F.lit(0)
    first = requests.groupBy(key.alias("g"), "operation_id").agg(F.min_by(F.struct("pos", "tokens", "cost"), "pos").alias("r"))
    money = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,12)")
    asked = first.select("g", "operation_id", F.col("r.pos").alias("pos"), F.coalesce(F.col("r.tokens"), F.lit(0)).cast("bigint").alias("tokens"), money(F.col("r.cost")).alias("cost"))
    room = F.lit((max_tokens if max_tokens is not None else (1 << 62)) - spent[0]).cast("bigint")
    left = (F.lit(str(min(max_cost, 1e24))).cast("decimal(38,12)") - F.lit(str(spent[1])).cast("decimal(38,12)")).cast("decimal(38,12)")
    parts = max(1, -(-asked.count() // block_rows))
    if parts == 1:  # one block is read in order as it is
        read = _in_order(asked.select("*", F.lit(0).alias("over"), room.alias("left_room"), left.alias("left_money")))
        admitted, rounds = read.where("ok").select("g", "operation_id"), 1
    else:
        admitted, rounds = _rounds(asked, parts, room, left)
    admitted = admitted.select(F.col("g").alias("_g"), F.col("operation_id").alias("_op"), F.lit(True).alias("_ok"))
    got = requests.withColumn("_k", key).join(admitted, F.col("operation_id").eqNullSafe(F.col("_op")) & F.col("_k").eqNullSafe(F.col("_g")), "left")
    return Admission(got.select(*[F.col(f"`{c}`") for c in requests.columns], F.coalesce("_ok", F.lit(False)).alias("admitted")), rounds)


def _rounds(asked: DataFrame, parts: int, room: Column, left: Column) -> tuple[DataFrame, int]:
    asked = checkpoint(asked.repartitionByRange(parts, "g", "pos").withColumn("block", F.spark_partition_id()))
    # what a group has left, and the block that it goes on with
    state = checkpoint(asked.select("g").distinct().select("g", F.lit(0).alias("next"), room.alias("room"), left.alias("money")))
    admitted, rounds = asked.limit(0).select("g", "operation_id"), 0
    while state.limit(1).count():
        rounds += 1
        now = state.withColumnRenamed("g", "_g")
        fits = checkpoint(asked.join(now, F.col("g").eqNullSafe(F.col("_g"))).where("block >= next and tokens <= room and cost <= money").drop("_g", "next"))
        sums = fits.groupBy("g", "block").agg(F.sum(F.col("tokens").cast("decimal(38,0)")).alias("t"), F.sum("cost").alias("c"), F.first("room").alias("room"), F.first("money").alias("money"))
        so_far = Window.partitionBy("g").orderBy("block")
        sums = sums.select("g", "block", (F.sum("t").over(so_far) > F.col("room")).alias("ot"), (F.sum("c").over(so_far) > F.col("money")).alias("oc"), "t", "c", "room", "money")
        over = sums.groupBy("g").agg(F.min(F.when(F.col("ot") | F.col("oc"), F.col("block"))).alias("over"))
        used = sums.join(over.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).groupBy("g", "over", "room", "money").agg(F.sum(F.when(F.col("over").isNull() | (F.col("block") < F.col("over")), F.col("t"))).alias("t"), F.sum(F.when(F.col("over").isNull() | (F.col("block") < F.col("over")), F.col("c"))).alias("c"))
        used = checkpoint(used.select(F.col("g").alias("_g"), "over", (F.col("room") - F.coalesce("t", F.lit(0))).cast("bigint").alias("left_room"), (F.col("money") - F.coalesce("c", F.lit(0))).cast("decimal(38,12)").alias("left_money")))
        met = fits.join(used, F.col("g").eqNullSafe(F.col("_g")))
        whole = met.where("over is null or block < over").select("g", "operation_id")
        one = met.where("block = over").select("g", "pos", "operation_id", "tokens", "cost", "over", "left_room", "left_money")
        read = checkpoint(_in_order(one))
        admitted = checkpoint(admitted.unionByName(whole).unionByName(read.where("ok").select("g", "operation_id")))
        state = checkpoint(read.groupBy("g", "over").agg(F.min("left_room").alias("room"), F.min("left_money").alias("money")).select("g", (F.col("over") + 1).alias("next"), "room", "money").where(F.col("next") < parts))
    return admitted, rounds


def _in_order(rows: DataFrame) -> DataFrame:
    """One block of each group, admitted one by one: with ``ok`` and what is left after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, room, money = object(), 0, 0
        for batch in batches:
            ok, rooms, moneys = [], [], []
            for g, tokens, cost, r, m in zip(*(batch.column(n).to_pylist() for n in ("g", "tokens", "cost", "left_room", "left_money")), strict=True):
                if g != at:
                    at, room, money = g, r, m
                fits = tokens <= room and cost <= money
                if fits:
                    room, money = room - tokens, money - cost
                ok.append(fits)
                rooms.append(room)
                moneys.append(money)
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("operation_id"), batch.column("over"), pa.array(ok, pa.bool_()), pa.array(rooms, pa.int64()), pa.array(moneys, pa.decimal128(38, 12))], ["g", "operation_id", "over", "ok", "left_room", "left_money"])

    kind = rows.schema
    schema = f"g {kind['g'].dataType.simpleString()}, operation_id {kind['operation_id'].dataType.simpleString()}, over int, ok boolean, left_room bigint, left_money decimal(38,12)"
    return rows.repartition("g").sortWithinPartitions("g", "pos", "operation_id").mapInArrow(run, schema)


def release(reserved: DataFrame, gone: DataFrame) -> DataFrame:
    """Reservations left and the totals, never below zero."""
    left = reserved.join(gone.select("operation_id").distinct(), "operation_id", "left_anti")
    return left.agg(F.greatest(F.coalesce(F.sum("tokens"), F.lit(0)), F.lit(0)).alias("tokens"), F.greatest(F.coalesce(F.sum("cost"), F.lit(0.0)), F.lit(0.0)).alias("cost"))


def enqueue(sessions: DataFrame, generations: DataFrame, bank: str, policy: str, at: str) -> DataFrame:
    """The generations that sessions add: primary, not empty, this version not live.

    A version acknowledged under this policy is left out, unless another version of its
    session is in flight and would replace it.  One that failed before keeps its
    attempts; an acknowledged hash under another policy, or none, marks a repair.
    """
    live = generations.where(F.col("state").isin(*ACTIVE)).select(*GENERATION_KEY).distinct()
    failed = generations.where("state = 'failed'").groupBy(*GENERATION_KEY).agg(F.max("attempt_count").alias("kept"))
    flying = generations.where(F.col("state").isin("submitted", "processing")).groupBy(*SESSION_KEY).agg(F.collect_set("canonical_hash").alias("_flying"))
    new = sessions.where((F.col("classification") == "primary") & (F.col("status") != "empty_after_normalization") & F.col("canonical_hash").isNotNull())
    new = new.join(live, list(GENERATION_KEY), "left_anti").join(flying, list(SESSION_KEY), "left")
    other = F.coalesce(F.exists("_flying", lambda h: h != F.col("canonical_hash")), F.lit(False))
    current = (F.col("acknowledged_hash") == F.col("canonical_hash")) & (F.col("acknowledged_policy") == policy)
    new = new.where(other | ~F.coalesce(current, F.lit(False))).join(failed, list(GENERATION_KEY), "left")
    ids = next_operation_ids(new, generations, bank)
    repair = F.col("acknowledged_hash").isNotNull() & ~F.col("acknowledged_policy").eqNullSafe(F.lit(policy))
    return new.join(ids, ["document_id", "canonical_hash"]).select(*GENERATION_KEY, "operation_id", F.lit("queued").alias("state"), F.lit(at).alias("queued_at"), F.coalesce("kept", F.lit(0)).alias("attempt_count"), F.lit(policy).alias("retain_policy_version"), repair.alias("repair"))
