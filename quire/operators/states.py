"""State over time: block states and merges, the job queue, budgets, routing and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The edges of the state machine; a state may always stay what it is.
EDGES = {
    "pending": ("drafted", "mtqe_passed", "repair_pending", "failed"),
    "drafted": ("mtqe_passed", "repair_pending", "needs_human", "blocked_human", "failed"),
    "repair_pending": ("repaired", "mtqe_passed", "needs_human", "blocked_human", "failed"),
    "mtqe_passed": ("repaired", "repair_pending", "needs_human", "blocked_human", "failed"),
    "repaired": ("mtqe_passed", "repair_pending", "needs_human", "blocked_human", "failed"),
    "needs_human": ("mtqe_passed", "repaired", "repair_pending", "blocked_human", "failed"),
    "blocked_human": ("mtqe_passed", "repaired", "needs_human", "failed"),
    "failed": ("needs_human", "blocked_human", "repaired", "mtqe_passed"),
}
TERMINAL = ("mtqe_passed", "repaired", "failed", "needs_human", "blocked_human")


def can_transition(old: Column, new: Column) -> Column:
    ok = old == new
    for a, to in EDGES.items():
        ok = ok | ((old == a) & new.isin(*to))
    return F.coalesce(ok, F.lit(False))


def merge_checkpoints(blocks: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("job_id", "block_id")) -> DataFrame:
    """blocks after guarded updates: a null keeps what is stored, an edge that the machine lacks leaves the row alone. keys must be unique in updates."""
    news = [c for c in updates.columns if c not in keys]
    u = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in news], F.lit(True).alias("_hit"))
    out = blocks.join(u, list(keys), "left")
    allowed = F.coalesce(F.col("_hit") & (F.col("_status").isNull() | can_transition(F.col("status"), F.col("_status"))), F.lit(False))
    return out.select(*keys, *[F.when(allowed, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in news else F.col(c) for c in blocks.columns if c not in keys])


def delivered(target: Column, draft: Column, source: Column) -> Column:
    """The text that ships: the target, else the draft, else the source; empty counts as missing."""
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(full(target), full(draft), source)


def progress_percent(total: Column, finalized: Column, drafted: Column) -> Column:
    done = F.least(F.lit(99.9), F.bround(F.greatest(finalized, drafted) * 100.0 / total, 1))
    return F.when(total <= 0, F.lit(0.0)).when(finalized >= total, F.lit(100.0)).otherwise(done)


def claim_order(jobs: DataFrame, cap: int = 8, per_tenant: int = 2) -> DataFrame:
    """Queued jobs that may start, in order: priority, then age; at most per_tenant of a tenant and cap in all, running ones counted.

    A rank inside each tenant cuts its queue first, so the global rank reads per_tenant rows a tenant.
    """
    running = jobs.filter("status = 'running'").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_run"))
    order = [F.col("priority").desc(), F.col("enqueued_at"), F.col("job_id")]
    queued = jobs.filter("status = 'queued'").join(running, "tenant_id", "left").withColumn("_own", F.row_number().over(Window.partitionBy("tenant_id").orderBy(*order)))
    queued = queued.filter(F.col("_own") + F.coalesce("_run", F.lit(0)) <= per_tenant)
    busy = jobs.filter("status = 'running'").agg(F.count(F.lit(1))).scalar()
    first = queued.orderBy(*order).limit(cap)  # no more can start, so the rank below is over as many rows
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return ranked.filter(F.col("place") + busy <= cap).select("job_id", "tenant_id", "place")


def queue_position(jobs: DataFrame, slot: int = 3600) -> DataFrame:
    """(job_id, position) of queued jobs: one more than the jobs of higher priority or of the same that came before.

    Jobs are ranked inside their priority and slot of time; what comes before a slot is a running sum over slots, not over jobs.
    """
    queued = jobs.filter("status = 'queued'").withColumn("_slot", F.floor(F.col("enqueued_at") / slot))
    slots = queued.groupBy("priority", "_slot").agg(F.count(F.lit(1)).alias("_in"))
    ahead = Window.orderBy(F.col("priority").desc(), "_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("priority", "_slot", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_ahead"))
    inside = queued.withColumn("_rank", F.rank().over(Window.partitionBy("priority", "_slot").orderBy("enqueued_at")))
    return inside.join(slots, ["priority", "_slot"]).select("job_id", (F.col("_rank") + F.col("_ahead")).cast("int").alias("position"))


def reclaim(jobs: DataFrame, now: float) -> DataFrame:
    """jobs with leases that ran out given back: cancelled if asked for, failed after the last attempt, else queued again."""
    late = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    status = F.when(late & F.col("cancel_requested"), "cancelled").when(late & (F.col("attempts") >= F.col("max_attempts")), "failed").when(late, "queued").otherwise(F.col("status"))
    return jobs.withColumn("status", status)


def prune_terminal(jobs: DataFrame, keep: int) -> DataFrame:
    """jobs without finished ones beyond the newest `keep`."""
    over = jobs.filter(F.col("status").isin("completed", "failed", "cancelled"))
    newest = over.orderBy(F.coalesce("finished_at", "enqueued_at").desc(), "job_id").limit(keep)
    return jobs.join(over.select("job_id").exceptAll(newest.select("job_id")), "job_id", "left_anti")


def token_bucket(events: DataFrame, key: str, at: str, need: str, rate: float, burst: float) -> DataFrame:
    """events with granted, whether a bucket that fills at `rate` a second up to `burst` held what was needed. Sequential, a key at a time."""
    import pandas as pd
    from pyspark.sql import types as T

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        level, last, out = burst, None, []
        for t, n in zip(pdf[at], pdf[need], strict=True):
            level = min(burst, level + (0 if last is None else (t - last) * rate))
            last, ok = t, n <= level
            level -= n if ok else 0
            out.append(bool(ok))
        return pdf.assign(granted=out)

    return events.groupBy(key).applyInPandas(run, T.StructType([*events.schema.fields, T.StructField("granted", T.BooleanType())]))


def route(tier: Column, policy: str, attempt: Column) -> Column:
    """The model tier for a block: the policy shifts it, each retry raises it one."""
    tiers = ("trivial", "standard", "complex", "flagship")
    at = F.array_position(F.array(*[F.lit(t) for t in tiers]), tier) + {"economy": -1, "balanced": 0, "quality": 1}[policy] + attempt
    return F.element_at(F.array(*[F.lit(t) for t in tiers]), F.greatest(F.lit(1), F.least(F.lit(4), at)).cast("int"))


def draft_estimate(blocks: DataFrame, key: str, chunk: int = 8) -> DataFrame:
    """By key: blocks that cost something, their tokens, and calls."""
    billable = ~F.coalesce("skip_translate", F.lit(False)) & F.coalesce(F.col("target_text") == "", F.lit(True))
    return blocks.groupBy(key).agg(F.count_if(billable).alias("n"), F.coalesce(F.sum(F.when(billable, F.col("tokens"))), F.lit(0)).alias("tokens")).withColumn("calls", F.ceil(F.col("n") / chunk))
