"""The ledger's tables: reads in order, listings, revisions, metadata, usage, plans of repairs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import defects

FINAL = ("mtqe_passed", "repaired", "failed", "needs_human", "blocked_human")
SORTS = {"newest": (("updated_at", True), ("id", True)), "oldest": (("updated_at", False), ("id", False)), "most_used": (("use_count", True), ("updated_at", True), ("id", True))}


def apply_verdict(blocks: DataFrame, verdict: Column) -> DataFrame:
    """blocks with policy_translate, policy_reason and skip_translate from a verdict; a skip that was there stays."""
    keep = verdict == "verdict:translate"
    before = F.coalesce("skip_translate", F.lit(False)) if "skip_translate" in blocks.columns else F.lit(False)
    return blocks.withColumns({"policy_translate": keep, "policy_reason": verdict, "skip_translate": before | ~keep})


def job_blocks(blocks: DataFrame, job: Column) -> DataFrame:
    """The blocks of a job in reading order."""
    return blocks.filter(job).orderBy("spine_index", "block_id")


def source_texts(blocks: DataFrame, job: Column) -> DataFrame:
    """The source texts of a job in reading order; no other column is read but its key and order."""
    return blocks.filter(job).select("spine_index", "block_id", "source_text").orderBy("spine_index", "block_id").select("source_text")


def segments(blocks: DataFrame) -> DataFrame:
    """(block_id, source, target) of blocks that are to be translated and have a target."""
    return blocks.filter(~F.coalesce("skip_translate", F.lit(False)) & (F.trim(F.coalesce("target_text", F.lit(""))) != "")).select("block_id", F.col("source_text").alias("source"), F.col("target_text").alias("target"))


def repair_candidates(blocks: DataFrame, threshold: float, rounds: int) -> DataFrame:
    """Blocks that a repair may take: not skipped, not finished, rounds left, and a named defect."""
    open_ = ~F.coalesce("skip_translate", F.lit(False)) & ~F.col("status").isin(*FINAL) & (F.coalesce("repair_rounds", F.lit(0)) < rounds)
    return blocks.filter(open_ & (defects.defect_class(F.col("error_flags"), F.col("mtqe_score"), threshold) == "DETERMINISTIC_DEFECT"))


def memory_page(memory: DataFrame, limit: int, offset: int = 0, sort: str = "newest", where: Column | None = None, query: str | None = None) -> DataFrame:
    """One page of a memory, every row with the counts of what the filter lets through: total, machine, human, never_used.

    query is looked for in both texts as it is, without case. Beyond the first rows, Spark keeps offset + limit a task.
    """
    if sort not in SORTS:
        raise ValueError(f"unknown sort: {sort}")
    rows = memory if where is None else memory.filter(where)
    if query:
        rows = rows.filter(F.lower("src_text").contains(query.lower()) | F.lower("tgt_text").contains(query.lower()))
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("provenance") == "machine").alias("machine"),
        F.count_if(F.col("provenance") == "human_pe").alias("human"), F.count_if(F.col("use_count") == 0).alias("never_used"),
    )
    page = rows.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in SORTS[sort]]).offset(offset).limit(limit)
    return page.select("*", *[counts.select(c).scalar().alias(c) for c in counts.columns])


def entry_counts(memory: DataFrame) -> DataFrame:
    """Rows by language pair."""
    return memory.groupBy("src_lang", "tgt_lang").agg(F.count(F.lit(1)).alias("entries"))


def list_jobs(jobs: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
    """The latest jobs."""
    return (jobs if where is None else jobs.filter(where)).orderBy(F.col("enqueued_at").desc(), "job_id").limit(limit)


def enqueue(jobs: DataFrame, news: DataFrame, now: float, most: int, attempts: int = 3) -> DataFrame:
    """jobs after submissions (job_id, tenant_id, priority, at): an id that lives or is completed stays as it is, a failed or cancelled one
    of the same tenant is queued again, a new one is added while fewer than `most` are queued, by at and id.

    Of several submissions of an id the first counts.
    """
    first = news.groupBy("job_id").agg(F.min_by(F.struct("tenant_id", "priority", "at"), F.struct("at", "tenant_id", "priority")).alias("n"))
    both = jobs.alias("j").join(first.alias("f"), "job_id", "left")
    again = F.col("n").isNotNull() & F.col("status").isin("failed", "cancelled") & (F.col("tenant_id") == F.col("n.tenant_id"))
    changed = {"status": F.lit("queued"), "attempts": F.lit(0), "priority": F.col("n.priority"), "enqueued_at": F.lit(now)}
    kept = both.select(*[F.when(again, changed[c].cast(t)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c, t in jobs.dtypes])
    fresh = first.join(jobs.select("job_id"), "job_id", "left_anti").orderBy("n.at", "job_id").limit(most)  # no more can ever fit
    room = F.lit(most) - jobs.filter("status = 'queued'").agg(F.count(F.lit(1))).scalar()
    fresh = fresh.withColumn("place", F.row_number().over(Window.orderBy("n.at", "job_id"))).filter(F.col("place") <= room)
    made = {"job_id": F.col("job_id"), "tenant_id": F.col("n.tenant_id"), "priority": F.col("n.priority"), "status": F.lit("queued"), "attempts": F.lit(0), "max_attempts": F.lit(attempts), "enqueued_at": F.lit(now)}
    return kept.unionByName(fresh.select(*[made.get(c, F.lit(None)).cast(t).alias(c) for c, t in jobs.dtypes]))


def heartbeat(jobs: DataFrame, beats: DataFrame, now: float, lease: float = 60.0) -> DataFrame:
    """jobs after beats (job_id, worker_id): the lease grows where that worker runs the job."""
    own = jobs.join(beats.select("job_id", "worker_id", F.lit(True).alias("_beat")).distinct(), ["job_id", "worker_id"], "left")
    hit = F.coalesce("_beat", F.lit(False)) & (F.col("status") == "running")
    changed = {"heartbeat_at": F.lit(now), "lease_expires_at": F.lit(now + lease)}
    return own.select(*[F.when(hit, changed[c].cast(t)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c, t in jobs.dtypes])


def import_revisions(blocks: DataFrame, revisions: DataFrame, job: Column) -> DataFrame:
    """Each revision (block_id, text, job_id or null) with what becomes of it: applied, unchanged, unknown, or unbound (another job's)."""
    known = blocks.select("block_id", F.col("job_id").alias("_job"), "target_text", F.lit(True).alias("_known"))
    out = revisions.join(known, "block_id", "left")
    state = (
        F.when(F.col("job_id").isNotNull() & (F.col("job_id") != job), "unbound").when(F.col("_known").isNull() | (F.col("_job") != job), "unknown")
        .when(F.coalesce(F.trim("text") == F.trim("target_text"), F.lit(False)), "unchanged").otherwise("applied")
    )
    return out.select("block_id", "text", state.alias("state"))


def metadata_value(metadata: Column, key: str) -> Column:
    """One key of a JSON object, as JSON or text; null without it."""
    return F.get_json_object(metadata, f"$['{key}']")


def with_metadata(metadata: Column, key: str, value: Column) -> Column:
    """The JSON object of strings after one key is set."""
    old = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string"))))


def merged_usage(*usages: DataFrame) -> DataFrame:
    """Sums of counters by job and model over several tables of usage (job_id, model, counters ...): lifetime totals after deltas."""
    all_, *rest = usages
    for u in rest:
        all_ = all_.unionByName(u, allowMissingColumns=True)
    counters = [c for c in all_.columns if c not in ("job_id", "model")]
    return all_.groupBy("job_id", "model").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters])


def consistency_tasks(hits: DataFrame, most: int) -> DataFrame:
    """(block_id, source, expected, flag) of terms that drifted, one a block and term, of the first `most` blocks by id."""
    tasks = hits.filter("not exact").groupBy("block_id", "source").agg(F.min("expected").alias("expected"))
    chosen = tasks.select("block_id").distinct().orderBy("block_id").limit(max(most, 0))
    return tasks.join(chosen, "block_id").withColumn("flag", F.format_string("terminology_consistency:major:render '%s' as '%s'", "source", "expected"))


def pair_summary(results: DataFrame) -> DataFrame:
    """By direction: how many pairs passed, rates in percent with one place, means with four, counts by severity."""
    rate = lambda c, n: F.bround(F.avg(c.cast("double")) * 100, 1).alias(n)
    mean = lambda c: F.bround(F.avg(c), 4).alias(f"avg_{c}")
    return results.groupBy("direction").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("passed").alias("passed"), rate(F.col("passed"), "pass_rate"), mean("composite"), mean("bleu"),
        rate(F.col("polarity_kept"), "polarity_rate"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "minor")],
    )


def render_skips(flags: DataFrame, flag: str = "flag") -> DataFrame:
    """(family, lost, n): render skips by family without parameters; families kept by design lose nothing."""
    rows = flags.select(defects.skip_family(F.col(flag)).alias("family")).filter("family is not null")
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("lost", ~F.col("family").isin(*defects.PRESERVED_SKIPS))


def out_of_bounds(kpis: DataFrame, bounds: DataFrame) -> DataFrame:
    """(run_id, name, value, violation) of indicators under their floor, over their ceiling or not finite."""
    out = kpis.join(F.broadcast(bounds.select("name", "floor", "ceiling").limit(1000)), "name")  # one row an indicator, a fixed handful
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    what = F.when(~finite, "non-finite").when(F.col("value") < F.col("floor"), "below floor").when(F.col("value") > F.col("ceiling"), "above ceiling")
    return out.withColumn("violation", what).filter("violation is not null").select("run_id", "name", "value", "violation")


def expectation_failures(reports: DataFrame) -> DataFrame:
    """reports (total, delivered, verbatim, source_kept, errors, missing_assets, and limits, null where there is none) with the names of limits that are missed."""
    ratio = lambda n: F.when(F.col("total") > 0, n / F.col("total")).otherwise(F.lit(1.0))
    tests = {
        "max_errors": F.col("errors") > F.coalesce("max_errors", F.lit(0)), "max_missing_assets": F.col("missing_assets") > F.coalesce("max_missing_assets", F.lit(0)),
        "max_source_kept": F.col("source_kept") > F.col("max_source_kept"), "min_accounted_ratio": ratio(F.col("delivered") + F.col("verbatim")) < F.col("min_accounted_ratio"),
        "min_delivered_ratio": ratio(F.col("delivered")) < F.col("min_delivered_ratio"),
    }
    return reports.withColumn("failures", F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull()))


def differing_keys(prior: Column, requested: Column, ignored: tuple[str, ...] = ("dry_run", "rehearsal_auto")) -> Column:
    """Keys of a requested map whose values differ from a prior map's, in order; none without a prior one."""
    keys = F.filter(F.map_keys(requested), lambda k: ~k.isin(*ignored) & ~F.element_at(requested, k).eqNullSafe(F.try_element_at(prior, k)))
    return F.when(prior.isNull() | (F.size(prior) == 0), F.array().cast("array<string>")).otherwise(F.array_sort(keys))


def step_key(kind: Column, inputs: Column, params: Column) -> Column:
    """The content address of a step: SHA-256 of its inputs in order, kind and parameters (a map of strings) as JSON with sorted keys."""
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    listed = F.array_join(F.transform(inputs, quoted), ", ")
    named = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))), ", ")
    return F.sha2(F.concat(F.lit('{"i": ['), listed, F.lit('], "k": '), quoted(kind), F.lit(', "p": {'), named, F.lit("}}")), 256)
