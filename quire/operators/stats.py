"""Rollups over blocks: job statistics, score quantiles, flags, indicators, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Score sources that are no measurements, those that are opinions, and the share of lowest scores.
UNMEASURED, CALIBRATED, BOTTOM = ("heuristic", "mock", "tm", "skip"), ("llm_judge", "tiered"), 0.15
#: Indicator definitions: name, direction (1: more is better), tolerance, floor, ceiling.
KPIS = [("pass_rate", 1, 0.01, 0.9, None), ("avg_qe", 1, 0.02, 0.5, None), ("term_consistency", 1, 0.02, None, None), ("cost_usd", -1, 0.05, None, None), ("latency_s", -1, 0.1, None, 120.0)]


def is_scored(score: Column, skip: Column, tm_hit: Column, source: Column) -> Column:
    """Whether a score was measured: not of a skipped block, nor of an unjudged memory hit, nor a label."""
    s = F.coalesce(source, F.lit(""))
    return score.isNotNull() & ~F.coalesce(skip, F.lit(False)) & (~F.coalesce(tm_hit, F.lit(False)) | s.isin(*CALIBRATED)) & ~s.isin(*UNMEASURED)


def job_stats(blocks: DataFrame, key: str = "job_id") -> DataFrame:
    """One row a job: counts by state, the mean score (0 with qe_measured false if none), the mean of the lowest 15 %.

    The lowest scores come from per-job counts of distinct scores, so a job of any size is never sorted in one task.
    """
    skip = F.coalesce("skip_translate", F.lit(False))
    scored = is_scored(F.col("mtqe_score"), F.col("skip_translate"), F.col("tm_hit"), F.col("mtqe_score_source"))
    in_state = lambda *s: F.count_if(F.col("status").isin(*s))
    out = blocks.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_all"), F.count_if(skip).alias("skipped"), F.count_if(~skip).alias("total"),
        F.count_if(F.col("status").isin("mtqe_passed", "repaired") & ~skip).alias("completed"),
        *[in_state(s).alias(s) for s in ("drafted", "repair_pending", "repaired", "failed", "needs_human", "blocked_human")],
        F.avg(F.when(scored, F.col("mtqe_score"))).alias("_avg"), F.count_if(scored).alias("scored"),
    )
    low = bottom_mean(blocks.filter(scored), key, "mtqe_score")
    return out.join(low, key, "left").select(
        *[c for c in out.columns if c != "_avg"], F.coalesce("_avg", F.lit(0.0)).alias("avg_qe_score"), F.col("_avg").isNotNull().alias("qe_measured"), F.coalesce("bottom_mean", F.lit(0.0)).alias("bottom_15_avg_qe")
    )


def bottom_mean(rows: DataFrame, key: str, score: str, share: float = BOTTOM) -> DataFrame:
    """key, bottom_mean: the mean of the lowest max(1, int(share n)) scores."""
    per = rows.groupBy(key, score).count()
    before = Window.partitionBy(key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_before": F.coalesce(F.sum("count").over(before), F.lit(0)), "_n": F.sum("count").over(Window.partitionBy(key))})
    take = F.least(F.greatest(F.greatest(F.lit(1), F.floor(F.col("_n") * share)) - F.col("_before"), F.lit(0)), F.col("count"))
    per = per.withColumn("_take", take)
    return per.groupBy(key).agg((F.sum(F.col(score) * F.col("_take")) / F.sum("_take")).alias("bottom_mean"))


def quality_report(blocks: DataFrame, key: str, score: str = "mtqe_score", passed: float = 0.7) -> DataFrame:
    """Mean, extremes, P10, P50 and P90 with linear interpolation, and the pass rate (1 for none) by key."""
    q = F.percentile(score, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = blocks.groupBy(key).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"), q.alias("_q"), F.count_if(F.col(score) >= passed).alias("_p"))
    return out.select(key, "n", "mean", "low", "high", *[F.get("_q", k).alias(n) for k, n in enumerate(("p10", "p50", "p90"))], F.coalesce(F.try_divide(F.col("_p"), F.col("n")), F.lit(1.0)).alias("pass_rate"))


def flag_histogram(blocks: DataFrame, flags: str = "error_flags") -> DataFrame:
    """Each flag without its parameters, with how many blocks carry it."""
    name = F.regexp_replace("flag", r"[(:].*$", "")
    return blocks.select(F.explode(flags).alias("flag")).groupBy(name.alias("flag")).count().withColumnRenamed("count", "n")


def compare_kpis(base: DataFrame, now: DataFrame, definitions: DataFrame) -> DataFrame:
    """name, base, now, verdict: better, worse or same by direction and tolerance; new and missing names too; NaN is unknown."""
    both = base.select("name", F.col("value").alias("base")).join(now.select("name", F.col("value").alias("now")), "name", "full_outer").join(definitions, "name", "left")
    gain = (F.col("now") - F.col("base")) * F.coalesce("direction", F.lit(1))
    verdict = (
        F.when(F.col("base").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.isnan("base") | F.isnan("now"), "unknown")
        .when(gain > F.coalesce("tolerance", F.lit(0.0)), "better").when(gain < -F.coalesce("tolerance", F.lit(0.0)), "worse").otherwise("same")
    )
    return both.select("name", "base", "now", verdict.alias("verdict"))


def benchmark_drift(base: DataFrame, now: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """REGRESSED, IMPROVED, STABLE, NEW or MISSING by case."""
    both = base.select(key, F.col(value).alias("before")).join(now.select(key, F.col(value).alias("after")), key, "full_outer")
    d = F.col("after") - F.col("before")
    return both.withColumn("drift", F.when(F.col("before").isNull(), "NEW").when(F.col("after").isNull(), "MISSING").when(d < -tolerance, "REGRESSED").when(d > tolerance, "IMPROVED").otherwise("STABLE"))


def pareto_frontier(points: DataFrame, quality: str, cost: str) -> DataFrame:
    """Points that no other dominates (at least as good and as cheap, one of both strictly), with dq / dc to the cheaper neighbour.

    In order of cost a point is on the frontier if it beats all cheaper ones: the best quality by cost is
    aggregated first, so the ordered scan reads distinct costs, not points.
    """
    best = points.groupBy(cost).agg(F.max(quality).alias("_best"))
    by_cost = Window.orderBy(cost)
    best = best.withColumn("_top", F.max("_best").over(by_cost.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("_top").isNull() | (F.col("_best") > F.col("_top")))
    dc, dq = F.col(cost) - F.lag(cost).over(by_cost), F.col("_best") - F.lag("_best").over(by_cost)
    best = best.withColumn("marginal", F.when(dc > 1e-4, dq / dc)).drop("_top")
    return points.join(best, [cost]).filter(F.col(quality) == F.col("_best")).drop("_best")


def usage_cost(usage: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Cost by key in USD, null if any model that used tokens has no price or calls that were not measured; and the cache-hit rate."""
    models = usage.select("model").distinct()  # each model's price is found once, by its prefixes
    prefixes = models.select("model", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("model"), F.lit(1))), lambda k: F.substring("model", F.lit(1), k))).alias("model_prefix"))
    found = prefixes.join(prices, "model_prefix").groupBy("model").agg(F.max_by(F.struct("input", "output", "cached_input"), F.length("model_prefix")).alias("_p"))
    rows = usage.join(found, "model", "left").select("*", "_p.*")
    plain = F.col("prompt_tokens") - F.col("cached_tokens")
    one = (plain * F.col("input") + F.col("cached_tokens") * F.col("cached_input") + F.col("completion_tokens") * F.col("output")) / 1e6
    unknown = (F.col("_p").isNull() & (F.col("prompt_tokens") + F.col("completion_tokens") > 0)) | (F.col("unmeasured_calls") > 0)
    return rows.groupBy(key).agg(F.when(~F.bool_or(unknown), F.sum(one)).alias("cost_usd"), F.least(F.coalesce(F.try_divide(F.sum("cached_tokens"), F.sum("prompt_tokens")), F.lit(0.0)), F.lit(1.0)).alias("cache_hit_rate"))
