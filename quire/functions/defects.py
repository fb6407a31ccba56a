"""Defect flags and statuses as Column expressions: severities, routing, what may ship, what a client sees."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and categories that flags carry, prefixes of lifecycle flags, states, thresholds.
ECHO = ("Target identical to source", "Target keeps nearly all source words", "Target reads as source-language residue")
STRUCTURAL = (
    "Empty target text", "html_structure_mismatch", "HTML delta failure", "Prompt template XML artifacts", "Repetitive loop hallucination", "repetition", "loop hallucination",
    "repair_structural_failure", "Repair error", "Drafting error", "Math span mismatch", "Undelimited math", "Hallucinated LaTeX", "email_token_corrupt", "math_token_corrupt",
    "soup_token_corrupt", "code_token_corrupt", "cite_token_corrupt", "Residual mask token", "Omission suspected", "Numeric fidelity", "Visual witness discrepancy",
    "Target text suspiciously truncated", "Target text suspiciously inflated", "script density", "carries no letters at all", "Foreign-script text", "Added reference", "Prompt scaffold",
    "Glossary term violation", "terminology_consistency:", "Heading label dropped", "Table grid mismatch", "Table dropped", *ECHO,
)
FORMAT_ONLY = ("HTML delta failure", "html_structure_mismatch", "Target text suspiciously truncated", "Target text suspiciously inflated")
CRITICAL = (
    "Empty target text", "email_token_corrupt", "math_token_corrupt", "soup_token_corrupt", "code_token_corrupt", "cite_token_corrupt", "Residual mask token", "Numeric fidelity",
    "Math span mismatch", "Undelimited math", "Hallucinated LaTeX", "Omission suspected", "Table dropped", "carries no letters at all", "Added reference", "Prompt scaffold",
    "Prompt template XML artifacts", "Repetitive loop hallucination", "loop hallucination", "repair_structural_failure", *ECHO,
)
STRUCTURAL_CATEGORIES = (
    "empty_target", "numeric_fidelity", "omission", "table_dropped", "table_grid", "heading_label", "macro_alignment", "added_reference", "prompt_scaffold", "prompt_leak", "repetition",
    "math_span", "undelimited_math", "hallucinated_latex", "terminology_consistency", "html_structure_mismatch", "html_formatting_drift", "email_token_corrupt", "soup_token_corrupt",
    "math_token_corrupt", "cite_token_corrupt", "code_token_corrupt", "residual_mask_token", "visual_witness", "length_truncated", "length_inflated", "script_density", "foreign_script",
)
FORMAT_CATEGORIES = ("html_formatting_drift", "html_structure_mismatch", "length_truncated", "length_inflated")
NUMERIC_ADVISORY = ("numeric_advisory:", "numeric_order_differs:", "numeric_repeat_shortfall:")
SEMANTIC_ONLY = ("judge", "Semantic", "semantic")
STRUCTURED = r"^([a-z][a-z0-9_]*):(minor|major|critical):"
KINDS = (
    ("Drafting error:", "drafting_transient"), ("Drafting unrecoverable:", "non_retryable"), ("Drafting config error:", "retryable_config"), ("Repair error:", "repair_transient"),
    ("untranslated:", "untranslated"),
)
TRIAGE = ("needs_human_review", "mqm_critical_blocked")
SHIPPABLE_FLOOR, REPAIR_BURDEN = 0.5, 0.15
TERMINAL_JOBS, PARKED = ("completed", "failed", "cancelled"), ("awaiting_agent", "needs_attention")
PRESERVED_SKIPS = ("skip_translate", "facsimile_preserved_opaque", "table_preserved_source")


def _any_of(flag: Column, parts: Iterable[str]) -> Column:
    """Whether a flag holds one of the parts: one alternation of literals, so a flag is read once."""
    return flag.rlike("|".join(rf"\Q{p}\E" for p in parts))


def _full(flags: Column) -> Column:
    """Flags without null and empty ones; none for a null array."""
    return F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda f: f.isNotNull() & (f != ""))


def category(flag: Column) -> Column:
    """The category of a structured flag, else empty."""
    return F.regexp_extract(flag, STRUCTURED, 1)


def structured_severity(flags: Column) -> Column:
    """The worst severity that structured flags declare, or null."""
    worst = F.array_max(F.transform(_full(flags), lambda f: F.coalesce(F.array_position(F.array(*map(F.lit, ("minor", "major", "critical"))), F.regexp_extract(f, STRUCTURED, 2)), F.lit(0))))
    return F.when(worst > 0, F.element_at(F.array(*map(F.lit, ("minor", "major", "critical"))), worst.cast("int")))


def has_critical(flags: Column) -> Column:
    return F.exists(_full(flags), lambda f: _any_of(f, CRITICAL) | (F.regexp_extract(f, STRUCTURED, 2) == "critical"))


def has_structural(flags: Column) -> Column:
    return F.exists(_full(flags), lambda f: _any_of(f, STRUCTURAL) | F.regexp_extract(f, STRUCTURED, 2).isin("major", "critical") | category(f).isin(*STRUCTURAL_CATEGORIES))


def declared_severity(flags: Column) -> Column:
    """The worst of what structured flags declare and what markers mean; null where neither says anything."""
    return F.when(has_critical(flags), F.lit("critical")).when(has_structural(flags), F.lit("major")).otherwise(structured_severity(flags))


def format_only(flags: Column) -> Column:
    """Whether there are flags and all are cheap format defects."""
    full = _full(flags)
    return (F.size(full) > 0) & F.forall(full, lambda f: _any_of(f, FORMAT_ONLY) | category(f).isin(*FORMAT_CATEGORIES))


def numeric_defect(flags: Column) -> Column:
    """Whether a flag, not an advisory one, is about numbers."""
    return F.exists(_full(flags), lambda f: F.lower(f).contains("numeric") & ~f.rlike("^(?:" + "|".join(NUMERIC_ADVISORY) + ")"))


def defect_class(flags: Column, score: Column, threshold: float) -> Column:
    """PASS, DETERMINISTIC_DEFECT or SEMANTIC_DOUBT: named invariants come first, then doubts by judge or score."""
    full = _full(flags)
    doubt = (F.size(full) > 0) & F.forall(full, lambda f: _any_of(f, SEMANTIC_ONLY)) | F.coalesce(score < threshold, F.lit(False))
    return F.when(has_critical(flags) | has_structural(flags), F.lit("DETERMINISTIC_DEFECT")).when(doubt, F.lit("SEMANTIC_DOUBT")).otherwise(F.lit("PASS"))


def flag_kind(flag: Column) -> Column:
    """What a flag means for a resume: a triage verdict, a lifecycle failure by its prefix, or quality."""
    out = F.when(flag.isin(*TRIAGE), F.lit("triage_verdict"))
    for prefix, kind in KINDS:
        out = out.when(flag.startswith(prefix), F.lit(kind))
    return out.otherwise(F.lit("quality"))


def shippable(score: Column, flags: Column, threshold: float) -> Column:
    """No flags, and a score (null: 0) of at least the threshold, which never falls under its floor."""
    return (F.size(F.coalesce(flags, F.array().cast("array<string>"))) == 0) & (F.coalesce(score, F.lit(0.0)) >= max(SHIPPABLE_FLOOR, threshold))


def delivery_verdict(failed: Column, blocked: Column, waiting: Column, completed: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    return F.when(~none(failed) | ~none(blocked) | none(completed), F.lit("blocked")).when(~none(waiting), F.lit("warning")).otherwise(F.lit("passed"))


def job_status(stored: Column, total: Column, done: Column, agent: Column, writer: Column, grace: Column) -> Column:
    """(status, interrupted): a stored end stands, all blocks done is completed, then parked agents, a live writer or grace; else it failed."""
    status = (
        F.when(stored.isin(*TERMINAL_JOBS), stored).when((total > 0) & (done >= total), F.lit("completed")).when(agent.isin(*PARKED), agent)
        .when(F.coalesce(writer, F.lit(False)) | F.coalesce(grace, F.lit(False)), F.lit("running"))
    )
    return F.struct(F.coalesce(status, F.lit("failed")).alias("status"), status.isNull().alias("interrupted"))


def difficulty(total: Column, repaired: Column, failed: Column) -> Column:
    """(hard, repair_share): whether repairs and failures are so large a share that rendering should step down."""
    share = F.when(total > 0, (repaired + failed) / total).otherwise(F.lit(0.0))
    return F.struct((share >= REPAIR_BURDEN).alias("hard"), F.round(share, 3).alias("repair_share"))


def over_budget(cost: Column, budget: Column, unmeasured: Column) -> Column:
    """null, 'over' or 'unenforceable': under a cap, spend that cannot be measured stops a job as well."""
    return F.when(budget.isNull(), None).when(cost.isNull() & F.coalesce(unmeasured, F.lit(False)), F.lit("unenforceable")).when(cost > budget, F.lit("over"))


def skip_family(flag: Column, prefix: str = "render_skip:") -> Column:
    """The family of a render skip without its parameters; null for other flags and empty families."""
    return F.when(flag.startswith(prefix), F.nullif(F.trim(F.substring_index(F.substr(flag, F.lit(len(prefix) + 1)), "(", 1)), F.lit("")))
