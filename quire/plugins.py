"""The surfaces that users plug into: scorers, validators, maskers, providers, advisor rules, drivers, and SQL functions of all rules."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Scorer(ABC):
    """Scores pairs of source and target, from 0 to 1, in batches."""

    @abstractmethod
    def score(self, source: pd.Series, target: pd.Series) -> pd.Series: ...

    def column(self) -> Callable[[Column, Column], Column]:
        """The scorer as a column function that runs on Arrow batches; null pairs are scored as empty ones."""
        return F.pandas_udf(lambda s, t: self.score(s.fillna(""), t.fillna("")).clip(0.0, 1.0).astype("float64"), "double")


@dataclass(frozen=True)
class Finding:
    valid: bool = True
    code: str = ""
    message: str = ""
    action: str = ""


class Validator(ABC):
    """Judges a pair of source and target."""

    @abstractmethod
    def check(self, source: str, target: str) -> Finding: ...

    def column(self) -> Callable[[Column, Column], Column]:
        def run(source: pd.Series, target: pd.Series) -> pd.DataFrame:
            found = [self.check(s or "", t or "") for s, t in zip(source, target, strict=True)]
            return pd.DataFrame([vars(f) for f in found], columns=["valid", "code", "message", "action"])

        return F.pandas_udf(run, "valid boolean, code string, message string, action string")


class Masker(ABC):
    """Names the spans of a text that must not change."""

    family: str

    @abstractmethod
    def spans(self, text: str) -> list[tuple[int, int]]: ...

    def column(self) -> Callable[[Column], Column]:
        return F.pandas_udf(lambda texts: texts.map(lambda t: [{"start": a, "end": b} for a, b in self.spans(t or "")]), "array<struct<start:int,end:int>>")


class Provider(ABC):
    """Translates batches of texts."""

    @abstractmethod
    def translate(self, texts: list[str]) -> list[str]: ...

    def drafts(self, blocks: DataFrame, text: str = "source_text", out: str = "draft_text") -> DataFrame:
        """blocks with drafts; null texts stay null. Every batch is one call, and memory holds one batch."""

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                full = texts.dropna()
                yield pd.Series(self.translate(list(full)), index=full.index, dtype="object").reindex(texts.index)

        def series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from run(batches)

        series.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return blocks.withColumn(out, F.pandas_udf(series, "string")(F.col(text)))


@dataclass
class MockProvider(Provider):
    """Known answers by text; others are marked with the target language. Fails on texts that it is told to fail on."""

    target: str = "zh"
    answers: dict[str, str] = field(default_factory=dict)
    fails: tuple[str, ...] = ()

    def translate(self, texts: list[str]) -> list[str]:
        for t in texts:
            if any(f in t for f in self.fails):
                raise RuntimeError("provider failed as it was told to")
        return [self.answers.get(t, f"[{self.target}] {t}") for t in texts]


class EchoProvider(Provider):
    """Returns what it gets, for rehearsals that cost nothing."""

    def translate(self, texts: list[str]) -> list[str]:
        return list(texts)


@dataclass(frozen=True)
class AdvisorRule:
    """A rule over signals of documents: where it holds, each mode loses its penalty."""

    name: str
    holds: Column
    penalties: dict[str, float]


def advise(signals: DataFrame, rules: list[AdvisorRule], modes: dict[str, float], sensitivity: float = 1.0) -> DataFrame:
    """signals with a score a mode (1 less its base penalty and those of the rules that hold, 0 at least), the best mode (of equal ones
    the first), and the names of the rules that cost some mode."""
    hit = lambda r: F.coalesce(r.holds, F.lit(False))
    scores = {}
    for m, base in modes.items():
        lost = sum((F.when(hit(r), r.penalties.get(m, 0.0) * sensitivity).otherwise(0.0) for r in rules), F.lit(float(base)))
        scores[m] = F.bround(F.greatest(F.lit(0.0), 1 - lost), 3)
    ranked = F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("k"), F.lit(m).alias("mode")) for k, (m, s) in enumerate(scores.items())])
    fired = F.filter(F.array(*[F.when(hit(r) & F.lit(any(p > 0 for p in r.penalties.values())), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return signals.withColumns({f"score_{m}": s for m, s in scores.items()} | {"recommended": F.array_max(ranked)["mode"], "reasons": fired})


_DRIVERS: dict[str, tuple[Callable[..., object], bool]] = {}


def register_driver(name: str, factory: Callable[..., object], local: bool = False) -> None:
    """Makes a reader of documents known by name; local ones send nothing away. A name that is taken by another factory is an error."""
    if name in _DRIVERS and _DRIVERS[name][0] is not factory:
        raise ValueError(f"driver {name} is registered already")
    _DRIVERS[name] = (factory, local)


def driver(name: str, upload: bool = True, **options: object) -> object:
    """The driver of a name; without leave to upload only local ones."""
    if name not in _DRIVERS:
        raise KeyError(f"unknown driver {name}; known are {', '.join(sorted(_DRIVERS)) or 'none'}")
    factory, local = _DRIVERS[name]
    if not local and not upload:
        raise PermissionError(f"driver {name} sends pages away, which is not allowed")
    return factory(**options)


def sql_functions() -> dict[str, tuple[str, str, Column]]:
    """Rules that SQL users can call: name, parameters with types, result type, and the rule over columns of those names."""
    from quire.functions import defects, marks, names, script
    from quire.functions import text as tx

    c = F.col
    return {
        "quire_tokens": ("t string", "bigint", script.token_count(c("t"))),
        "quire_collapsed": ("t string", "string", tx.collapsed(c("t"))),
        "quire_page_number": ("t string", "boolean", tx.is_bare_page_number(c("t"))),
        "quire_heading": ("t string", "boolean", tx.looks_like_heading(c("t"))),
        "quire_lang": ("t string", "string", names.lang_base(c("t"))),
        "quire_chapter": ("t string", "string", names.chapter_id(c("t"))),
        "quire_cjk": ("t string", "boolean", names.contains_cjk(c("t"))),
        "quire_judge_score": ("t string", "double", marks.judge_score(c("t"))),
        "quire_flag_kind": ("t string", "string", defects.flag_kind(c("t"))),
        "quire_delivery": ("failed bigint, blocked bigint, waiting bigint, completed bigint", "string", defects.delivery_verdict(c("failed"), c("blocked"), c("waiting"), c("completed"))),
        "quire_complexity": ("t string, kind string", "double", script.complexity(c("t"), c("kind"))),
    }


def register_sql(spark: SparkSession) -> list[str]:
    """Makes the rules temporary SQL functions of the session. Their bodies are the rules' own expressions as SQL text, so they stay in the JVM."""
    made = []
    for name, (parameters, kind, rule) in sql_functions().items():
        plan = spark.createDataFrame([], parameters).select(rule.alias("x"))._jdf.queryExecution().analyzed()
        body = plan.expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
        made.append(name)
    return made
