"""Settings as frozen dataclasses, and the hooks a user can replace.

Hooks are plain callables: a token counter maps Column to Column; an embedder and a log-probability
provider map an Arrow batch of texts to one of vectors or numbers and run as Pandas UDFs, so a model
is loaded once per worker. Without a provider everything counts as surprising.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .functions import text as T
from .operators import ingestion


@dataclass(frozen=True)
class Retrieval:
    """Weights and limits of retrieval."""

    least_overlap: float = 0.08
    near_duplicate: float = 0.84
    similar: float = 0.45
    penalty: float = 0.08
    most_penalty: float = 0.18
    prefetch: int = 60
    affinity: float = 0.08


@dataclass(frozen=True)
class Ingestion:
    """What makes a turn worth keeping."""

    threshold: float = 0.35
    longest: int = 1200
    profile: tuple[str, ...] = tuple(ingestion.PROFILE)
    task: tuple[str, ...] = tuple(ingestion.TASK)

    @classmethod
    def of(cls, project: str | None) -> Ingestion:
        """The policy of a project type, given by any of its names."""
        kind, base = project_type(project), cls()
        if kind == "language_tutor":
            return replace(base, threshold=0.56, profile=(*base.profile, "studying", "learning", "practicing", "aprendo", "practico"), task=(*base.task, "mistake", "grammar", "vocabulary", "pronunciation", "gramática", "vocabulario"))
        if kind == "programming_assistant":
            return replace(base, threshold=0.6, longest=1400, profile=(*base.profile, "stack", "framework", "language", "tooling"), task=(*base.task, "stacktrace", "incident", "deploy", "regression", "refactor", "asyncio"))
        return base


@dataclass(frozen=True)
class Forgetting:
    """When episodes are archived."""

    least: int = 50
    below: float = 0.3
    min_age_days: float = 7.0
    most: int = 100


#: Names of project types, and the type each stands for.
ALIASES = {"general": "general_assistant", "default": "general_assistant", "general_assistant": "general_assistant", "programming": "programming_assistant", "programming_assistant": "programming_assistant", "file_organizer": "file_organizer", "language_tutor": "language_tutor", "voice_interface": "voice_interface"}


def project_type(name: str | None) -> str:
    """The type a name stands for; an unknown name is a programming assistant."""
    return ALIASES.get((name or "").strip().lower(), "programming_assistant")


def project_types(c: Column) -> Column:
    """`project_type` of a column."""
    low = F.lower(F.trim(T.text(c)))
    return F.coalesce(*[F.when(low == k, v) for k, v in ALIASES.items()], F.lit("programming_assistant"))


def embedder(embed: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A function of texts to vectors as a Column function."""

    @pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embed(["" if t is None else t for t in s]))

    return run


def log_probabilities(score: Callable[[list[str]], list[float]] | None) -> Callable[[Column], Column]:
    """A function of texts to mean log-probabilities as a Column function; without one, null for all."""
    if score is None:
        return lambda c: F.when(c.isNull(), F.lit(None).cast("double"))

    @pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(score(["" if t is None else t for t in s]), dtype=float)

    return run


def surprising(mean_logprob: Column, perplexity_above: float) -> Column:
    """Perplexity above a threshold; what has no score is surprising."""
    return mean_logprob.isNull() | (F.exp(-mean_logprob) > perplexity_above)


@runtime_checkable
class SemanticBackend(Protocol):
    """What retrieval asks of a semantic layer: its rows for many queries."""

    def search(self, queries: DataFrame, n: int) -> DataFrame: ...


@dataclass
class Strategies:
    """Named strategies, each a function of candidates(key, idx, output) to them with passed and score."""

    known: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def register(self, name: str, run: Callable[[DataFrame], DataFrame]) -> None:
        self.known[name] = run

    def available(self) -> list[str]:
        return sorted(self.known)

    def run(self, name: str, candidates: DataFrame) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"no strategy {name!r}; there are {', '.join(self.available())}")
        return self.known[name](candidates)


def pass_through(candidates: DataFrame) -> DataFrame:
    """Verifies nothing: every candidate passes."""
    return candidates.withColumn("passed", F.lit(True)).withColumn("score", F.lit(1.0))


def exact_match(candidates: DataFrame, expected: str = "expected", output: str = "output") -> DataFrame:
    """Passes what equals the expected text but for white space at the ends."""
    strip = lambda c: F.regexp_replace(T.text(c), r"^\s+|\s+$", "")
    ok = strip(output) == strip(expected)
    return candidates.withColumn("passed", ok).withColumn("score", F.when(ok, 1.0).otherwise(0.0))
