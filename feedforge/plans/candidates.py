"""The candidate pipeline: sources, hydrators, filters, scorers, selector, side effects.

A stage is a function over DataFrames that hold many requests at once.
``requests`` has request_id and user_id; candidates have request_id, user_id,
item_id and ``pos``, their order inside a request.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.operators.filters import chain, kept, removed, with_removed_by
from feedforge.operators.ranking import first_ranks, top_k
from feedforge.operators.scoring import score_chain
from feedforge.operators.segments import is_bounded
from feedforge.session import written

logger = logging.getLogger(__name__)

# Room for positions of one source.
SOURCE_STRIDE = 1 << 40


@dataclass(frozen=True)
class Stage:
    """One named stage.

    ``enable`` names a boolean column of ``requests``; the stage then acts on
    the requests where it is true. ``per_request`` states of a filter or scorer
    that a row's outcome depends on rows of its own request only. It then runs
    as ``run(candidates, bounded=...)`` over all rows, and its outcome counts
    where ``enable`` is true; ``bounded`` tells whether every request is small
    enough for one task.
    """

    name: str
    run: Callable
    enable: str | None = None
    per_request: bool = False


@dataclass(frozen=True)
class Result:
    """Outcome of a pipeline run."""

    requests: DataFrame
    retrieved: DataFrame
    removed: DataFrame
    selected: DataFrame


@dataclass
class CandidatePipeline:
    """Runs the six kinds of stages in order.

    * source: ``run(requests) -> candidates``
    * hydrator: ``run(requests, candidates) -> candidates`` with the same rows
    * filter: ``run(candidates) -> candidates`` with ``removed_by``
    * scorer: ``run(candidates) -> Column`` or candidates with ``score``
    * selector: ``run(candidates) -> candidates`` with ``rank``
    * side effect: ``run(requests, selected)``; its result is ignored

    ``on_error='skip'`` leaves out a stage whose plan cannot be analysed, as
    ``'raise'`` does not. ``check_rows`` counts rows to reject a hydrator that
    loses or adds some. Candidates are read several times, by filters that
    compare rows and by stages that act on some requests only. ``materialize``
    therefore writes them to the shared folder after hydration and after the
    filters; None leaves one lazy plan.

    With stages ``per_request`` the retrieved candidates are written instead,
    and if every request fits into a task, hydrated ones are dealt by request
    once: filters, scorers and the selector find a request's rows together, so
    candidates are not written again and only the columns in use travel.
    """

    sources: Sequence[Stage] = ()
    hydrators: Sequence[Stage] = ()
    filters: Sequence[Stage] = ()
    scorers: Sequence[Stage] = ()
    selector: Stage | None = None
    side_effects: Sequence[Stage] = ()
    result_size: int = 50
    on_error: str = "skip"
    check_rows: bool = False
    materialize: Callable[[DataFrame, str], DataFrame] | None = written
    _flags: list[str] = field(default_factory=list, init=False)
    _bounded: bool = field(default=False, init=False)

    def execute(self, requests: DataFrame) -> Result:
        """Build the plan for all requests."""
        later = (*self.hydrators, *self.filters, *self.scorers, *([self.selector] if self.selector else []))
        self._flags = sorted({s.enable for s in later if s.enable})
        retrieved = self._fetch(requests)
        self._bounded = False
        if any(s.per_request for s in (*self.filters, *self.scorers)):
            retrieved = self._kept_once(retrieved, "retrieved")
            self._bounded = is_bounded(retrieved, ["request_id"])
        candidates = self._hydrate(requests, retrieved)
        if self._bounded:
            candidates = self._filter(candidates.repartition("request_id"))
        else:
            candidates = self._kept_once(candidates, "hydrated")
            candidates = self._kept_once(self._filter(candidates), "filtered")
        scored = self._score(kept(candidates))
        selected = self._select(scored).drop(*self._flags)
        self._effects(requests, selected)
        return Result(requests, retrieved.drop(*self._flags), removed(candidates).drop(*self._flags), selected)

    def _kept_once(self, df: DataFrame, name: str) -> DataFrame:
        return self.materialize(df, name) if self.materialize else df

    def _attempt(self, stage: Stage, build: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            result = build()
            result.schema
            return result
        except AnalysisException:
            if self.on_error != "skip":
                raise
            logger.exception("stage %s left out", stage.name)
            return None

    def _fetch(self, requests: DataFrame) -> DataFrame:
        flags = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in self._flags]
        flagged = requests.select("request_id", *flags)
        merged = None
        for at, stage in enumerate(self.sources):
            asked = requests if stage.enable is None else requests.where(F.col(stage.enable))
            found = self._attempt(
                stage,
                lambda: stage.run(asked)
                .withColumn("source", F.lit(stage.name))
                .withColumn("pos", F.col("pos").cast("bigint") + F.lit(at * SOURCE_STRIDE).cast("bigint")),
            )
            if found is not None:
                # Before the union, where candidates still lie as their source left them.
                found = found.join(flagged, "request_id") if flags else found
                merged = found if merged is None else merged.unionByName(found, allowMissingColumns=True)
        if merged is None:
            raise ValueError("no source gave candidates")
        return merged

    def _on_enabled(self, stage: Stage, df: DataFrame, act: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Apply ``act`` to the enabled requests and pass the others through."""
        if stage.enable is None:
            return act(df)
        acted = act(df.where(F.col(stage.enable)))
        return acted.unionByName(df.where(~F.col(stage.enable)), allowMissingColumns=True)

    def _apply(self, stage: Stage, df: DataFrame, column: str, act: Callable) -> DataFrame:
        """``act(df, [run])``, whose outcome is ``column``, on the enabled requests."""
        if not stage.per_request:
            return self._on_enabled(stage, df, lambda some: act(some, [stage.run]))
        run = partial(stage.run, bounded=self._bounded)
        if stage.enable is None:
            return act(df, [run])
        acted = act(df.withColumn("_before", F.col(column)), [run])
        outcome = F.when(F.col(stage.enable), F.col(column)).otherwise(F.col("_before"))
        return acted.withColumn(column, outcome).drop("_before")

    def _hydrate(self, requests: DataFrame, candidates: DataFrame) -> DataFrame:
        for stage in self.hydrators:
            result = self._attempt(
                stage, lambda: self._on_enabled(stage, candidates, lambda df: stage.run(requests, df))
            )
            if result is None:
                continue
            if self.check_rows and result.count() != candidates.count():
                logger.error("hydrator %s changed the number of rows and is left out", stage.name)
                continue
            candidates = result
        return candidates

    def _filter(self, candidates: DataFrame) -> DataFrame:
        candidates = with_removed_by(candidates)
        for stage in self.filters:
            result = self._attempt(stage, lambda: self._apply(stage, candidates, "removed_by", chain))
            if result is not None:
                candidates = result
        return candidates

    def _score(self, candidates: DataFrame) -> DataFrame:
        if "score" not in candidates.columns:
            candidates = candidates.withColumn("score", F.lit(0.0))
        for stage in self.scorers:
            result = self._attempt(stage, lambda: self._apply(stage, candidates, "score", score_chain))
            if result is not None:
                candidates = result
        return candidates

    def _select(self, candidates: DataFrame) -> DataFrame:
        def default(df: DataFrame) -> DataFrame:
            return top_k(df, self.result_size)

        if self.selector is None:
            return default(candidates)
        stage = self.selector
        if stage.enable is None:
            return first_ranks(stage.run(candidates), self.result_size)
        chosen = first_ranks(stage.run(candidates.where(F.col(stage.enable))), self.result_size)
        return chosen.unionByName(default(candidates.where(~F.col(stage.enable))), allowMissingColumns=True)

    def _effects(self, requests: DataFrame, selected: DataFrame) -> None:
        for stage in self.side_effects:
            try:
                stage.run(requests if stage.enable is None else requests.where(F.col(stage.enable)), selected)
            except Exception:
                logger.exception("side effect %s failed", stage.name)


def lookup(table: DataFrame, key: str, columns: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A hydrator that adds columns by key and keeps every row.

    One row per key is taken, whichever sorts last, so rows never double.
    """

    def run(requests: DataFrame, candidates: DataFrame) -> DataFrame:
        unique = table.groupBy(key).agg(F.max(F.struct(*columns)).alias("_found"))
        joined = candidates.join(unique, key, "left")
        return joined.withColumns({c: F.col("_found")[c] for c in columns}).drop("_found")

    return run


def column_scorer(column: Column) -> Callable[[DataFrame], Column]:
    """A scorer from a column expression."""
    return lambda df: column
