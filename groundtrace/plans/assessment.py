"""The whole assessment of tracks against targets, one DataFrame for each of its tables.

Building a table that meets targets reads the targets, block by block; all else runs with an action. ``persist`` keeps the
tables that others read more than once. Targets that are not valid are never clipped: each of their pairs has their code as its outcome.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrace.operators import clip, entities, normalize, quality, relation, temporal
from groundtrace.operators.quality import Policy
from groundtrace.sources import targets as areas


class Assessment:
    """N tracks (samples) against M targets under one policy."""

    def __init__(self, samples: DataFrame, targets: DataFrame, policy: Policy, parts: DataFrame | None = None) -> None:
        self.samples, self.given, self.policy, self.parts = samples, targets, policy, parts

    @cached_property
    def judged(self) -> DataFrame:
        """All targets with the code of what is wrong with them, null for valid ones."""
        return areas.judged(self.given).persist()

    @cached_property
    def targets(self) -> DataFrame:
        return self.judged.filter("code IS NULL").drop("code")

    @cached_property
    def refused(self) -> DataFrame:
        """(target_id, code) of the targets that aren't valid."""
        return self.judged.filter("code IS NOT NULL").select("target_id", "code")

    @cached_property
    def observations(self) -> DataFrame:
        return normalize.observations(self.samples)

    @cached_property
    def diagnostics(self) -> DataFrame:
        return normalize.diagnostics(self.samples, self.parts)

    @cached_property
    def decided(self) -> DataFrame:
        """Edges with their decision and usable run."""
        return quality.with_runs(quality.decisions(quality.edges(self.observations), self.policy))

    def persist(self, *names: str) -> Assessment:
        """Keeps edges and, by default, gaps, fragments, relations, segments and their placed pieces once they are computed (memory, then disk)."""
        for name in names or ("decided", "gaps", "fragments", "relations", "segments", "placed"):
            setattr(self, name, getattr(self, name).persist())
        return self

    @cached_property
    def usable(self) -> DataFrame:
        return self.decided.filter(F.col("decision") != quality.REJECTED)

    @cached_property
    def excluded(self) -> DataFrame:
        return quality.excluded_intervals(self.decided)

    @cached_property
    def gaps(self) -> DataFrame:
        return quality.gaps(self.diagnostics, self.excluded)

    @cached_property
    def constraints(self) -> DataFrame:
        return quality.gap_constraints(self.gaps, self.policy)

    @cached_property
    def fragments(self) -> DataFrame:
        return clip.fragments(self.usable, self.targets)

    @cached_property
    def stationary(self) -> DataFrame:
        return clip.stationary_points(self.usable, self.targets)

    @cached_property
    def relevance(self) -> DataFrame:
        return relation.gap_relevance(self.gaps, self.constraints, self.targets)

    @cached_property
    def relations(self) -> DataFrame:
        positioned = self.samples.filter("lon IS NOT NULL AND lat IS NOT NULL")
        told = relation.relations(positioned, self.fragments, self.gaps, self.constraints, self.targets)
        return told.unionByName(relation.refused(positioned, self.refused))

    @cached_property
    def uncertainties(self) -> DataFrame:
        return relation.uncertainties(self.relevance)

    @cached_property
    def unscreened(self) -> DataFrame:
        """Edges that are usable without having passed the screening."""
        return quality.edge_diagnostics(self.decided)

    @cached_property
    def segments(self) -> DataFrame:
        return entities.segments(self.fragments, self.stationary, self.usable)

    @cached_property
    def placed(self) -> DataFrame:
        return entities.placed_edges(entities.segment_edges(self.segments, self.usable.drop("run", "dt", "distance_m")))

    @cached_property
    def metrics(self) -> DataFrame:
        return temporal.metric_edges(self.placed, self.policy)
