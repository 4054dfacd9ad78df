"""Scored cells, ranked zones and the daily document for every day at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from seagrid.grid import Grid
from seagrid.operators import (
    assign_zones, classify, daily_payload, rank_zones, score_cells, zone_summary,
)
from seagrid.rules import RULES, Rules
from seagrid.session import settle


@dataclass(frozen=True)
class DayOutputs:
    cells: DataFrame
    zones: DataFrame
    payload: DataFrame


def score_days(
    features: DataFrame, grid: Grid, model: PipelineModel | None = None,
    model_features: Sequence[str] = (), validated: bool = False, rules: Rules = RULES,
    plane: DataFrame | None = None, generated_at: dt.datetime | None = None,
) -> DayOutputs:
    """Zones come before scores, so a model that uses the coast distance finds
    it. The scored cells are written once and feed both zones and documents.
    Days that lack one of the model's sources are scored by the physics index;
    cells, zones and documents of each day say which it was. Documents state
    `generated_at` where it is given."""
    zoned = assign_zones(features.drop("dist_coast_km"), grid, rules=rules, plane=plane)
    scored = score_cells(zoned, model, model_features, validated)
    cells = settle(classify(scored, rules))
    zones = rank_zones(zone_summary(cells, grid, rules=rules))
    return DayOutputs(cells, zones, daily_payload(cells, zones, grid, rules, generated_at=generated_at))
