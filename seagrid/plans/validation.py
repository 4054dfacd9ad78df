"""Fit the model, compare it honestly with the baselines, decide."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.operators import (
    climatology, compare_models, depth_only, evaluate_models, feature_importance,
    fit_hotspot, fleet_active_months, keep_months, physics_index, predict,
    spatial_transfer, subsample_negatives, temporal_split, validation_gate,
)
from seagrid.operators.models import FEATURES
from seagrid.rules import RULES, Rules
from seagrid.session import settle

MODELS = ("hotspot", "depth_only", "climatology", "physics_index")
# What must be said with every model.
CAVEATS = (
    "Labels are AIS fishing effort: industrial and foreign vessels, not Somali "
    "artisanal boats.",
    "Not valid in fleet-dormant months (SW monsoon); the map falls back to the "
    "physics index and safety rules there.",
    "Predicts conditions attractive for fishing activity, not catch weight and "
    "not a probability of catching fish.",
)


@dataclass(frozen=True)
class Validation:
    model: PipelineModel
    within: DataFrame
    pooled: DataFrame
    gate: DataFrame
    importance: DataFrame
    spatial: DataFrame | None
    notes: DataFrame


def validate(
    features: DataFrame, feature_names: Sequence[str] = tuple(FEATURES),
    neg_per_pos: int | None = 20, end_year: int = RULES.train_end_year, rounds: int = 400,
    all_months: bool = False, months_from_all_rows: bool = False,
    spatial: bool = False, seed: int = 42, rules: Rules = RULES,
) -> Validation:
    """Train up to `end_year`, test after it, on months with the fleet present.

    Those months are judged on unthinned training rows only; the flag
    `months_from_all_rows` lets test rows and thinning in. Training negatives
    are thinned per year, test rows never, so their base rate is the true one.
    """
    train, test = temporal_split(features, end_year)

    def thinned(df: DataFrame) -> DataFrame:
        if not neg_per_pos:
            return df
        return subsample_negatives(df, neg_per_pos, F.year("date"), seed, floor_one=False)

    # Ranked over whole planes, so before rows are taken out.
    test = physics_index(test, rules=rules)
    if not all_months:
        seen = thinned(train).unionByName(test.drop("physics_index")) if months_from_all_rows else train
        months = settle(fleet_active_months(seen, rules=rules))
        train, test = keep_months(train, months), keep_months(test, months)
    train, test = settle(thinned(train)), settle(test)

    model = fit_hotspot(train, feature_names, seed, rounds=rounds)
    scored = predict(model, test, "hotspot")
    scored = depth_only(train, scored, seed=seed, rounds=max(1, rounds * 120 // 400))
    scored = settle(climatology(train, scored))
    within = settle(compare_models(scored, MODELS))
    pooled = evaluate_models(scored, MODELS)
    unseen = None
    if spatial:
        unseen = spatial_transfer(
            train, test.drop("physics_index"), feature_names, band=rules.holdout_lat,
            seed=seed, rounds=rounds,
        )
    gate = validation_gate(within)
    notes = gate.withColumns({
        "features": F.lit(list(feature_names)),
        "train_until": F.lit(end_year),
        "dormant_months_excluded": F.lit(not all_months),
        "weather_excluded": F.lit(not {"wave_height_max", "wind_speed_max"} & set(feature_names)),
        "caveats": F.lit(list(CAVEATS)),
    })
    return Validation(
        model, within, pooled, gate, feature_importance(model, feature_names), unseen, notes
    )
