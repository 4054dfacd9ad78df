"""The three end-to-end jobs: build features (or update some days), score days, validate models."""

from seagrid.plans.days import DayOutputs, score_days
from seagrid.plans.features import build_features
from seagrid.plans.incremental import affected_days, update_features
from seagrid.plans.validation import validate

__all__ = ["DayOutputs", "affected_days", "build_features", "score_days", "update_features", "validate"]
