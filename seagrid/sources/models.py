"""Models stored together with what their validation found."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class StoredModel(NamedTuple):
    """A model, the features it needs, whether it passed its gate, and its notes."""

    model: PipelineModel
    features: list[str]
    validated: bool
    notes: Row


def save_model(
    model: PipelineModel, notes: DataFrame, metrics: DataFrame, path: str, trained_at: dt.datetime,
) -> None:
    """Write the model and one row of notes beside it: the gate and features as
    in `notes`, the rows of `metrics`, and the training date."""
    lines = metrics.agg(F.collect_list(F.struct(*metrics.columns))).scalar()
    stored = notes.withColumns({"metrics": lines, "trained_at": F.lit(trained_at).cast("timestamp")})
    model.write().overwrite().save(f"{path}/model")
    stored.coalesce(1).write.mode("overwrite").json(f"{path}/notes")


def load_model(spark: SparkSession, path: str) -> StoredModel:
    """Read what `save_model` wrote. A model counts as validated only if its
    stored gate says so."""
    notes = spark.read.json(f"{path}/notes").first()
    found = notes.asDict()
    return StoredModel(
        PipelineModel.load(f"{path}/model"), list(found.get("features") or []),
        found.get("beats_baselines") is True, notes,
    )
