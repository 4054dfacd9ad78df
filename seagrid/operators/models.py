"""Model fitting, calibration, validation and gated scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.functions import to_index
from seagrid.grid import Grid
from seagrid.operators import boosting
from seagrid.operators.climatology import climatology
from seagrid.operators.evaluate import evaluate, evaluate_within
from seagrid.operators.index import physics_index
from seagrid.operators.isotonic import fit_isotonic
from seagrid.operators.sampling import calibration_split, exclude_box, holdout_band
from seagrid.rules import RULES
from seagrid.session import settle, small_table

# The feature sets.
FEATURES = [
    "sst", "sst_gradient", "chl", "chl_lag7", "chl_lag14", "chl_age_days",
    "current_speed", "depth", "seabed_roughness", "dist_coast_km",
    "month_sin", "month_cos", "lat", "lon",
]
WEATHER_FEATURES = ["wave_height_max", "wind_speed_max"]
DEPTH_FEATURES = ["depth", "seabed_roughness"]
TRANSFER_FEATURES = [
    "sst", "sst_gradient", "chl", "chl_lag7", "chl_lag14", "chl_age_days",
    "current_speed", "month_sin", "month_cos",
]

# Stands in for a missing value: below any real reading, so a tree can put
# missing rows on their own side of a split.
MISSING = -9999.0
LABEL = "fished"


def feature_set(name: str = "default") -> list[str]:
    """default, with_weather, no_position or transfer."""
    if name == "default":
        return list(FEATURES)
    if name == "with_weather":
        return FEATURES + WEATHER_FEATURES
    if name == "no_position":
        return [f for f in FEATURES if f not in ("lat", "lon")]
    if name == "transfer":
        return list(TRANSFER_FEATURES)
    raise ValueError(f"unknown feature set {name!r}")


def _vector_stages(features: Sequence[str]) -> list:
    """Stages turning nullable columns into the vector the trees read."""
    filled = ", ".join(
        f"coalesce(nanvl(cast(`{f}` as double), cast(null as double)), {MISSING}D) as `_x_{f}`"
        for f in features
    )
    fill = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    assemble = VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="_features")
    return [fill, assemble]


def _apply(stages: Sequence, df: DataFrame) -> DataFrame:
    for stage in stages:
        df = stage.transform(df)
    return df


def _boosting(sample: float = 0.8, **settings) -> GBTClassifier:
    trees = GBTClassifier(
        featuresCol="_features", labelCol="_y", predictionCol="_class",
        subsamplingRate=sample, **settings,
    )
    return trees.setProbabilityCol("_probability").setRawPredictionCol("_raw")


def fit_hotspot(
    train: DataFrame, features: Sequence[str] | None = None, seed: int = 42,
    label: str = LABEL, rounds: int = 400, depth: int = 6, step: float = 0.05,
    sample: float = 0.8, columns: float = 0.8,
) -> PipelineModel:
    """Boosted trees on cell-day features, calibrated on the last training year.

    Positives are weighted by the class ratio (never below one). The calibration
    year decides how many rounds to keep: up to the one with the best average
    precision, looking no further once 30 rounds bring no gain; the ensemble is
    then cut there. Rounds the search does not come to are not fitted. It also fits the isotonic calibrator; the returned pipeline
    includes it, so what is validated is what is served. Each tree sees a share
    `sample` of the rows and each split a share `columns` of the features.
    """
    features = list(features or FEATURES)
    core, held = calibration_split(train, label)
    sizes = core.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    ).first()
    weight = max(1.0, sizes["neg"] / max(sizes["pos"], 1))

    def weighted(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "_y": F.col(label).cast("double"),
            "_w": F.when(F.col(label) == 1, weight).otherwise(1.0),
        })

    stages = _vector_stages(features)
    growing = _boosting(
        sample, weightCol="_w", maxDepth=depth, stepSize=step, maxIter=rounds, seed=seed,
        featureSubsetStrategy="all" if columns == 1 else str(columns), minInstancesPerNode=20,
    )
    vectors = ["_features", "_y", "_w"]
    rows = _apply(stages, weighted(core)).select(*vectors)
    if held is None:
        return PipelineModel([*stages, growing.fit(rows)])
    raw = _apply(stages, weighted(held)).select(*vectors)
    trees, path, precision = boosting.grown(growing, rows, raw, "_y")
    kept = boosting.best_round(precision)
    if kept < len(trees.treeWeights):
        trees = boosting.cut_to(path, kept)
    scored = trees.transform(raw).select(vector_to_array("_probability")[1].alias("_p"), "_y")
    calibrator = fit_isotonic(scored, "_p", "_y")
    calibrator.setFeaturesCol("_probability").setFeatureIndex(1).setPredictionCol("_calibrated")
    return PipelineModel([*stages, trees, calibrator])


def predict(model: PipelineModel, df: DataFrame, out: str = "probability") -> DataFrame:
    """Add the model's (calibrated, if fitted so) probability of a positive."""
    scored = model.transform(df)
    value = (
        F.least(F.greatest(F.col("_calibrated"), F.lit(0.0)), F.lit(1.0))
        if "_calibrated" in scored.columns
        else vector_to_array("_probability")[1]
    )
    return scored.withColumn(out, value).select(*df.columns, out)


def depth_only(
    train: DataFrame, test: DataFrame, label: str = LABEL, seed: int = 42,
    rounds: int = 120, out: str = "depth_only", features: Sequence[str] = tuple(DEPTH_FEATURES),
) -> DataFrame:
    """Score test rows by trees that see the seabed only."""
    present = [f for f in features if f in train.columns]
    if not present:
        raise ValueError("no depth column to learn from")
    stages = _vector_stages(present)
    labelled = train.withColumn("_y", F.col(label).cast("double"))
    growing = _boosting(maxDepth=4, stepSize=0.1, maxIter=rounds, seed=seed)
    trees = growing.fit(_apply(stages, labelled).select("_features", "_y"))
    return predict(PipelineModel([*stages, trees]), test, out)


def feature_importance(model: PipelineModel, features: Sequence[str] | None = None) -> DataFrame:
    """Share of each feature in the mean gains of the splits on it, highest first."""
    trees = next(s for s in model.stages if isinstance(s, GBTClassificationModel))
    return boosting.split_gains(boosting.stored(trees), list(features or FEATURES))


def compare_models(
    scored: DataFrame, models: Sequence[str], label: str = LABEL, group: str = "month",
) -> DataFrame:
    """Within-group metrics of several score columns of one table, in one pass."""
    return _of_models(scored, models, [label, group], lambda rows: evaluate_within(rows, label, "_score", None, group, by=["model"]))


def evaluate_models(scored: DataFrame, models: Sequence[str], label: str = LABEL) -> DataFrame:
    """Pooled metrics of several score columns of one table, in one pass."""
    return _of_models(scored, models, [label], lambda rows: evaluate(rows, label, "_score", by=["model"]))


def _of_models(scored: DataFrame, models: Sequence[str], keep: Sequence[str], measure) -> DataFrame:
    """One row per model, also for those without a score on any row."""
    values = [F.col(m).cast("double").alias(m) for m in models]
    rows = scored.select(*keep, *values).unpivot(list(keep), list(models), "model", "_score")
    names = small_table(scored.sparkSession, "model", [(m,) for m in models])
    found = names.join(measure(rows), "model", "left")
    return found.fillna(0, ["months"]) if "months" in found.columns else found


def validation_gate(
    metrics: DataFrame, candidate: str = "hotspot",
    required: Sequence[str] = ("depth_only", "climatology"),
) -> DataFrame:
    """One row: does the candidate strictly beat every required baseline on
    within-month average precision? The physics index takes no part."""
    ap = F.col("pr_auc_within_month")
    best = F.max(F.when(F.col("model") == candidate, ap))
    beats = {
        f"beats_{name}": best > F.max(F.when(F.col("model") == name, ap))
        for name in required
    }
    row = metrics.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in beats.items()])
    every = F.lit(True)
    for n in beats:
        every = every & F.col(n)
    return row.withColumn("beats_baselines", every)


def score_cells(
    df: DataFrame, model: PipelineModel | None = None, features: Sequence[str] = (),
    validated: bool = False, allow_unvalidated: bool = False,
    by: Sequence[str] = ("region", "date"),
) -> DataFrame:
    """Add `score` (0-100) and `score_source`.

    The model is used only if it passed validation and the day's plane has all
    its features; where a feature's column is missing, or null on a whole plane
    because its source was absent, the physics index stands in. The source
    always says which one it was.
    """
    usable = model is not None and (validated or allow_unvalidated)
    usable = usable and all(f in df.columns for f in features)
    if usable:
        plane = Window.partitionBy(*by)
        whole = reduce(lambda a, b: a & b, [F.max(F.col(f).isNotNull()).over(plane) for f in features], F.lit(True))
        indexed = physics_index(df.withColumn("_whole", whole), by, out="_index")
        scored = predict(model, indexed, "_p").withColumns({
            "score": F.when(F.col("_whole"), to_index(F.col("_p"))).otherwise(F.col("_index")),
            "score_source": F.when(F.col("_whole"), "model").otherwise("physics_index"),
        })
        return scored.select(*df.columns, "score", "score_source")
    scored = physics_index(df, by, out="score")
    return scored.withColumn("score_source", F.lit("physics_index"))


def spatial_transfer(
    train: DataFrame, test: DataFrame, features: Sequence[str], box: Grid | None = None,
    band: tuple[float, float] = RULES.holdout_lat, control: DataFrame | None = None,
    label: str = LABEL, seed: int = 42, rounds: int = 400, by: Sequence[str] = ("region", "date"),
    skip_months: Sequence[int] | None = None,
) -> DataFrame:
    """Metrics on water the model has not seen, one row per model: pooled and
    within months, and whether it beats the climatology and the control.

    With `box`, the box is cut out of `train` and `test` lies inside it;
    `control`, if given, is the same water's own training set and adds the
    control model, climatology and the physics index for comparison. Without
    `box` a latitude band is withheld from `train` and tested on.
    `skip_months` are left out on all sides; with a box, whose training rows may
    be thinned to equal rates, these are the known dormant ones by default.
    """
    # The index ranks each day's whole plane, so it comes before any subset.
    test = physics_index(test, by)
    if box is None:
        train, _ = holdout_band(train, band)
        _, test = holdout_band(test, band)
    else:
        train = exclude_box(train, box)
        skip_months = RULES.dormant_months if skip_months is None else skip_months
    if skip_months:
        here = ~F.month("date").isin(*skip_months)
        train, test = train.where(here), test.where(here)
        control = None if control is None else control.where(here)
    scored = predict(fit_hotspot(train, features, seed, label, rounds), test, "transfer")
    models = ["transfer", "physics_index"]
    if control is not None:
        own = fit_hotspot(control, features, seed, label, rounds)
        scored = climatology(control, predict(own, scored, "control"), label)
        models = ["transfer", "control", "climatology", "physics_index"]
    # Every model's metrics read the scores.
    scored = settle(scored)
    within = compare_models(scored, models, label)
    pooled = evaluate_models(scored, models, label)
    ap = F.col("pr_auc_within_month")
    every = Window.partitionBy()  # one row per model
    beats = {f"beats_{m}": ap > F.max(F.when(F.col("model") == m, ap)).over(every) for m in ("climatology", "control")}
    return within.join(pooled, "model").withColumns(beats)
