"""Daily documents and the questions asked of them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.functions import half_even
from seagrid.grid import Grid
from seagrid.operators.safety import state_counts, with_headline, with_status_text
from seagrid.rules import RULES, Rules

# What a daily document says about its score.
MODEL_TEXT = {
    "model": ("Rajada kalluunka (model)", "Fishing potential (trained model)", None, None),
    "physics_index": (
        "Tilmaanta biyaha (cabbiran)",
        "Water-condition indicator (measured)",
        "Ma jiro model tababaran weli. Tirradan waxay ka timid cagaaran iyo kala "
        "duwanaanta heerkulka ee la cabbiray - maaha saadaal.",
        "No trained model yet. This index is measured chlorophyll and "
        "temperature-front strength, ranked across the grid - not a validated "
        "prediction.",
    ),
}
WAVE_NOTE = (
    "Wave models mask shallow water. Cells flagged wave_estimated take their wave "
    "height from the nearest cell with data (up to {km:.0f} km), which tends to "
    "over-warn rather than under-warn."
)
REACH_NOTE = (
    "Zones cover only water an open boat can work in a day trip. Cells beyond that "
    "are shown but never ranked or recommended."
)
MAX_USEFUL_ZOOM = 10
# Decimals shown per cell value.
CELL_DECIMALS = {
    "sst": 1, "chl": 3, "sst_gradient": 2, "current_speed": 2,
    "wave_height_max": 2, "wind_speed_max": 1,
}


def display_cells(df: DataFrame, grid: Grid) -> DataFrame:
    """Cell values at display precision; missing stays null."""
    columns = set(df.columns)
    names = {c: d for c, d in CELL_DECIMALS.items() if c in columns}
    return df.withColumns({
        "lat": half_even(grid.lat(F.col("lat_idx")), 3),
        "lon": half_even(grid.lon(F.col("lon_idx")), 3),
        **{c: half_even(F.col(c), d) for c, d in names.items()},
        **({"dist_coast_km": half_even(F.col("dist_coast_km"), 1)}
           if "dist_coast_km" in columns else {}),
        **({"wave_estimated": F.coalesce(F.col("wave_estimated").cast("int"), F.lit(0))}
           if "wave_estimated" in columns else {}),
    })


def daily_payload(
    cells: DataFrame, zones: DataFrame, grid: Grid, rules: Rules = RULES,
    by: Sequence[str] = ("region", "date"), generated_at: dt.datetime | None = None,
) -> DataFrame:
    """One nested document per day: headline, cells as parallel arrays, zones.
    `generated_at`, if given, is stated in every document.

    `cells` are scored, classified and zoned cell-days, `zones` ranked zones. A
    document holds one day of one region, hence never more cells than the grid
    has; arrays are ordered by (lat_idx, lon_idx).
    """
    by = list(by)
    columns = set(cells.columns)
    shown = display_cells(cells, grid)
    order = [
        "lat_idx", "lon_idx", "lat", "lon", "safety", *[c for c in CELL_DECIMALS if c in columns],
        *[c for c in ("wave_estimated",) if c in columns],
        "score", "reachable", "dist_coast_km",
    ]
    rows = F.sort_array(F.collect_list(F.struct(*order)))
    has_flag = "wave_estimated" in columns
    has_age = "chl_age_days" in columns
    # One pass over the cells gives the arrays, the headline and the shares.
    days = shown.groupBy(*by).agg(
        rows.alias("_rows"),
        *state_counts(),
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if("reachable").alias("_n_reachable"),
        F.max("score_source").alias("_source"),
        (half_even(F.avg("wave_estimated"), 3) if has_flag else F.lit(None).cast("double")).alias("_estimated"),
        (F.max("chl_age_days").cast("int") if has_age else F.lit(None).cast("int")).alias("_age"),
    )
    headline = F.struct(
        "status",
        F.struct(F.col("label_so").alias("so"), F.col("label_en").alias("en"), "color").alias("label"),
        F.struct(F.col("advice_so").alias("so"), F.col("advice_en").alias("en")).alias("advice"),
        F.struct("n_safe", "n_caution", "n_danger", "n_unknown").alias("counts"),
        "share_dangerous", "total",
    )
    # At most sites x bands zones a day.
    listed = zones.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(
            "rank", *[c for c in zones.columns if c not in ("rank", *by)]
        ))).alias("zones")
    )

    # A field of an array of structs is the array of that field.
    arrays = F.struct(*[F.col("_rows").getField(c).alias(c) for c in order])
    return (
        with_status_text(with_headline(days, rules)).join(listed, by, "left")
        .select(
            *by,
            *([] if generated_at is None else [F.lit(generated_at).cast("timestamp").alias("generated_at")]),
            F.struct(
                *_constants(lat_min=grid.lat_min, lat_max=grid.lat_max, lon_min=grid.lon_min,
                            lon_max=grid.lon_max, resolution=grid.res, n_lat=grid.n_lat,
                            n_lon=grid.n_lon, max_useful_zoom=MAX_USEFUL_ZOOM)
            ).alias("grid"),
            headline.alias("safety"),
            F.struct(*_constants(
                wave_safe_m=rules.wave_safe_m, wave_danger_m=rules.wave_danger_m,
                wind_safe_kmh=rules.wind_safe_kmh, wind_danger_kmh=rules.wind_danger_kmh,
            )).alias("thresholds"),
            "n_cells",
            arrays.alias("cells"),
            F.struct(
                F.col("_estimated").alias("wave_estimated_share"),
                F.lit(WAVE_NOTE.format(km=rules.wave_fill_max_km)).alias("note_en"),
            ).alias("data_quality"),
            _model_block(F.col("_source"), rules).alias("model"),
            F.coalesce("zones", F.array().cast(listed.schema["zones"].dataType)).alias("zones"),
            F.struct(
                *_constants(max_coast_km=rules.max_coast_km, max_trip_km=rules.max_trip_km,
                            boat_speed_kmh=rules.boat_speed_kmh),
                F.col("_n_reachable").alias("n_reachable_cells"),
                F.col("n_cells").alias("n_cells_total"),
                F.lit(REACH_NOTE).alias("note_en"),
            ).alias("reach"),
            F.struct(F.col("_age").alias("chl_age_days")).alias("data_freshness"),
        )
    )


def _constants(**values) -> list[Column]:
    return [F.lit(v).alias(k) for k, v in values.items()]


def _model_block(source: Column, rules: Rules) -> Column:
    def text(place: int) -> Column:
        out = F.lit(None).cast("string")
        for name, words in MODEL_TEXT.items():
            out = F.when(source == name, F.lit(words[place]).cast("string")).otherwise(out)
        return out

    index = source == "physics_index"
    return F.struct(
        (source == "model").alias("trained"),
        source.alias("score_source"),
        text(0).alias("label_so"), text(1).alias("label_en"),
        text(2).alias("note_so"), text(3).alias("note_en"),
        F.when(index, F.struct(
            F.lit(rules.chl_weight).alias("chl"), F.lit(rules.front_weight).alias("sst_gradient"),
        )).alias("weights"),
    )


def select_days(
    df: DataFrame, date: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Rows of one given day, or of the newest day (of each `by` group)."""
    if date is not None:
        return df.where(F.col("date") == F.lit(date).cast("date"))
    if not by:
        return df.where(F.col("date") == df.agg(F.max("date")).scalar())
    newest = df.groupBy(*by).agg(F.max("date").alias("date"))
    return df.join(newest, [*by, "date"], "left_semi")


def latest_or_fallback(live: DataFrame, fallback: DataFrame) -> DataFrame:
    """The newest live day, or the fallback's newest marked as stale."""
    any_live = live.agg(F.count(F.lit(1)) > 0).scalar()
    current = select_days(live).withColumns({"source": F.lit("live"), "stale": F.lit(False)})
    spare = (
        select_days(fallback)
        .withColumns({"source": F.lit("demo"), "stale": F.lit(True)})
        .where(~any_live)
    )
    return current.unionByName(spare, allowMissingColumns=True)


def lookup_points(
    points: DataFrame, cells: DataFrame, grid: Grid, point: str = "point_id",
    keys: Sequence[str] = ("region",), carry: Sequence[str] = (),
) -> DataFrame:
    """The nearest cell of each point, none further than two cell widths.

    Distance is |dlat| + |dlon| in degrees; ties go to the lower indices.
    `cells` hold one day, one row per cell. Each cell is offered to the cells
    around it, which then hold at most 21 candidates. Points move once, are
    never multiplied, and take the best of their home cell's candidates; points
    crowding into one cell may be split over tasks, since nothing is grouped.
    """
    around = F.array(*[
        F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"))
        for di in range(-2, 3) for dj in range(-2, 3) if abs(di) + abs(dj) <= 3
    ])
    values = [c for c in carry if c in cells.columns]
    lat_idx, lon_idx = F.col("lat_idx").cast("int"), F.col("lon_idx").cast("int")
    offered = (
        cells.where(grid.contains(F.col("lat_idx"), F.col("lon_idx")))
        .withColumn("_o", F.explode(around))
        .groupBy(*keys, (lat_idx - F.col("_o.di")).alias("_home_lat"), (lon_idx - F.col("_o.dj")).alias("_home_lon"))
        .agg(F.collect_list(F.struct(
            lat_idx.alias("lat_idx"), lon_idx.alias("lon_idx"),
            grid.lat(F.col("lat_idx")).alias("cell_lat"), grid.lon(F.col("lon_idx")).alias("cell_lon"), *values,
        )).alias("_offers"))
    )

    def measured(cell: Column) -> Column:
        # Whole billionths of a degree: below any real difference, above float noise.
        away = F.rint(1e9 * (F.abs(cell["cell_lat"] - F.col("lat")) + F.abs(cell["cell_lon"] - F.col("lon")))).cast("long")
        return F.struct(
            away.alias("away"), cell["lat_idx"].alias("lat_idx"), cell["lon_idx"].alias("lon_idx"), cell.alias("cell"),
        )

    best = F.array_min(F.transform("_offers", measured))
    found = (
        points.withColumns({"_home_lat": grid.lat_idx(F.col("lat")), "_home_lon": grid.lon_idx(F.col("lon"))})
        .join(offered, [*keys, "_home_lat", "_home_lon"])
        .withColumn("_best", best)
        .where(F.col("_best.away") <= round(2e9 * grid.res))
    )
    picked = ("lat_idx", "lon_idx", *values, "cell_lat", "cell_lon")
    return found.select(
        point, *keys, (F.col("_best.away") / 1e9).alias("distance_deg"), *[F.col(f"_best.cell.{c}").alias(c) for c in picked],
    )


def point_answers(
    points: DataFrame, cells: DataFrame, grid: Grid, point: str = "point_id",
    keys: Sequence[str] = ("region",), rules: Rules = RULES,
) -> DataFrame:
    """What is known at each point, from the nearest cell of one day: its date and
    place, safety with label and advice, all conditions the day has, the score and
    what it came from. Points without a cell within two cell widths get no row.

    `cells` are scored and classified; `source` and `stale`, if `latest_or_fallback`
    set them, are told too.
    """
    conditions = [c for c in CELL_DECIMALS if c in cells.columns]
    told = [c for c in ("source", "stale") if c in cells.columns]
    scored = [c for c in ("score", "score_source") if c in cells.columns]
    found = lookup_points(points, cells, grid, point, keys, ["date", "safety", *told, *conditions, *scored])
    shown = with_status_text(found, "safety")
    values = [half_even(F.col(c), CELL_DECIMALS[c]).alias(c) for c in conditions]
    return shown.select(
        point, *keys, "date", *told, half_even(F.col("cell_lat"), 3).alias("lat"), half_even(F.col("cell_lon"), 3).alias("lon"),
        F.struct(
            F.col("safety").alias("status"), F.struct(F.col("label_so").alias("so"), F.col("label_en").alias("en"), "color").alias("label"),
            F.struct(F.col("advice_so").alias("so"), F.col("advice_en").alias("en")).alias("advice"),
        ).alias("safety"),
        *([F.struct(*values).alias("conditions")] if values else []),
        *([_model_block(F.col("score_source"), rules).alias("model")] if "score_source" in scored else []),
        *([F.col("score").alias("fishing_potential")] if "score" in scored else []),
    )


def catalog_status(
    days: DataFrame, validated: DataFrame | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Days on offer, their number, the newest, and what ranks the zones.

    `validated` is the one-row gate result. The list of days is a calendar.
    """
    status = days.groupBy(*by).agg(
        F.sort_array(F.collect_set("date")).alias("days"),
        F.count_distinct("date").alias("days_available"),
        F.max("date").alias("newest_day"),
    )
    passed = F.lit(False)
    if validated is not None:
        passed = F.coalesce(validated.agg(F.bool_and("beats_baselines")).scalar(), F.lit(False))
    return status.withColumn("model_validated", passed).withColumn(
        "ranking_source", F.when(F.col("model_validated"), "model").otherwise("physics_index")
    )
