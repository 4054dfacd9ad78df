"""From daily source fields to the labelled cell-day feature table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.functions import cyclic_month, speed, to_celsius, to_kmh
from seagrid.grid import Grid, cell_id
from seagrid.operators import (
    Axis, align_sources, carry_planes, days_with_values, drop_land,
    effort_cells, filled, gradient, join_labels, join_static, pick_source,
    regrid_bilinear, subsample_negatives, swap_filled, trailing_mean,
)
from seagrid.operators.labels import labelled
from seagrid.operators.regrid import marked_readings, unmatched_readings
from seagrid.rules import RULES, Rules
from seagrid.session import settle, settle_by_day
from seagrid.sources.readers import nan_to_null

# Variables of each source's daily fields.
FIELDS = {
    "sst": ["analysed_sst"], "thetao": ["thetao"], "phy": ["uo", "vo", "thetao"],
    "chl": ["CHL"], "cur": ["uo", "vo"], "wav": ["VHM0_mean", "VHM0_max"],
    "wnd": ["wind_east", "wind_north", "wind_speed_max"],
}
# Every column is always there; a missing source leaves its columns null.
MEASURED = [
    "sst", "sst_model", "chl", "chl_lag7", "chl_lag14", "current_speed", "wave_height",
    "wave_height_max", "wind_speed", "wind_speed_max",
]


def on_grid(
    daily: Mapping[str, DataFrame], axes: Mapping[str, tuple[Axis, Axis]], grid: Grid,
    most_unmatched: float = 0.0, buckets: int | None = None,
) -> dict[str, DataFrame]:
    """Regrid every source that is present. Inputs hold region, date, lat, lon
    and the source's variables. Mean wind is regridded by components: speeds of
    opposed winds must not be averaged. The gridded fields are written once, as
    Parquet: what follows looks at them more than once, the readings are far
    larger and are read a single time.

    Readings that belong to no node of their source's axes cannot be used. They
    are counted on the way, and a share of them above `most_unmatched` is an error.

    With `buckets` the fields are stored by day in so many buckets (`settle_by_day`).
    Regridding lays readings out by day anyway, so storing them like that moves
    nothing more, and builds with the same `buckets` move no field again. A bucket
    is a task of every such build: there should be enough for its days to fit in one.
    """
    out = {}
    for name, df in daily.items():
        seen = Observation()
        off = F.count_if(~F.coalesce("_matched", F.lit(False)))
        watched = marked_readings(df, *axes[name]).observe(seen, F.count(F.lit(1)).alias("n"), off.alias("off")).drop("_matched")
        gridded = regrid_bilinear(watched, FIELDS[name], *axes[name], grid, partitions=buckets)
        out[name] = settle_by_day(gridded, buckets) if buckets else settle(gridded)
        if out[name].isEmpty():  # then there may have been nothing to observe
            n, off = unmatched_readings(df, *axes[name], []).select(F.coalesce("readings", F.lit(0)), F.coalesce("unmatched", F.lit(0))).first()
        else:
            n, off = seen.get["n"], seen.get["off"]
        if off > most_unmatched * n:
            raise ValueError(f"{off} of {n} readings of {name} belong to no node of its axes")
    return out


def thinned_keys(
    cells: DataFrame, effort: DataFrame, calendar: DataFrame, k: int, days: int = 15, seed: int = 42,
    rules: Rules = RULES,
) -> DataFrame:
    """The keys of all positive cell-days, and of up to `k` negatives for each
    positive within every `days` days of a region's year, one positive counted at
    least. Days are those of `calendar`, whether or not they follow each other.
    `cells` are the keys of all cell-days; only keys and labels are looked at."""
    key = ["region", "date", "lat_idx", "lon_idx"]
    year = Window.partitionBy("region", F.year("date")).orderBy("date")
    chunks = calendar.select("region", "date", F.floor((F.row_number().over(year) - 1) / days).alias("_chunk"))
    rows = join_labels(cells.select(*key).distinct(), effort, rules=rules).select(*key, "fished").join(chunks, ["region", "date"])
    kept = subsample_negatives(rows, k, F.struct("region", F.year("date").alias("year"), "_chunk"), seed)
    return kept.select(*key)


def build_features(
    fields: Mapping[str, DataFrame], grid: Grid, effort: DataFrame | None = None,
    seabed: DataFrame | None = None, rules: Rules = RULES,
    restart_each_year: bool = False, wind_in_ms: bool = True,
    neg_per_pos: int | None = None, thin_days: int = 15, seed: int = 42,
    buckets: int | None = None,
) -> DataFrame:
    """Cell-day features from gridded daily fields (keyed by region, date,
    lat_idx, lon_idx), with labels from effort rows and seabed columns. Fields
    are read more than once and should be tables, as `on_grid` makes them. Wind
    comes as mean components, or as `wind_speed` where it never was regridded.

    Trailing means and carrying forward happen on the chlorophyll source alone,
    so only its few columns are ever laid out by cell. The wide table is moved
    once, by day, and alignment, fronts and gap filling all work within that
    layout. Effort comes along as one more narrow source, so labels do not move
    the wide rows again. Land goes only after gaps are filled and fronts computed, since
    both look at neighbouring cells.

    `neg_per_pos` thins the negatives as `thinned_keys` says. Which rows stay is
    worked out from keys and labels alone and comes along as one more narrow
    source, so the wide rows are cut before labels move them: the few that are
    left meet their effort in a join.

    `buckets` says that all fields are stored by day in so many buckets, as `on_grid`
    or `settle_by_day` store them: alignment and all that follows on a day's plane
    read them as they lie. What is derived on the way (carried chlorophyll, effort,
    kept keys, the list of days) is brought into that layout.
    """
    key = ["region", "date", "lat_idx", "lon_idx"]
    fields = {name: nan_to_null(df) for name, df in fields.items()}
    frames = []

    def take(name: str, **columns) -> None:
        frames.append(fields[name].select(*key, *[c.alias(n) for n, c in columns.items()]))

    model = "thetao" if "thetao" in fields else "phy" if "phy" in fields else None
    if "sst" in fields:
        take("sst", sst=to_celsius(F.col("analysed_sst")))
        if model:
            take(model, sst_model=F.col("thetao"))
    elif model:
        take(model, sst=F.col("thetao"))
    current = pick_source(fields, "cur", "phy")
    if current is not None:
        frames.append(current.select(*key, speed(F.col("uo"), F.col("vo")).alias("current_speed")))
    if "wav" in fields:
        take("wav", wave_height=F.col("VHM0_mean"), wave_height_max=F.col("VHM0_max"))
    if "wnd" in fields:
        unit = to_kmh if wind_in_ms else (lambda c: c)
        mean = F.col("wind_speed") if "wind_speed" in fields["wnd"].columns else speed(F.col("wind_east"), F.col("wind_north"))
        take("wnd", wind_speed=unit(mean), wind_speed_max=unit(F.col("wind_speed_max")))
    chl = None
    if "chl" in fields:
        chl = fields["chl"].select(*key, F.col("CHL").alias("chl"))
        for days, least in ((7, 3), (14, 5)):
            chl = trailing_mean(
                chl, "chl", days, least, f"chl_lag{days}", restart_each_year=restart_each_year
            )
        # Read for the list of days, for its own planes, and to carry them.
        chl = settle(chl)
    if chl is None and not frames:
        raise ValueError("no source present")

    # One row per region and day; read by carrying and by the alignment.
    calendar = settle(days_with_values(frames if chl is None else [*frames, chl]))
    ages = calendar.withColumn("chl_age_days", F.lit(None).cast("int"))
    if chl is not None:
        carried, ages = carry_planes(
            chl, ["chl", "chl_lag7", "chl_lag14"], calendar, rules.chl_max_age_days,
            per_year=restart_each_year,
        )
        frames.append(carried.repartition(buckets, "region", "date") if buckets else carried)
    thins = neg_per_pos is not None and effort is not None
    labels = ["fishing_hours", "n_vessels"]
    if effort is not None and not thins:
        hours = effort_cells(effort, grid).select(*[F.col(k).cast(frames[0].schema[k].dataType) for k in key], *labels)
        frames.append(hours.repartition(buckets, "region", "date") if buckets else hours)
    if thins:
        cells = next(f for f in frames if "sst" in f.columns)
        cells = cells.where(F.col("sst").isNotNull() & grid.contains(F.col("lat_idx"), F.col("lon_idx")))
        kept = thinned_keys(cells, effort_cells(effort, grid), calendar, neg_per_pos, thin_days, seed, rules)
        kept = kept.withColumn("_stays", F.lit(1))
        frames.append(kept.repartition(buckets, "region", "date") if buckets else kept)
    df = align_sources(frames, days=calendar, fill_grid=grid, buckets=buckets)
    present = set(df.columns)
    absent = {c: F.lit(None).cast("double") for c in MEASURED if c not in present}
    df = (df.withColumns(absent) if absent else df).join(ages, ["region", "date"], "left")

    # Within each day's plane.
    reach = rules.wave_fill_max_km
    # In one step, so that all neighbours are read in a single window pass.
    df = df.withColumns({
        "sst_gradient": gradient(grid, dense=True),
        "_mean": filled("wave_height", grid, reach, dense=True),
        "_max": filled("wave_height_max", grid, reach, dense=True),
    })
    df = drop_land(swap_filled(
        df, {"wave_height": "_mean", "wave_height_max": "_max"},
        {"wave_estimated": "wave_height_max"},
    ))
    if thins:
        df = df.where("_stays = 1").drop("_stays")

    df = df.withColumns({
        "cell_id": cell_id(F.col("lat_idx"), F.col("lon_idx")),
        "lat": grid.lat(F.col("lat_idx")), "lon": grid.lon(F.col("lon_idx")),
        **cyclic_month(F.col("date")),
    })
    if thins:
        df = join_labels(df, effort_cells(effort, grid), rules=rules)
    elif effort is not None:
        df = labelled(df.select(*[c for c in df.columns if c not in labels], *labels), rules)
    if seabed is not None:
        df = join_static(df, seabed)
    return df
