"""Feature days worked out again after some source days changed, and only those."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.grid import Grid
from seagrid.plans.features import build_features
from seagrid.rules import RULES, Rules
from seagrid.session import settle
from seagrid.sources.writers import write_features

#: Source days after a chlorophyll day on which a trailing mean still sees it.
TRAILING = 13


def affected_days(changed: DataFrame, chl_days: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The first and last feature day (region, first, last) that each changed source day
    (source, region, date) can alter.

    Most sources alter their own day. Chlorophyll enters the trailing means of the next
    TRAILING days on which its source has rows, and each of these planes is carried on;
    `chl_days` are those days (region, date), before or after the change. A changed day
    need not be among them: it may be new, or gone.
    """
    own = changed.where("source != 'chl'").select("region", F.col("date").alias("first"), F.col("date").alias("last")).distinct()
    chl = changed.where("source = 'chl'").select("region", "date").distinct().withColumn("changed", F.lit(True))
    line = chl_days.select("region", "date").distinct().join(chl, ["region", "date"], "full")
    ahead = Window.partitionBy("region").orderBy("date").rowsBetween(0, TRAILING)
    reach = line.withColumn("last", F.date_add(F.max("date").over(ahead), rules.chl_max_age_days)).where("changed")
    return own.unionByName(reach.select("region", F.col("date").alias("first"), "last"))


def update_features(
    fields: Mapping[str, DataFrame], changed: DataFrame, grid: Grid, path: str, effort: DataFrame | None = None,
    seabed: DataFrame | None = None, rules: Rules = RULES, mode: str = "historical", **options,
) -> DataFrame:
    """Rebuild what `changed` (source, region, date) alters in features that
    `write_features(..., by_day=True)` wrote, and replace just those days. Returns them
    as (region, date). `fields` hold the state after the change.

    Lists of days reach the driver, one entry per region and day, so that stored fields
    are pruned by them: of most sources only the affected days are read, of chlorophyll
    also the days its trailing means and its carrying look back to. Trailing means that
    restart each year are not offered here.
    """
    reach = affected_days(changed, fields["chl"] if "chl" in fields else changed.limit(0).select("region", "date"), rules)
    days = None
    for df in fields.values():
        here = df.select("region", "date").distinct()
        days = here if days is None else days.unionByName(here)
    spans = settle(reach)
    hit = settle(days.distinct().join(spans, "region").where("date between first and last").select("region", "date").distinct())
    wanted = [(r["region"], r["date"]) for r in hit.collect()]
    if not wanted:
        return hit
    regions, dates = sorted({r for r, _ in wanted}), sorted({d for _, d in wanted})
    near = F.col("region").isin(*regions) & F.col("date").isin(*dates)
    # Pruned by lists, then exactly: a region's days may differ from another's.
    cut = {name: df.where(near).join(hit, ["region", "date"], "left_semi") for name, df in fields.items() if name != "chl"}
    if "chl" in fields:
        seen = fields["chl"].where(F.col("region").isin(*regions)).groupBy("region", "date").agg(F.bool_or(F.col("CHL").isNotNull()).alias("some"))
        first = hit.groupBy("region").agg(F.min("date").alias("first"))
        before = Window.partitionBy("region").orderBy("date").rowsBetween(-TRAILING, 0)
        looks = settle(seen.join(first, "region").withColumn("back", F.min("date").over(before)))
        # The plane that the first affected day may carry, however old, and what its means look back to.
        last = looks.where("some and date <= first").groupBy("region").agg(F.max(F.struct("date", "back")).alias("m"))
        start = first.join(last, "region", "left").join(
            looks.where(F.col("date") >= F.date_sub("first", rules.chl_max_age_days)).groupBy("region").agg(F.min("back").alias("near")), "region", "left"
        ).select("region", F.least("m.back", "near", "first").alias("start"))
        starts = {r["region"]: r["start"] for r in start.collect()}
        chl = fields["chl"].where(F.col("date").between(min(starts.values()), dates[-1]) & F.col("region").isin(*regions))
        cut["chl"] = chl.join(start, "region").where("date >= start").drop("start")
    built = build_features(cut, grid, effort, seabed, rules, **options)
    write_features(built.join(hit, ["region", "date"], "left_semi"), path, mode, by_day=True)
    return hit
