"""Time the end-to-end jobs on a made-up sea of a chosen size.

    python tools/scale.py FOLDER [region] [days]

Writes gridded daily fields below FOLDER once, then builds features, scores
every day and prints the seconds each step took.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from seagrid import REGIONS
from seagrid.plans import build_features, score_days
from seagrid.session import local_session
from seagrid.sources import read_features, write_features


def make_fields(spark, grid, days: int, folder: str) -> None:
    """One plane per day and source: land in the north-west, gaps inshore."""
    n = grid.n_cells
    base = spark.range(n * days, numPartitions=64).select(
        F.lit(grid.region).alias("region"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.floor(F.col("id") / n).cast("int")).alias("date"),
        F.floor(F.col("id") % n / grid.n_lon).cast("int").alias("lat_idx"),
        (F.col("id") % grid.n_lon).cast("int").alias("lon_idx"),
    )
    i, j = F.col("lat_idx") / grid.n_lat, F.col("lon_idx") / grid.n_lon
    t = F.dayofyear("date") / 58.0
    sea = i < 0.35 + j + 0.02 * F.sin(j * 40)
    wave = F.sin(i * 9 + t) * F.cos(j * 7 - t)
    fields = {
        "sst": {"analysed_sst": F.when(sea, 299 + 3 * wave)},
        "chl": {"CHL": F.when(sea & (F.hash("id") % 10 != 0) & (F.day("date") < 27), 1 + wave * wave)},
        "phy": {"uo": wave, "vo": F.sin(j * 5 + t), "thetao": F.when(sea, 26 + 3 * wave)},
        "wav": {"VHM0_mean": F.when(i < 0.31 + j, 1.2 + wave), "VHM0_max": F.when(i < 0.31 + j, 1.6 + wave)},
        "wnd": {"wind_speed": 4 + 2 * wave, "wind_speed_max": 6 + 3 * wave},
    }
    for name, columns in fields.items():
        path = f"{folder}/{name}"
        if not os.path.exists(path):
            with_id = base.withColumn("id", F.col("lat_idx") * 7919 + F.col("lon_idx") + F.dayofyear("date"))
            with_id.select("region", "date", "lat_idx", "lon_idx", *[
                c.cast("double").alias(k) for k, c in columns.items()
            ]).write.parquet(path)


def main() -> None:
    folder = sys.argv[1]
    grid = REGIONS[sys.argv[2] if len(sys.argv) > 2 else "somali"]
    days = int(sys.argv[3]) if len(sys.argv) > 3 else 365
    spark = local_session("scale", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    start = time.time()
    base = f"{folder}/{grid.region}-{days}"
    make_fields(spark, grid, days, base)
    print(f"fields written {time.time() - start:.1f}s", flush=True)

    start = time.time()
    fields = {k: spark.read.parquet(f"{base}/{k}") for k in ("sst", "chl", "phy", "wav", "wnd")}
    out = f"{base}/features-{int(start)}"
    write_features(build_features(fields, grid), out)
    features = read_features(spark, out)
    print(f"features {features.count()} rows {time.time() - start:.1f}s", flush=True)

    start = time.time()
    result = score_days(features.drop("mode", "year"), grid)
    result.payload.write.format("noop").mode("overwrite").save()
    print(f"scored days {time.time() - start:.1f}s", flush=True)


if __name__ == "__main__":
    main()
