"""Structured Streaming twin of the daily reduction."""

from seagrid.streaming.daily import (
    batch_writer, daily_updates, read_merged, run_daily, safety_updates,
)
from seagrid.streaming.log import (
    DailyLog, changed_days, compact, daily, lateness, run_log, vacuum,
)

__all__ = [
    "DailyLog", "batch_writer", "changed_days", "compact", "daily", "daily_updates", "lateness", "read_merged",
    "run_daily", "run_log", "safety_updates", "vacuum",
]
