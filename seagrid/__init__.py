"""seagrid: gridded ocean analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing here holds
global state, and all settings travel in a `Grid` and a `Rules` value.
"""

from seagrid.grid import REGIONS, Grid
from seagrid.rules import RULES, Rules

__all__ = ["Grid", "REGIONS", "Rules", "RULES"]
