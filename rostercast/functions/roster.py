"""Row-level roster arithmetic.

Plain Column expressions.  ANSI mode is on in Spark 4, so ratios use
``try_divide``: a day without stand-by capacity gets a NULL rate instead of the
reference's inf/NaN (deviation D11, counted separately in the summary).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The production roster policy of the reference.
PROD_FLOOR = 31        # minimum stand-by drivers per day
PROD_BUFFER = 1.15     # +15 % on top of the prediction
CURRENT_CAPACITY = 90  # stand-by drivers rostered today (capacity comparison)
N_DUTY_DEFAULT = 1900  # manually maintained staff-on-duty input for the forecast month


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def activation_rate(need: Column | str = "sby_need", capacity: Column | str = "n_sby") -> Column:
    """A1: ``need / capacity * 100``; NULL when capacity is 0."""
    return F.try_divide(_c(need), _c(capacity)) * F.lit(100.0)


def roster_activation_rate(need: Column | str, roster: Column | str) -> Column:
    """A2: 0 on days without need, else ``need / roster * 100``."""
    return F.when(_c(need) == 0, F.lit(0.0)).otherwise(F.try_divide(_c(need), _c(roster)) * F.lit(100.0))


def apply_policy(pred: Column | str, floor: Column | float, buffer: Column | float = 1.0) -> Column:
    """Below the floor → the floor, else ``pred * buffer``; then ceiling.

    The buffer is not applied to floored rows (30.9 → 31, 31 → 36 for 31/1.15).
    The result stays a double, as in the reference.
    """
    p = _c(pred)
    floor_c = floor if isinstance(floor, Column) else F.lit(float(floor))
    buf = buffer if isinstance(buffer, Column) else F.lit(float(buffer))
    return F.ceil(F.when(p < floor_c, floor_c).otherwise(p * buf)).cast("double")
