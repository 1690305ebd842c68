"""Row-wise Column builders.  All JVM-side built-ins (whole-stage codegen).

Missing values: null is the only missing marker.  NaN/±Inf produced by an
operator are mapped to null where the reference treats them as missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch geometry (120 x 80 units, goal centre at (120, 40), 16 x 12 grid).
PITCH_X = 120.0
PITCH_Y = 80.0
GOAL_X = 120.0
GOAL_Y = 40.0
GRID_X = 16
GRID_Y = 12
YARDS_TO_METRES = 0.9144


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: Column) -> Column:
    """NaN / ±Inf → null (the reference's inf-to-missing step after every feature)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(math.inf)), F.lit(None)).otherwise(c)


def r6(c) -> Column:
    """Round to 6 digits and fold -0.0 into 0.0 (oracle hygiene for transcendental results)."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


# ---- formula vocabulary: unary -------------------------------------------------------
def f_abs(x) -> Column:
    return F.abs(col(x).cast("double"))


def f_log(x) -> Column:
    """ln|x|, 0 → null."""
    return F.ln(F.abs(F.nullif(col(x).cast("double"), F.lit(0.0))))


def f_sqrt(x) -> Column:
    return F.sqrt(F.abs(col(x).cast("double")))


def f_square(x) -> Column:
    x = col(x).cast("double")
    return x * x


def f_sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x).cast("double")))


def f_round(x) -> Column:
    """The reference's ``round`` is floor; result kept as double."""
    return F.floor(col(x).cast("double")).cast("double")


def f_residual(x) -> Column:
    x = col(x).cast("double")
    return x - F.floor(x).cast("double")


# ---- formula vocabulary: binary --------------------------------------------------------
def _both(a: Column, b: Column, v: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), v)


def f_max(a, b) -> Column:
    a, b = col(a).cast("double"), col(b).cast("double")
    return _both(a, b, F.greatest(a, b))


def f_min(a, b) -> Column:
    a, b = col(a).cast("double"), col(b).cast("double")
    return _both(a, b, F.least(a, b))


def f_add(a, b) -> Column:
    return col(a).cast("double") + col(b).cast("double")


def f_sub(a, b) -> Column:
    return col(a).cast("double") - col(b).cast("double")


def f_mul(a, b) -> Column:
    return col(a).cast("double") * col(b).cast("double")


def f_div(a, b) -> Column:
    """a / b with b = 0 → null (``try_divide``; plain ``/`` raises under ANSI)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


UNARY = {"abs": f_abs, "log": f_log, "sqrt": f_sqrt, "square": f_square,
         "sigmoid": f_sigmoid, "round": f_round, "residual": f_residual}
BINARY = {"max": f_max, "min": f_min, "+": f_add, "-": f_sub, "*": f_mul, "/": f_div}


# ---- pass geometry ---------------------------------------------------------------------
def euclid(x0, y0, x1, y1) -> Column:
    dx = col(x1) - col(x0)
    dy = col(y1) - col(y0)
    return F.sqrt(dx * dx + dy * dy)


def distance_to_goal(x, y) -> Column:
    return euclid(x, y, F.lit(GOAL_X), F.lit(GOAL_Y))


def goal_angle(x, y) -> Column:
    return F.atan2(F.lit(GOAL_Y) - col(y), F.lit(GOAL_X) - col(x))


def log_velocity(length, duration) -> Column:
    """log1p(length / duration) with a zero or missing ratio → 0 (velocity ±Inf/NaN → 0)."""
    return F.log1p(F.coalesce(F.try_divide(col(length), col(duration)), F.lit(0.0)))


def log_velocity_raw(length, duration) -> Column:
    """Variant: duration ≠ 0 → length/duration, else 0, then log1p."""
    return F.log1p(F.when(col(duration) != 0, col(length) / col(duration)).otherwise(F.lit(0.0)))


def grid_cell(x, y, x_bins: int = GRID_X, y_bins: int = GRID_Y):
    """Cell index; multiply first so exact edges stay exact.  x = 120 falls in cell 16."""
    cx = F.floor(col(x) * F.lit(float(x_bins)) / F.lit(PITCH_X))
    cy = F.floor(col(y) * F.lit(float(y_bins)) / F.lit(PITCH_Y))
    return cx, cy


def invert_x(x) -> Column:
    return F.lit(PITCH_X) - col(x)


def invert_y(y) -> Column:
    return F.lit(PITCH_Y) - col(y)


def tolerant_bool(c) -> Column:
    """'true' in any case/padding → True; anything else or null → False."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))) == F.lit("true"), F.lit(False))


def try_cast(c, typ: str) -> Column:
    """Cast that yields null instead of failing (ANSI-safe parse of text values)."""
    return col(c).try_cast(typ)
