"""Small scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(x: float) -> str:
    """A double literal for SQL expression text."""
    return f"{float(x)!r}D"


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def finite_or_null(text: Column) -> Column:
    """Tolerant number parse: text that is no finite number becomes null."""
    number = F.trim(text).try_cast("double")
    usable = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(usable, number)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, zero where the denominator is zero."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def brake_command(decel: Column) -> Column:
    """Brake demand 0..1 from a deceleration request."""
    return F.when(decel < 0, clamp(F.abs(decel) / 4.0, 0.0, 1.0)).otherwise(F.lit(0.0))


def throttle_command(brake: Column) -> Column:
    return F.when(brake > 0.1, F.lit(0.0)).otherwise(F.lit(0.4))


def physical_clamps() -> dict[str, Column]:
    """Replacement columns that hold ear, pressure and pulse in range."""
    return {
        "ear": clamp(F.col("ear"), 0.0, 0.45),
        "fsr_pressure": clamp(F.col("fsr_pressure"), 0.0, 1.0),
        "rppg_hr_bpm": F.greatest(F.lit(0.0), F.col("rppg_hr_bpm")),
    }
