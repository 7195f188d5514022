"""Sample-count windows built from panes.

A window of ``window`` samples every ``hop`` samples is cut into panes of
gcd(window, hop) samples.  Each sample belongs to one pane, panes are aggregated
once (combined map-side), and only pane rows are repeated for the windows that
share them.  Starts are 0, hop, 2 hop, ...; a trailing partial window is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PANE = "_pane"
WIN = "win"
CHUNK = "_chunk"
#: Windows (without overlap) of one chunk of a series; a chunk's rows are shuffled together.
CHUNK_WINDOWS = 32


@dataclass(frozen=True)
class Windowing:
    """Window length and hop in samples."""

    window: int
    hop: int

    def __post_init__(self):
        if self.window < 1 or self.hop < 1:
            raise ValueError("window and hop must be at least one sample")

    @classmethod
    def of_seconds(cls, window_s: float, hop_s: float | None, rate_hz: float) -> "Windowing":
        """Windowing from durations; sample counts are rounded."""
        hop_s = window_s if hop_s is None else hop_s
        if window_s <= 0 or hop_s <= 0:
            raise ValueError("window_s and hop_s must be positive")
        return cls(int(round(window_s * rate_hz)), int(round(hop_s * rate_hz)))

    @property
    def pane(self) -> int:
        return gcd(self.window, self.hop)

    @property
    def panes_per_window(self) -> int:
        return self.window // self.pane

    @property
    def panes_per_hop(self) -> int:
        return self.hop // self.pane

    def pane_of(self, idx: Column) -> Column:
        return F.floor(idx / F.lit(self.pane))

    def windows_of_pane(self, pane: Column) -> Column:
        """Array of the window numbers that contain a pane."""
        k, s = self.panes_per_window, self.panes_per_hop
        first = F.greatest(F.lit(0), F.ceil((pane - (k - 1)) / F.lit(s)))
        last = F.floor(pane / F.lit(s))
        return F.when(first <= last, F.sequence(first, last)).otherwise(
            F.array().cast("array<bigint>")
        )

    def windows_of_sample(self, sample: Column) -> Column:
        """Array of the window numbers with start <= sample < start + window."""
        first = F.greatest(F.lit(0), F.floor((sample - self.window) / F.lit(self.hop)) + 1)
        last = F.floor(sample / F.lit(self.hop))
        return F.when(first <= last, F.sequence(first, last)).otherwise(
            F.array().cast("array<bigint>")
        )

    def spread(self, panes: DataFrame) -> DataFrame:
        """Repeat each pane row for its windows (column ``win``)."""
        if self.panes_per_window == self.panes_per_hop == 1:
            return panes.withColumn(WIN, F.col(PANE))
        return panes.withColumn(WIN, F.explode(self.windows_of_pane(F.col(PANE))))


def window_bounds(windows: DataFrame, spec: Windowing, rate_hz: float) -> DataFrame:
    """Add the window's start and end time in seconds."""
    start = F.col(WIN) * spec.hop
    return windows.withColumns(
        {
            "start_time_s": start / F.lit(rate_hz),
            "end_time_s": (start + spec.window) / F.lit(rate_hz),
        }
    )


def _pane_stats(channels: Sequence[str]) -> list[Column]:
    return [
        x
        for c in channels
        for x in (
            F.avg(c).alias(f"_mean_{c}"),
            F.var_pop(c).alias(f"_var_{c}"),
            F.avg(F.col(c) * F.col(c)).alias(f"_sq_{c}"),
            F.min(c).alias(f"_lo_{c}"),
            F.max(c).alias(f"_hi_{c}"),
        )
    ]


def _merged_stats(channels: Sequence[str]) -> list[Column]:
    """Window statistics from equally long panes: the variance is the mean pane
    variance plus the variance of the pane means; no large sums are subtracted."""
    return [
        x
        for c in channels
        for x in (
            F.avg(f"_mean_{c}").alias(f"{c}_mean"),
            F.sqrt(F.avg(f"_var_{c}") + F.var_pop(f"_mean_{c}")).alias(f"{c}_std"),
            F.sqrt(F.avg(f"_sq_{c}")).alias(f"{c}_rms"),
            (F.max(f"_hi_{c}") - F.min(f"_lo_{c}")).alias(f"{c}_ptp"),
        )
    ]


def channel_stats(
    samples: DataFrame,
    keys: Sequence[str],
    idx: str,
    channels: Sequence[str],
    spec: Windowing,
) -> DataFrame:
    """Mean, population deviation, RMS and peak-to-peak of each channel per window."""
    keys = list(keys)
    panes = samples.groupBy(*keys, spec.pane_of(F.col(idx)).alias(PANE)).agg(
        F.count(F.lit(1)).alias("_n"), *_pane_stats(channels)
    )
    merged = (
        spec.spread(panes.filter(F.col("_n") == spec.pane))
        .groupBy(*keys, WIN)
        .agg(F.count(F.lit(1)).alias("_panes"), *_merged_stats(channels))
    )
    return merged.filter(F.col("_panes") == spec.panes_per_window).drop("_panes")


def array_majority(labels: Column) -> Column:
    """Most frequent entry of a short array; the smallest wins a tie."""
    ranked = F.transform(
        F.array_distinct(labels),
        lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), (-x).alias("low")),
    )
    return -F.array_max(ranked)["low"]


def majority_label(
    samples: DataFrame, keys: Sequence[str], idx: str, label: str, spec: Windowing
) -> DataFrame:
    """Most frequent label per full window; the smallest label wins a tie."""
    keys = list(keys)
    counts = samples.groupBy(*keys, spec.pane_of(F.col(idx)).alias(PANE), F.col(label)).agg(
        F.count(F.lit(1)).alias("_n")
    )
    per_window = spec.spread(counts).groupBy(*keys, WIN, label).agg(F.sum("_n").alias("_n"))
    return (
        per_window.groupBy(*keys, WIN)
        .agg(
            F.max_by(label, F.struct("_n", (-F.col(label)).alias("_low"))).alias(label),
            F.sum("_n").alias("_rows"),
        )
        .filter(F.col("_rows") == spec.window)
        .drop("_rows")
    )


def window_arrays(
    samples: DataFrame,
    keys: Sequence[str],
    idx: str,
    channels: Sequence[str],
    spec: Windowing,
    counts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Each full window with one value array per channel, in sample order.

    Samples are gathered once, into one array per channel and pane; windows are put together from their panes, so raw
    rows are neither repeated nor sorted per window. ``counts`` names sums over a window's samples. A window's arrays hold
    ``spec.window`` values, so the collected groups have a fixed size.
    """
    keys, counts = list(keys), dict(counts or {})
    first = F.col(idx)
    inner = list(keys)
    if spec.panes_per_window > 1:
        # a chunk is a stretch of panes with those that its last windows reach into: panes and windows of a chunk
        # are made where its rows lie after one shuffle
        k, run = spec.panes_per_window, CHUNK_WINDOWS * max(spec.panes_per_window, spec.panes_per_hop)
        pane = spec.pane_of(first)
        chunks = F.array_distinct(F.array(F.floor(F.greatest(pane - (k - 1), F.lit(0)) / F.lit(run)), F.floor(pane / F.lit(run))))
        inner.append(CHUNK)
        summed = {name: value.alias(name) for name, value in counts.items()}
        samples = samples.select(*keys, first, *channels, *summed.values(), F.explode(chunks).alias(CHUNK)).repartition(*inner)
        counts = {name: F.col(name) for name in counts}
    # sort_array compares natively, array_sort through a lambda
    packed = F.sort_array(F.collect_list(F.struct(first.alias("_i"), *[F.col(c).alias(c) for c in channels])))
    panes = (
        samples.groupBy(*inner, spec.pane_of(first).alias(PANE))
        .agg(packed.alias("_s"), *[F.sum(value).alias(name) for name, value in counts.items()])
        .filter(F.size("_s") == spec.pane)
        .select(*inner, PANE, *[F.col(f"_s.{c}").alias(c) for c in channels], *counts)
    )
    if spec.panes_per_window == 1:
        return spec.spread(panes).drop(PANE)
    parts = F.sort_array(F.collect_list(F.struct(PANE, *channels)))
    own = F.filter(spec.windows_of_pane(F.col(PANE)), lambda w: F.floor(w * spec.panes_per_hop / F.lit(run)) == F.col(CHUNK))
    return (
        panes.withColumn(WIN, F.explode(own))
        .groupBy(*inner, WIN)
        .agg(parts.alias("_p"), *[F.sum(name).alias(name) for name in counts])
        .filter(F.size("_p") == spec.panes_per_window)
        .select(*keys, WIN, *[F.flatten(F.col(f"_p.{c}")).alias(c) for c in channels], *counts)
    )


def trajectory_stats(
    samples: DataFrame, keys: Sequence[str], idx: str, value: str, spec: Windowing
) -> DataFrame:
    """Mean, deviation, RMSSD, slope, minimum and maximum per window of a pulse series.

    Slope is (last - first) / samples.  Differences inside a pane come from a
    pane-sized row frame, the one across two panes from the pane ends.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, PANE).orderBy(idx)
    v = F.col(value)
    panes = (
        samples.withColumn(PANE, spec.pane_of(F.col(idx)))
        .withColumn("_d", v - F.lag(v).over(inside))
        .groupBy(*keys, PANE)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg(v).alias("_mean"),
            F.var_pop(v).alias("_var"),
            F.sum(F.col("_d") * F.col("_d")).alias("_dd"),
            F.min_by(v, idx).alias("_first"),
            F.max_by(v, idx).alias("_last"),
            F.min(v).alias("_lo"),
            F.max(v).alias("_hi"),
        )
        .filter(F.col("_n") == spec.pane)
    )
    pane = F.struct(*[F.col(c) for c in (PANE, "_first", "_last")])
    ends = F.array_sort(F.collect_list(pane))
    seams = F.aggregate(
        F.sequence(F.lit(1), F.size("_ends") - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + F.pow(F.element_at("_ends", i + 1)["_first"] - F.element_at("_ends", i)["_last"], F.lit(2.0)),
    )
    if spec.panes_per_window == 1:
        seams = F.lit(0.0)
    diffs = F.coalesce(F.col("_dd"), F.lit(0.0)) + seams
    return (
        spec.spread(panes)
        .groupBy(*keys, WIN)
        .agg(
            F.count(F.lit(1)).alias("_panes"),
            F.avg("_mean").alias("hr_mean"),
            F.sqrt(F.avg("_var") + F.var_pop("_mean")).alias("hr_std"),
            F.sum("_dd").alias("_dd"),
            ends.alias("_ends"),
            F.min("_lo").alias("hr_min"),
            F.max("_hi").alias("hr_max"),
        )
        .filter(F.col("_panes") == spec.panes_per_window)
        .withColumns(
            {
                "hr_rmssd": F.sqrt(diffs / F.lit(float(max(spec.window - 1, 1)))),
                "hr_slope": (
                    F.element_at("_ends", -1)["_last"] - F.element_at("_ends", 1)["_first"]
                )
                / F.lit(float(spec.window)),
            }
        )
        .drop("_panes", "_dd", "_ends")
    )


def hr_state() -> Column:
    """Rule label of a trajectory window, first match wins."""
    return (
        F.when(F.col("hr_std") > 15.0, 3)
        .when(F.col("hr_mean") < 55.0, 1)
        .when(F.col("hr_mean") > 105.0, 2)
        .otherwise(0)
    )


def points_by_window(
    points: DataFrame, keys: Sequence[str], sample: str, spec: Windowing, carry: Sequence[str], name: str
) -> DataFrame:
    """(keys, win, array of points in order of their offset in the window) of every window that holds a point."""
    offset = F.col(sample) - F.col(WIN) * spec.hop
    return (
        points.withColumn(WIN, F.explode(spec.windows_of_sample(F.col(sample))))
        .groupBy(*keys, WIN)
        .agg(
            F.array_sort(
                F.collect_list(F.struct(offset.cast("int").alias("offset"), *[F.col(c) for c in carry]))
            ).alias(name)
        )
    )


def interval_join(
    windows: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    sample: str,
    spec: Windowing,
    carry: Sequence[str],
    name: str = "points",
) -> DataFrame:
    """Attach to each window its points, ``start <= sample < start + window``.

    A point names its candidate windows by arithmetic, so the join is an equi-join
    on (keys, win).  Offsets are rebased to the window start; windows without a
    point keep an empty array.
    """
    keys = list(keys)
    found = points_by_window(points, keys, sample, spec, carry, name)
    joined = windows.join(found, [*keys, WIN], "left")
    empty = F.array().cast(found.schema[name].dataType)
    return joined.withColumn(name, F.coalesce(F.col(name), empty))


def interval_pairs(
    windows: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    sample: str,
    spec: Windowing,
) -> DataFrame:
    """The same join as one row per (window, point), ``offset`` rebased; windows
    without a point keep one row of nulls.  Nothing is collected."""
    keys = list(keys)
    named = points.withColumn(WIN, F.explode(spec.windows_of_sample(F.col(sample))))
    return windows.join(named, [*keys, WIN], "left").withColumn(
        "offset", F.col(sample) - F.col(WIN) * spec.hop
    )
