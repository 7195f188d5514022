"""Row positions, running carries and chunk keys that never need one task per key.

A plain ``row_number() over (partition by key)`` sends a whole key to one task.
The operators here cut hot keys into ordered buckets, aggregate per bucket
(combined map-side), run the cumulative step over the short bucket summary, and
join the carry back on (key, bucket).  Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.config import SessionLayout

BUCKET = "_bucket"
CHUNK = "_chunk"
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: at most rows / hot_rows of them, for any data."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select(*keys, F.lit(True).alias("_hot"))
    )


def bucket_carry(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    totals: dict[str, tuple[Column, str]],
    attach: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add, per row, the aggregate over all earlier buckets of its key.

    ``totals`` maps an output name to (value, ``"sum"`` | ``"max"`` | ``"min"``).
    The output is null where no earlier bucket has a value.  Rows also carry
    ``_bucket``; key columns must not be null.  ``attach`` holds one row per key
    whose columns ride along, so they cost no shuffle of the rows.

    With ``hot_rows`` only keys above that many rows are cut; all others are one
    bucket and need no carry.  The list of hot keys has a proven bound and is
    broadcast, so the rows are not shuffled for it.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}
    keys = list(keys)
    tagged = df.withColumn(BUCKET, bucket)
    counted = tagged
    if hot_rows is not None:
        hot = F.broadcast(hot_keys(df, keys, hot_rows))
        counted = tagged.join(hot, keys, "left_semi")
        kind = tagged.schema[BUCKET].dataType
        tagged = (
            tagged.join(hot, keys, "left")
            .withColumn(BUCKET, F.when(F.col("_hot"), F.col(BUCKET)).otherwise(F.lit(0).cast(kind)))
            .drop("_hot")
        )
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(
        Window.unboundedPreceding, -1
    )
    summary = counted.groupBy(*keys, BUCKET).agg(
        *[agg[how](value).alias(name) for name, (value, how) in totals.items()]
    )
    carries = summary.select(
        *keys,
        BUCKET,
        *[agg[how](name).over(earlier).alias(name) for name, (_, how) in totals.items()],
    )
    if attach is not None:
        carries = carries.join(attach, keys, "left")
    return tagged.join(carries, [*keys, BUCKET], "left")


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "pos",
    start: int = 0,
    attach: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Dense position of each row within its key.

    ``bucket`` must grow with ``order``: rows of a lower bucket sort before rows
    of a higher one.  Only one (key, bucket) is ever sorted by one task; with
    ``hot_rows`` only keys above that many rows are cut.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    return (
        bucket_carry(df, keys, bucket, {"_before": (F.lit(1), "sum")}, attach, hot_rows)
        .withColumn(
            name,
            F.coalesce("_before", F.lit(0)) + F.row_number().over(inside) + F.lit(start - 1),
        )
        .withColumn(name, F.col(name).cast("long"))
        .drop("_before", BUCKET)
    )


def running_max_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    value: Column,
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Largest ``value`` among strictly earlier rows of the key (null if none)."""
    keys = list(keys)
    inside = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        bucket_carry(
            df.withColumn("_value", value),
            keys,
            bucket,
            {"_carry": (F.col("_value"), "max")},
            hot_rows=hot_rows,
        )
        .withColumn(name, F.greatest("_carry", F.max("_value").over(inside)))
        .drop("_carry", "_value", BUCKET)
    )


def chunk_frames(frames: DataFrame, layout: SessionLayout) -> DataFrame:
    """Give each frame its chunk id and repeat chunk tails as look-back rows.

    Adds ``_chunk`` and ``_own`` (false on repeated rows).  With a session
    length bound there is a single chunk and nothing is repeated.
    """
    if layout.single_chunk:
        return frames.withColumn(CHUNK, F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    rows, halo = layout.chunk_rows, layout.halo_rows
    home = F.floor(F.col(layout.order) / F.lit(rows))
    in_tail = F.col(layout.order) % rows >= rows - halo
    return frames.withColumn(
        CHUNK,
        F.explode(F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))),
    ).withColumn("_own", F.col(CHUNK) == F.floor(F.col(layout.order) / F.lit(rows)))


def session_window(layout: SessionLayout):
    """Window over one chunk of a session in frame order."""
    keys = list(layout.keys) if layout.single_chunk else [*layout.keys, CHUNK]
    return Window.partitionBy(*keys).orderBy(layout.order)


def own_frames(frames: DataFrame, layout: SessionLayout, keep_chunk: bool = False) -> DataFrame:
    """Drop the look-back rows again."""
    kept = frames if layout.single_chunk else frames.filter("_own")
    return kept.drop("_own") if keep_chunk else kept.drop("_own", CHUNK)
