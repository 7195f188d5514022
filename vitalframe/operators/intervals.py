"""Active intervals and status thinning over long sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.config import SessionLayout
from vitalframe.operators.indexing import chunk_frames, dense_index, own_frames, session_window
from vitalframe.sources.tables import cut_lineage


def active_intervals(timeline: DataFrame, layout: SessionLayout, active: str) -> DataFrame:
    """[start, end) in session time of runs of active frames.

    The end is the first inactive frame, or the session's last frame for a run
    that is still open.  Only the frames where the flag flips, and the last one, are
    kept; a run ends at the next frame kept.  In chunks, the k-th rise is paired with
    the k-th fall.
    """
    keys = list(layout.keys)
    rows = chunk_frames(
        timeline.select(*keys, layout.order, "t", F.col(active).alias("_on")), layout
    )
    ordered = session_window(layout)
    flips = own_frames(
        rows.withColumn("_was", F.coalesce(F.lag("_on").over(ordered), F.lit(False))), layout
    )
    if layout.single_chunk:
        per_session = Window.partitionBy(*keys).orderBy(layout.order)
        flip = F.col("_on") != F.col("_was")
        edges = flips.withColumns({"_flip": flip, "_last": F.lead("t").over(per_session).isNull()}).filter("_flip or _last")
        paired = edges.withColumn("_end", F.lead("t").over(per_session)).filter("_on and _flip")
        return paired.select(*keys, F.col("t").alias("start_t"), F.coalesce("_end", "t").alias("end_t"))
    last = timeline.groupBy(*keys).agg(F.max_by("t", layout.order).alias("_last_t"))
    bucket = F.floor(F.col(layout.order) / F.lit(layout.chunk_rows))
    rises = dense_index(flips.filter("_on and not _was"), keys, [layout.order], bucket, "_k")
    falls = dense_index(flips.filter("not _on and _was"), keys, [layout.order], bucket, "_k")
    ends = falls.select(*keys, "_k", F.col("t").alias("_end"))
    return (
        rises.join(ends, [*keys, "_k"], "left")
        .join(last, keys)
        .select(*keys, F.col("t").alias("start_t"), F.coalesce("_end", "_last_t").alias("end_t"))
    )


def thin_regular(frames: DataFrame, layout: SessionLayout, every: int = 5) -> DataFrame:
    """Status frames of a gap-free 10 Hz session: each fifth frame, the first at 0.5 s."""
    return frames.filter((F.col(layout.order) > 0) & (F.col(layout.order) % every == 0))


#: A stretch of session time is so many periods long: its frames and those kept are bounded by the frame rate alone.
STRETCH_PERIODS = 64


def thin_irregular(
    frames: DataFrame, layout: SessionLayout, time: str = "t", period: float = 0.5
) -> DataFrame:
    """Frames at least ``period`` seconds after the last frame kept, starting from time 0.

    Which frame is kept depends on the one kept before, so the frames form a chain of successors. Session time is cut into
    stretches of 64 periods. A stretch can only be entered at one of its first frames (within one period of its start, or the next
    one), and a fold over its times tells for each of them which frame is kept last: that is one pointer from an
    entry to an entry of the next stretch. Pointers are doubled, so the entries that a session really takes are found in a number
    of rounds that grows as the logarithm of its stretches, on a table of a few rows per stretch. Then every
    stretch keeps its frames from its own entry.

    Times are compared to the microsecond; of frames at one time the first in order counts. Frames before time 0 or without
    a time or position are not kept. Session time must not run backwards.
    """
    keys = list(layout.keys)
    step = round(period * 1_000_000)
    if step < 1:
        raise ValueError("period must be at least a microsecond")
    span = step * STRETCH_PERIODS
    timed = frames.select(*keys, F.round(F.col(time) * 1_000_000).cast("long").alias("_us"), F.col(layout.order).alias("_at"))
    timed = timed.filter("_us >= 0 and _at is not null")
    single = timed.groupBy(*keys, "_us").agg(F.min("_at").alias("_at"))
    stretch = F.floor(F.col("_us") / F.lit(span))
    stretches = cut_lineage(
        single.groupBy(*keys, stretch.alias("_n")).agg(F.array_sort(F.collect_list(F.struct("_us", "_at"))).alias("_frames"))
    )

    def last_kept(start: Column) -> Column:
        """The time kept last in a stretch whose first kept time is ``start``."""
        return F.aggregate("_times", start, lambda last, t: F.when(t - last >= step, t).otherwise(last))

    early = F.filter("_times", lambda t: t < F.col("_n") * span + step)
    entries = F.slice("_times", F.lit(1), F.size(early) + 1)
    per_session = Window.partitionBy(*keys).orderBy("_n")

    def entry(last: Column, options: Column) -> Column:
        """Where a stretch is entered after ``last``; -1 if none of its frames is kept."""
        return F.coalesce(F.array_min(F.filter(options, lambda t: t >= last + step)), F.lit(-1).cast("long"))

    short = stretches.withColumn("_times", F.col("_frames._us")).withColumn("_entries", entries)
    ways = F.transform("_entries", lambda t: F.struct(t.alias("entry"), last_kept(t).alias("last")))
    # one row a stretch: its entries with the last frame kept, and the entries of the next stretch
    linked = short.select(
        *keys,
        "_n",
        F.lag("_n").over(per_session).isNull().alias("_first"),
        "_entries",
        # a stretch none of whose frames is kept leaves a last frame before its start
        F.array_append(ways, F.struct(F.lit(-1).cast("long").alias("entry"), (F.col("_n") * span - 1).alias("last"))).alias("_ways"),
        F.lead(F.struct(F.col("_n").alias("n"), F.col("_entries").alias("entries"))).over(per_session).alias("_next"),
    )
    linked = cut_lineage(linked)
    jumps = linked.select(*keys, "_n", F.explode("_ways").alias("_w"), "_next").filter("_next is not null")
    jumps = cut_lineage(
        jumps.select(*keys, "_n", F.col("_w.entry").alias("_entry"), F.col("_next.n").alias("_to"), entry(F.col("_w.last"), F.col("_next.entries")).alias("_to_entry"))
    )
    node = [*keys, "_n", "_entry"]
    taken = cut_lineage(linked.filter("_first").select(*keys, "_n", entry(F.lit(0), F.col("_entries")).alias("_entry")))
    count, before = taken.count(), 0
    while count > before:
        before = count
        ahead = taken.join(jumps, node).select(*keys, F.col("_to").alias("_n"), F.col("_to_entry").alias("_entry"))
        taken = cut_lineage(taken.unionByName(ahead).distinct())
        count = taken.count()
        onward = jumps.select(*keys, F.col("_n").alias("_to"), F.col("_entry").alias("_to_entry"), F.col("_to").alias("_far"), F.col("_to_entry").alias("_far_entry"))
        jumps = cut_lineage(
            jumps.join(onward, [*keys, "_to", "_to_entry"]).select(*node, F.col("_far").alias("_to"), F.col("_far_entry").alias("_to_entry"))
        )
    nothing = F.array().cast(stretches.schema["_frames"].dataType)
    kept = F.aggregate(
        "_frames",
        F.struct(F.lit(None).cast("long").alias("last"), nothing.alias("kept")),
        lambda a, f: F.when(
            (f["_us"] >= F.col("_entry")) & (F.coalesce(f["_us"] - a["last"], F.lit(step)) >= step),
            F.struct(f["_us"].alias("last"), F.array_append(a["kept"], f).alias("kept")),
        ).otherwise(a),
        lambda a: a["kept"],
    )
    chosen = stretches.join(taken.filter("_entry >= 0"), [*keys, "_n"]).select(*keys, F.explode(kept).alias("_f"))
    chosen = chosen.select(*keys, F.col("_f._at").alias(layout.order), F.col("_f._us").alias("_us"))
    placed = frames.withColumn("_us", F.round(F.col(time) * 1_000_000).cast("long"))
    return placed.join(chosen, [*keys, layout.order, "_us"], "left_semi").drop("_us")
