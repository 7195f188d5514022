"""Per-sender stream state: the last accepted counter and the next counter to send.

Rows wait in time buckets until the watermark has passed the bucket, then advance in the order of their time and tie
columns. What a sender's frames are numbered with or accepted by therefore does not follow their arrival.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitalframe import config as C
from vitalframe.functions.codec import pack_commands
from vitalframe.operators.audit import frame_checks
from vitalframe.streaming.buffers import complete

MICROS = "time_micros"
#: Rows of a sender that wait in one value of state, in arrival order; more go to parts of time buckets, one value each.
SMALL = 256


class CounterProcessor(StatefulProcessor):
    """Keeps one number per sender and hands it to ``advance`` with each run of released rows.

    The number is never forgotten: it is what tells a replay from a new frame however long a sender was silent. A sender has
    one timer, at the end of its earliest bucket with waiting rows, so a sender costs a few state calls, not a few per bucket.
    """

    start = 0

    def __init__(self, keys: Sequence[str], held_schema: T.StructType, out_columns: list[str], order: Sequence[str], bucket_ms: int):
        self.keys, self.held_schema, self.out_columns = list(keys), held_schema, out_columns
        self.order, self.bucket_ms = [held_schema.names.index(c) for c in (MICROS, *order)], bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = T.ArrayType(self.held_schema)
        numbers = T.ArrayType(T.LongType())
        state = [("counter", T.LongType()), ("due", T.LongType()), ("buckets", numbers), ("parts", numbers), ("few", rows)]
        self.sender = handle.getValueState("sender", T.StructType([T.StructField(*f) for f in state]))
        # a part is one binary value, written once and read once: rows that come later are another part
        self.held = handle.getMapState("waiting", "bucket long, part long", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.out = Row(*self.out_columns)
        self.pick = None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        counter, due, buckets, few = self._load()
        first = self._first(buckets, few)
        for row in rows:
            if self.pick is None:
                at = [row.__fields__.index(n) for n in self.held_schema.names]
                self.pick = itemgetter(*at) if len(at) > 1 else lambda values: (values[at[0]],)
            few.append(self.pick(tuple(row)))
            bucket = self._bucket(few[-1])
            first = bucket if first is None else min(first, bucket)
            if len(few) > SMALL * 16:
                few = self._spread(few, buckets)
        if len(few) > SMALL:
            few = self._spread(few, buckets)
        self._save(counter, due, buckets, few, first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        counter, due, buckets, few = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        passed = lambda b: (b + 1) * self.bucket_ms <= watermark
        ready = {b: [] for b in buckets if passed(b)}
        for row in few:
            if passed(self._bucket(row)):
                ready.setdefault(self._bucket(row), []).append(row)
        for bucket in sorted(ready):
            waiting = ready[bucket]
            if bucket in buckets:
                waiting = self._take(bucket, buckets.pop(bucket)) + waiting
            # rows without a value in an order column come last
            waiting.sort(key=lambda r: [(r[i] is None, 0 if r[i] is None else r[i]) for i in self.order])
            counter, added = self.advance(waiting, counter)
            names = {n: i for i, n in enumerate([*self.keys, *self.held_schema.names])}
            own = tuple(key)
            for row, more in zip(waiting, added):
                values = own + row
                yield self.out(*[more[n] if n in more else values[names[n]] for n in self.out_columns])
        few = [r for r in few if not passed(self._bucket(r))]
        self._save(counter, -1 if due <= watermark else due, buckets, few, self._first(buckets, few))

    def close(self) -> None:
        pass

    def _bucket(self, row: tuple) -> int:
        return row[self.order[0]] // (1000 * self.bucket_ms)

    def _first(self, buckets: dict[int, int], few: list[tuple]) -> int | None:
        return min([*buckets, *[self._bucket(r) for r in few]], default=None)

    def _load(self) -> tuple[int, int, dict[int, int], list[tuple]]:
        """Number, timer, parts of each bucket and rows that wait in no bucket."""
        counter, due, buckets, parts, few = self.sender.get() or (self.start, -1, [], [], [])
        return counter, due, dict(zip(buckets, parts)), [tuple(r) for r in few]

    def _save(self, counter: int, due: int, buckets: dict[int, int], few: list[tuple], first: int | None) -> None:
        """Store the sender; its timer goes to the end of its ``first`` bucket."""
        at = -1 if first is None else (first + 1) * self.bucket_ms
        if at != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            if at >= 0:
                self.handle.registerTimer(at)
        self.sender.update((int(counter), at, list(buckets), list(buckets.values()), few))

    def _spread(self, rows: list[tuple], buckets: dict[int, int]) -> list[tuple]:
        """Move rows to new parts of their buckets; nothing is left."""
        found: dict[int, list[tuple]] = {}
        for row in rows:
            found.setdefault(self._bucket(row), []).append(row)
        for bucket, new in found.items():
            part = buckets.get(bucket, 0)
            self.held.updateValue((bucket, part), (pickle.dumps(new, pickle.HIGHEST_PROTOCOL),))
            buckets[bucket] = part + 1
        return []

    def _take(self, bucket: int, parts: int) -> list[tuple]:
        """Rows of a bucket in the order they came."""
        rows = []
        for part in range(parts):
            (held,) = self.held.getValue((bucket, part))
            self.held.removeKey((bucket, part))
            rows += pickle.loads(bytes(held))
        return rows

    def advance(self, rows: list[tuple], counter: int) -> tuple[int, Iterable[dict]]:
        """The number after these rows, and what each row is given."""
        raise NotImplementedError


class ReplayGuard(CounterProcessor):
    """Accepts a valid frame whose counter exceeds every accepted one."""

    def advance(self, rows, counter):
        valid_at, number_at = self.held_schema.names.index("valid"), self.held_schema.names.index("freshness_counter")
        added = []
        for row in rows:
            number = row[number_at]
            fresh = number is not None and number > counter
            accepted = bool(row[valid_at]) and fresh
            added.append({"accepted": accepted, "fresh": fresh})
            counter = number if accepted else counter
        return counter, added


class Numbering(CounterProcessor):
    """Numbers the messages of a sender in sending order."""

    start = C.COUNTER_START

    def advance(self, rows, counter):
        return counter + len(rows), [{"freshness_counter": counter + 1 + i} for i in range(len(rows))]


def in_order(
    rows: DataFrame,
    added: list[T.StructField],
    processor: type[CounterProcessor],
    keys: Sequence[str],
    time: str,
    order: Sequence[str],
    delay: str,
    bucket_seconds: float,
) -> DataFrame:
    """``rows`` advanced key by key in the order of ``time`` and the ``order`` columns.

    ``delay`` is how far behind the newest time a row may come; older rows are dropped and counted by Spark
    (``numRowsDroppedByWatermark``). Rows wait until the watermark has passed their bucket of ``bucket_seconds``.
    Rows without key or time are dropped.
    """
    prepared = complete(rows.withWatermark(time, delay), [*keys, time]).withColumn(MICROS, F.unix_micros(time))
    held = T.StructType([f for f in prepared.schema if f.name not in (*keys, time)])
    schema = T.StructType([prepared.schema[k] for k in keys] + held.fields + added)
    advanced = prepared.groupBy(*keys).transformWithState(
        statefulProcessor=processor(keys, held, schema.names, order, int(bucket_seconds * 1000)),
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime",
    )
    return advanced.withColumn(time, F.timestamp_micros(MICROS)).drop(MICROS)


def stream_audit(
    bus: DataFrame, key: bytes, tie: str = "freshness_counter", delay: str = "10 seconds", bucket_seconds: float = 1.0
) -> DataFrame:
    """Integrity and replay audit of a bus stream, per sender in the order of ``rx_time`` and ``tie``."""
    checked = frame_checks(bus, key).withColumn(
        "valid", F.col("id_ok") & F.col("length_ok") & F.col("tag_ok") & F.col("counter_ok")
    )
    added = [T.StructField("accepted", T.BooleanType()), T.StructField("fresh", T.BooleanType())]
    out = in_order(checked, added, ReplayGuard, ["sender"], "rx_time", [tie], delay, bucket_seconds)
    reason = (
        F.when(~F.col("id_ok"), "wrong_id")
        .when(~F.col("length_ok"), "wrong_length")
        .when(~F.col("fresh"), "replayed")
        .when(~F.col("tag_ok"), "bad_tag")
        .when(~F.col("counter_ok"), "counter_mismatch")
    )
    return out.withColumn("reject_reason", reason).drop("fresh", "valid")


def stream_numbers(
    messages: DataFrame,
    keys: Sequence[str] = ("sender",),
    time: str = "rx_time",
    order: Sequence[str] = (),
    delay: str = "10 seconds",
    bucket_seconds: float = 1.0,
) -> DataFrame:
    """Messages with their sender's counter: 1001, 1002, ... in the order of ``time`` and ``order``."""
    added = [T.StructField("freshness_counter", T.LongType())]
    return in_order(messages, added, Numbering, keys, time, order, delay, bucket_seconds)


def stream_commands(
    messages: DataFrame, key: bytes, tie: str, delay: str = "10 seconds", bucket_seconds: float = 1.0
) -> DataFrame:
    """Numbered and packed command frames of a message stream."""
    return pack_commands(stream_numbers(messages, order=[tie], delay=delay, bucket_seconds=bucket_seconds), key)
