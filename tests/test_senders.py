"""A sender's state calls, on a handle that counts them."""

from __future__ import annotations

from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import types as T

from vitalframe.streaming import senders


class Handle:
    def __init__(self):
        self.calls, self.timers, self.values, self.maps = Counter(), set(), {}, {}

    def getValueState(self, name, schema):
        def update(value):
            self.calls["update"] += 1
            self.values[name] = value

        return SimpleNamespace(get=lambda: self.values.get(name), update=update)

    def getMapState(self, name, key, schema):
        return SimpleNamespace(getValue=self.maps.get, updateValue=self.maps.__setitem__, removeKey=self.maps.pop)

    def registerTimer(self, at):
        self.calls["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


HELD = T.StructType([T.StructField(senders.MICROS, T.LongType()), T.StructField("n", T.LongType())])


def _numbered(handle, batches, watermarks):
    processor = senders.Numbering(["sender"], HELD, ["sender", senders.MICROS, "n", "freshness_counter"], ["n"], 1000)
    processor.init(handle)
    out = []
    for rows, watermark in zip(batches, watermarks):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w)
        list(processor.handleInputRows(("a",), iter([Row(**{senders.MICROS: t, "n": n}) for t, n in rows]), now))
        for at in sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(at)
            out += list(processor.handleExpiredTimer(("a",), now, None))
    return [(r["n"], r["freshness_counter"]) for r in out]


def test_a_sender_has_one_timer_however_many_buckets_wait():
    handle = Handle()
    rows = [(k * 1_000_000, k) for k in reversed(range(8))]
    assert _numbered(handle, [rows, []], [0, 10**6]) == [(k, 1001 + k) for k in range(8)]
    assert handle.calls["timer"] == 1
    assert not handle.timers and not handle.maps


def test_many_rows_wait_in_buckets_and_go_out_in_order():
    handle = Handle()
    n = senders.SMALL * 20
    times = [(k * 7919) % n for k in range(n)]
    batches = [[(t * 10_000, t) for t in times[: n // 2]], [(t * 10_000, t) for t in times[n // 2 :]], []]
    out = _numbered(handle, batches, [-1, -1, 20_000])
    released = [t for t in range(n) if (t * 10 // 1000 + 1) * 1000 <= 20_000]
    assert out == [(t, 1001 + t) for t in released]
    assert len(handle.timers) == 1
    assert _numbered(handle, [[]], [10**9])[-1] == (n - 1, 1000 + n)
    assert not handle.timers and not handle.maps


def test_waiting_rows_are_read_once_however_many_batches_come():
    handle, reads = Handle(), []
    handle.getMapState = lambda *_: SimpleNamespace(
        getValue=lambda k: reads.append(k) or handle.maps[k], updateValue=handle.maps.__setitem__, removeKey=handle.maps.pop
    )
    n = senders.SMALL + 1
    batches = [[(t % 5, t) for t in range(k * n, (k + 1) * n)] for k in range(6)]
    assert _numbered(handle, batches, [-1] * 6) == [] and reads == []
    out = _numbered(handle, [[(7, -1)]], [10**9])
    assert out == [(t, 1001 + i) for i, t in enumerate([*sorted(range(6 * n), key=lambda t: (t % 5, t)), -1])]
    assert len(reads) == len(set(reads)) == 6 and not handle.maps
