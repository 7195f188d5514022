"""Streams give the batch results, whatever order, repeats or gaps the frames have."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vitalframe import schemas
from vitalframe.config import TRIAL_LAYOUT
from vitalframe.operators.audit import audit, number_senders
from vitalframe.operators.indexing import dense_index
from vitalframe.plans.emit import as_bus, emit_messages, first_alerts
from vitalframe.plans.respond import respond
from vitalframe.sources import testviews as V
from vitalframe.streaming.senders import stream_audit, stream_commands
from vitalframe.streaming.session import stream_respond
from vitalframe.streaming.run import Replay, drain
from vitalframe.streaming.sinks import batch_writer, merge_writer, numbered_messages, start_messages, start_security_log, start_writer

KEY = b"stream-key"
EXACT = [
    "predicted_class",
    "candidate_class",
    "active_class",
    "mrm_trigger_flag",
    "persistence_seconds",
    "operational_mode",
    "mrm_state",
    "phase_step",
    "confirmed_etiology",
    "estimated_gcs",
    "standstill_frame",
    "override_suppressed",
]
NEAR = ["psi", "hr_mean_10s", "hr_min_10s", "hr_max_10s", "top_confidence", "speed_kmh", "longitudinal_dist_m", "lateral_pos_m"]


def write_parts(df, path, parts, seed=0, extra=()):
    """Write rows in ``parts`` files by event time, shuffled inside each file."""
    rows = sorted(df.collect(), key=lambda r: r["event_time"] if "event_time" in r else r["rx_time"])
    rnd = random.Random(seed)
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts] + (list(extra) if i == parts - 1 else [])
        rnd.shuffle(part)
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{path}/part{i}")


def source(spark, path, schema, files=1):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    return reader.parquet(path)


def write_shuffled(df, path, parts, seed=0):
    """Write rows in ``parts`` files without any order."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    for i in range(parts):
        df.sparkSession.createDataFrame(rows[i::parts], df.schema).coalesce(1).write.parquet(f"{path}/part{i}")


#: Longer than the frames and events of the tables used here.
WHOLE = "40 days"
#: Files, and files a micro-batch.
DEALT = [(1, 1), (64, 16)]


def comparable(df, keys):
    return {
        tuple(r[k] for k in keys): (tuple(r[c] for c in EXACT), tuple(round(r[c], 6) for c in NEAR))
        for r in df.select(*keys, *EXACT, *NEAR).collect()
    }


@pytest.fixture(scope="module")
def frames(spark):
    view = V.frames_view(spark, "/root/testdata/sf0.01")
    return view.filter("driver_id in ('1', '2', '3') and session_id in ('0', '1')").cache()


def test_session_stream_equals_batch(spark, frames, tmp_path):
    repeats = frames.filter("seq % 40 = 3").limit(20).collect()
    write_parts(frames, f"{tmp_path}/in", 4, extra=repeats)
    stream = stream_respond(source(spark, f"{tmp_path}/in", frames.schema))
    start_writer(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(300)
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").cache()
    keys = ["driver_id", "session_id", "seq"]
    batch = respond(frames, TRIAL_LAYOUT).cache()
    assert out.count() == frames.count()
    assert comparable(out, keys) == comparable(batch, keys)
    first = {(r["driver_id"], r["session_id"]): r["seq"] for r in out.filter("first_trigger_frame").collect()}
    wanted = {(r["driver_id"], r["session_id"]): r["seq"] for r in first_alerts(batch, KEY).collect()}
    assert first == wanted and first


def test_gaps_wait_for_the_watermark(spark, frames, tmp_path):
    """A lost frame delays its followers until the watermark passes, then they go out."""
    lossy = frames.filter("not (driver_id = '1' and session_id = '0' and seq in (50, 51, 200))")
    write_parts(lossy, f"{tmp_path}/in", 5, seed=1)
    stream = stream_respond(source(spark, f"{tmp_path}/in", frames.schema))
    start_writer(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(300)
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    day = F.unix_date(F.to_date("event_time"))
    dense = dense_index(lossy, ["driver_id", "session_id"], ["seq"], day, "pos").withColumn("seq", F.col("pos"))
    keys = ["driver_id", "session_id", "pos"]
    batch = respond(dense, TRIAL_LAYOUT)
    assert comparable(out, keys) == comparable(batch, keys)


@pytest.mark.parametrize("parts, files", DEALT)
def test_shuffled_files_equal_batch(spark, frames, tmp_path, parts, files):
    """However the frames are dealt to files and micro-batches, every one comes out as in the batch plan, and no state stays."""
    write_shuffled(frames, f"{tmp_path}/in", parts, seed=parts)
    replay = Replay(source(spark, f"{tmp_path}/in", frames.schema, files), "event_time", lambda f: stream_respond(f, WHOLE))
    out = replay.run().cache()
    keys = ["driver_id", "session_id", "seq"]
    assert out.count() == frames.count()
    assert comparable(out, keys) == comparable(respond(frames, TRIAL_LAYOUT), keys)
    assert replay.rows_left == 0
    assert replay.counts["frames_in"] == replay.counts["frames_out"] == frames.count()
    assert replay.counts["dropped_by_watermark"] == 0
    assert {r["event_time"] for r in out.select("event_time").collect()} == {r["event_time"] for r in frames.select("event_time").collect()}


def test_a_block_is_one_column_wise_value():
    """Waiting frames are stored as one Arrow stream and come back as they were, nulls too."""
    import pandas as pd
    from pyspark.sql import types as T

    from vitalframe.streaming.buffers import Blocks

    class Store(dict):
        def getMapState(self, *_):
            return self

        def getValue(self, key):
            return self[key]

        updateValue, removeKey = dict.__setitem__, dict.__delitem__

    store = Store()
    held = Blocks(store, "held", T._parse_datatype_string("seq long, ear double, mode string, face_detected boolean"))
    rows = pd.DataFrame({"seq": [3, 5], "ear": [0.25, None], "mode": ["Normal", None], "face_detected": [True, None]})
    held.put(7, rows)
    assert isinstance(store[(7,)][0], bytes)
    back = held.take(7)
    assert not store and back.astype(object).where(back.notna(), None).values.tolist() == [[3, 0.25, "Normal", True], [5, None, None, None]]


def test_late_and_repeated_frames_are_counted(spark, frames, tmp_path):
    """A late frame is lost to its session, and the observed counts tell how many were."""
    one = frames.filter("driver_id = '1' and session_id = '0'")
    overtaken = one.filter("seq in (7, 8)")
    rows = one.filter("seq not in (7, 8)").unionByName(one.filter("seq % 50 = 20"))
    write_parts(rows, f"{tmp_path}/in", 3, seed=3)
    # the gap is passed over 2 days later; by then the overtaken frames are behind the watermark or behind their turn
    spark.createDataFrame(overtaken.collect(), frames.schema).coalesce(1).write.parquet(f"{tmp_path}/late/part0")
    stream = source(spark, f"{tmp_path}/in", frames.schema)
    late = spark.readStream.schema(frames.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/late")
    first = Replay(stream, "event_time", lambda f: stream_respond(f, "2 days", idle_seconds=86400 * 5))
    out = first.run()
    assert out.count() == one.count() - 2
    assert first.counts["frames_in"] - first.counts["frames_out"] == one.filter("seq % 50 = 20").count()
    both = Replay(stream.unionByName(late), "event_time", lambda f: stream_respond(f, "2 days", idle_seconds=86400 * 5))
    both.run()
    assert both.counts["frames_in"] == rows.count() + 2


def test_silent_sessions_are_forgotten(spark, frames, tmp_path):
    """Without a closing row: sessions that ended long before the newest frame leave no state."""
    first = frames.filter("driver_id = '1' and session_id = '0'")
    later = frames.filter("driver_id = '1' and session_id = '1'").limit(3)
    write_parts(first.unionByName(later), f"{tmp_path}/in", 4, seed=2)
    stream = stream_respond(source(spark, f"{tmp_path}/in", frames.schema), "10 seconds", idle_seconds=3600.0)
    query = start_writer(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(300)
    state = spark.read.format("statestore").option("stateVarName", "session").load(f"{tmp_path}/ck").collect()
    assert {r["key"]["session_id"] for r in state} <= {"1"}


def test_messages_and_security_log(spark, frames, tmp_path):
    write_parts(frames, f"{tmp_path}/in", 4)
    want = emit_messages(respond(frames, TRIAL_LAYOUT), KEY)
    stream = lambda: stream_respond(source(spark, f"{tmp_path}/in", frames.schema), WHOLE)
    # the same input under two checkpoints: nothing is sent twice
    for ck in ("a", "b"):
        start_messages(stream(), f"{tmp_path}/due", f"{tmp_path}/ck{ck}").awaitTermination(300)
    due = spark.read.parquet(f"{tmp_path}/due").drop("part", "day")
    assert due.count() == want.count() == due.select("message_id").distinct().count()
    table = source(spark, f"{tmp_path}/due", due.schema, files=3)
    got = drain(table, "event_time", lambda m: numbered_messages(m, KEY, WHOLE, 86400.0))
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(got.select(*want.columns)) == rows(want) and rows(want)
    start_security_log(stream(), f"{tmp_path}/s", f"{tmp_path}/cks").awaitTermination(300)
    log = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/s")
    assert log.count() == respond(frames, TRIAL_LAYOUT).filter("laser_spoofing_detected").count()


def test_commands_of_later_sessions_are_accepted(spark, frames):
    """Counters run on through a driver's sessions, so a receiver takes every honest command and no repeat."""
    sent = emit_messages(respond(frames, TRIAL_LAYOUT), KEY).cache()
    commands = sent.filter("kind = 'command'")
    assert commands.select("sender", "session_id").distinct().count() > commands.select("sender").distinct().count()
    minute = F.unix_seconds(F.date_trunc("minute", "rx_time"))
    out = audit(as_bus(sent), KEY, minute, order=("rx_time", "session_id", "seq"))
    assert out.count() == commands.count() and out.filter("not accepted").count() == 0
    numbers = {}
    for r in commands.orderBy("event_time", "session_id", "seq").collect():
        numbers.setdefault(r["sender"], []).append(r["freshness_counter"])
    assert all(n == list(range(1001, 1001 + len(n))) for n in numbers.values())


def test_merge_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i}", i, f"2024-01-0{1 + i % 3}") for i in range(9)], "message_id string, x int, event_time string")
    rows = rows.withColumn("event_time", F.col("event_time").cast("timestamp"))
    write = merge_writer(f"{tmp_path}/t", "message_id", "event_time", "a")
    for batch in (0, 0, 1):
        write(rows.filter("x < 6"), batch)
    merge_writer(f"{tmp_path}/t", "message_id", "event_time", "b")(rows.unionByName(rows), 0)
    table = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(r["x"] for r in table.collect()) == list(range(9))
    assert sorted(r["x"] for r in table.filter("part like 'b-%'").collect()) == [6, 7, 8]


def test_batch_writer_is_idempotent(spark, tmp_path):
    write = batch_writer(str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    for _ in range(2):
        write(rows, 7)
    batch_writer(str(tmp_path), "k")(rows, 8)
    assert spark.read.parquet(f"{tmp_path}/batch=000000000007").count() == 2
    assert spark.read.parquet(f"{tmp_path}/batch=000000000008").count() == 2


@pytest.mark.parametrize("parts, files", [(24, 4)])
def test_bus_streams_equal_batch(spark, sf, tmp_path, parts, files):
    view = V.bus_view(spark, sf, KEY)
    bus = view.withColumn("sender", (F.col("sender") % 3).cast("string")).withColumn("rx_time", F.col("rx_time").cast("timestamp"))
    bus = spark.createDataFrame(bus.collect(), bus.schema)
    write_shuffled(bus, f"{tmp_path}/in", parts, seed=parts)
    waiting = {"delay": WHOLE, "bucket_seconds": 86400.0}
    table = source(spark, f"{tmp_path}/in", bus.schema, files)
    replay = Replay(table, "rx_time", lambda b: stream_audit(b, KEY, "event_id", **waiting))
    day = F.unix_date(F.to_date("rx_time"))
    pick = lambda df: {r["event_id"]: (r["accepted"], r["reject_reason"]) for r in df.collect()}
    assert pick(replay.run()) == pick(audit(bus, KEY, day, order=("rx_time", "event_id")))
    # one counter a sender stays, whatever was held is gone
    assert replay.rows_left == bus.select("sender").distinct().count()

    sent = bus.select("event_id", "sender", "rx_time", F.lit(3).alias("state_code"), F.lit(-3.2).alias("target_decel"), F.lit(True).alias("hazards_on"))
    columns = [sent_column(c) for c in sent.columns]
    out = drain(table, "rx_time", lambda b: stream_commands(b.select(*columns), KEY, "event_id", **waiting))
    numbers = lambda df: {r["event_id"]: r["freshness_counter"] for r in df.collect()}
    assert numbers(out) == numbers(number_senders(sent, day, ["rx_time", "event_id"]))
    assert schemas.BUS_LOG.names[0] == "sender"


def test_rows_go_out_when_the_watermark_has_passed(spark, sf, tmp_path):
    """Without a closing row: frames in time order go out a bucket at a time, and only the last wait."""
    bus = V.bus_view(spark, sf, KEY).withColumn("sender", F.lit("s")).withColumn("rx_time", F.col("rx_time").cast("timestamp"))
    bus = spark.createDataFrame(bus.collect(), bus.schema)
    write_parts(bus, f"{tmp_path}/in", 6)
    stream = stream_audit(source(spark, f"{tmp_path}/in", bus.schema), KEY, "event_id", "6 days", 3600.0)
    start_writer(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(300)
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    newest = bus.agg(F.max("rx_time")).first()[0]
    closed = bus.filter(F.col("rx_time") < F.lit(newest) - F.expr("interval 6 days 1 hour"))
    assert closed.count() <= out.count() < bus.count()
    day = F.unix_date(F.to_date("rx_time"))
    pick = lambda df: {r["event_id"]: r["accepted"] for r in df.collect()}
    want = pick(audit(bus, KEY, day, order=("rx_time", "event_id")))
    assert all(want[e] == a for e, a in pick(out).items())


def sent_column(name):
    fixed = {"state_code": F.lit(3), "target_decel": F.lit(-3.2), "hazards_on": F.lit(True)}
    return fixed[name].alias(name) if name in fixed else F.col(name)
