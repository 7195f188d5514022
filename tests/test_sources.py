"""File sources, header resolution, imputation and sinks."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import oracle
from vitalframe import schemas
from vitalframe.catalog import files
from vitalframe.operators import evaluate as E
from vitalframe.plans import activity
from vitalframe.operators import windows as W
from vitalframe.plans.replay_hr import replay, replay_summary, sample_rows
from vitalframe.sources import body_log, heart_rate, inertial, lines, tables


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)


def test_lines_keep_order_across_splits(spark, tmp_path):
    """Numbering is exact when a file is read in many splits."""
    text = "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(5000))
    put(f"{tmp_path}/a/one.log", text)
    put(f"{tmp_path}/b/two.log", "\n".join(["first", "", "   ", "second"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = lines.numbered_lines(spark, str(tmp_path), "*.log").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = {r["idx"]: r["value"] for r in rows if r["path"].endswith("one.log")}
    assert one == dict(enumerate(text.splitlines()))
    two = {r["idx"]: r["value"] for r in rows if r["path"].endswith("two.log")}
    assert two == {0: "first", 1: "second"}


def test_hr_csv_headers(spark, tmp_path):
    name = heart_rate.CSV_NAME
    put(f"{tmp_path}/p1/{name}", "timestamp,HR\n0.0,72.0\n0.1,73.5\n")
    put(f"{tmp_path}/p2/{name}", "﻿Time-S,note,Heart Rate\n5,\"a,b\",80\n,x,nan\n7,y,\n8,z, inf \n")
    put(f"{tmp_path}/p3/{name}", "x,hr_raw\n1,60\n2,bad\n")
    put(f"{tmp_path}/p4/{name}", "time,other\n0.5,1\n0.6,2\n0.7,3\n")
    rows = heart_rate.read_hr_csv(spark, str(tmp_path))
    got = {}
    for r in rows.collect():
        got.setdefault(r["session_id"].split("/")[-2], {})[r["idx"]] = (r["t"], r["hr"], r["has_hr"])
    assert got["p1"] == {0: (0.0, 72.0, True), 1: (0.1, 73.5, True)}
    assert got["p2"] == {0: (5.0, 80.0, True), 1: (None, None, True), 2: (7.0, None, True), 3: (8.0, None, True)}
    assert got["p3"] == {0: (None, 60.0, True), 1: (None, None, True)}
    assert got["p4"][2] == (0.7, None, False)

    session = rows.filter("session_id like '%p4%'").first()["session_id"]
    samples = spark.createDataFrame([(session, 0, 70.0), (session, 1, 71.5)], schemas.HR_SAMPLES)
    frames = heart_rate.hr_frames(heart_rate.fill_missing_hr(rows, samples))
    p4 = sorted((r["seq"], r["rppg_hr_bpm"], r["hr_status"]) for r in frames.filter("session_id like '%p4%'").collect())
    assert p4 == [(0, 70.0, "measured"), (1, 71.5, "measured"), (2, 74.0, "imputed")]
    assert {r["imu_heartbeat_ok"] for r in frames.collect()} == {False}

    decided = replay(heart_rate.fill_missing_hr(rows, samples))
    assert {r["operational_mode"] for r in decided.select("operational_mode").collect()} == {"Degraded Mode 2"}
    assert replay_summary(decided).first()["frames_replayed"] == 11
    assert sample_rows(decided).count() == 5


def test_header_order_across_splits(spark, tmp_path):
    body = "".join(f"{i / 10},{60 + i % 30}\n" for i in range(3000))
    put(f"{tmp_path}/s/{heart_rate.CSV_NAME}", "seconds,heart-rate\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = heart_rate.read_hr_csv(spark, str(tmp_path)).orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["idx"], r["t"], r["hr"]) for r in got] == [(i, i / 10, 60.0 + i % 30) for i in range(3000)]


def test_header_positions(spark):
    rows = [(["A", "Heart-Rate"],), (["heart_rate", "hr"],), (["time", "my heart rate x"],), (["x", " HR_raw "],), (["Timestamp"],)]
    names = spark.createDataFrame(rows, "names array<string>")
    got = names.select(heart_rate.pulse_position(names.names).alias("hr"), heart_rate.time_position(names.names).alias("t")).collect()
    assert [(r.hr, r.t) for r in got] == [(1, None), (1, None), (1, 0), (1, None), (None, 0)]


def test_samples_only(spark):
    samples = spark.createDataFrame([("s", i, v) for i, v in enumerate([70.0, 71.5, 73.0])], schemas.HR_SAMPLES)
    frames = heart_rate.replay_order(heart_rate.hr_frames(heart_rate.rows_from_samples(samples))).collect()
    assert [r["rppg_hr_bpm"] for r in frames] == [70.0, 71.5, 73.0] and frames[1]["t"] == 0.1


def test_empty_replay_fails(spark):
    none = spark.createDataFrame([], schemas.HR_SAMPLES)
    with pytest.raises(PySparkException):
        replay_summary(heart_rate.hr_frames(heart_rate.rows_from_samples(none))).collect()


def test_body_log(spark, tmp_path):
    row = ["0"] * 24
    row[0], row[3], row[23] = "1.0", "0.2", "4"
    put(f"{tmp_path}/mHealth_subject1.log", ("\t".join(row) + "\n") * 100)
    samples = body_log.read_body_log(spark, str(tmp_path))
    assert samples.count() == 100
    windows = activity.body_windows(samples, W.Windowing.of_seconds(2.0, 2.0, 50.0)).collect()
    assert len(windows) == 1
    w = windows[0]
    assert (w["subject_id"], w["session_id"], w["activity_label"], len(w["features"])) == ("1", "mHealth_subject1", 4, 69)
    assert w["features"][0] == 1.0 and w["features"][6] == 1.0 and w["end_time_s"] == 2.0
    assert activity.body_windows(samples, W.Windowing.of_seconds(3.0, 1.0, 50.0)).count() == 0
    put(f"{tmp_path}/bad/mHealth_subject2.log", "1 2 3\n")
    with pytest.raises(PySparkException):
        body_log.read_body_log(spark, f"{tmp_path}/bad").collect()


def inertial_files(root, rows=1):
    for kind in ("acc", "gyro"):
        for axis in "xyz":
            put(f"{root}/train/Inertial Signals/body_{kind}_{axis}_train.txt", ("  0.0" * 128 + "\n") * rows)
    put(f"{root}/train/Inertial Signals/total_acc_x_train.txt", "  1.0" * 128 + "\n")
    put(f"{root}/train/y_train.txt", "6\n" * rows)
    put(f"{root}/train/subject_train.txt", "7\n" * rows)


def test_inertial(spark, tmp_path):
    inertial_files(str(tmp_path))
    rows = inertial.read_inertial(spark, str(tmp_path), "train").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["subject_id"], r["activity_label"], r["session_id"], len(r["acc_x"])) == ("7", 6, "train-00000", 128)
    wide = activity.posture_windows(inertial.read_inertial(spark, str(tmp_path), "train"), inertial.AXES)
    assert wide.first()["features"] == [0.0] * 30
    with pytest.raises(ValueError):
        inertial.read_inertial(spark, str(tmp_path), "dev")
    put(f"{tmp_path}/train/y_train.txt", "6\n5\n")
    with pytest.raises(PySparkException):
        inertial.read_inertial(spark, str(tmp_path), "train").collect()


def test_ecg_tables(spark, tmp_path):
    import math

    from vitalframe.plans import beats

    samples = [("100", i, 0.1 * math.sin(2 * math.pi * 1.2 * i / 360), 0.0, 360.0) for i in range(3600)]
    marks = [("100", 100, "N"), ("100", 400, "V"), ("100", 720, "N"), ("100", 3599, "+"), ("101", 5, "N")]
    spark.createDataFrame(samples, schemas.ECG_SAMPLES).write.parquet(f"{tmp_path}/ecg")
    spark.createDataFrame(marks, schemas.BEAT_ANNOTATIONS).write.parquet(f"{tmp_path}/ann")
    ecg, ann = tables.read_ecg(spark, f"{tmp_path}/ecg", f"{tmp_path}/ann", ["100"])
    wins = beats.ecg_windows(ecg, ann, W.Windowing.of_seconds(2.0, None, 360.0))
    got = {r["win"]: [(b["offset"], b["symbol"]) for b in r["beats"]] for r in wins.collect()}
    assert got == {0: [(100, "N"), (400, "V")], 1: [(0, "N")], 2: [], 3: [], 4: [(719, "+")]}
    feats = beats.beat_features(wins).collect()
    assert sorted((r["win"], r["beat_class"]) for r in feats) == [(0, "Normal_N"), (0, "Ventricular_V"), (1, "Normal_N")]
    assert all(len(r["features"]) == 36 for r in feats)
    with pytest.raises(ValueError):
        tables.read_ecg(spark, f"{tmp_path}/ecg", f"{tmp_path}/ann", [])
    with pytest.raises(ValueError):
        W.Windowing.of_seconds(0.0, None, 360.0)


def golden_trials(spark):
    rows = []
    for seed in range(10):
        for name, cls in (
            ("NORMAL_DRIVING", "Normal"),
            ("CARDIAC_SYNCOPE", "Syncope"),
            ("EPILEPTIC_SEIZURE", "Seizure"),
            ("OPTICAL_BLINDING_ATTACK", "Normal"),
            ("IMU_HARDWARE_FAULT", "Normal"),
        ):
            hit = cls != "Normal"
            latency = None if not hit else (3.1 + 0.1 * (seed % 2) if cls == "Syncope" else 2.0 + 0.1 * (seed % 2))
            rows.append((name, seed, cls, cls, hit, latency, not hit, not hit, hit, -7.0 if hit else 0.0, 76 if hit else 0, hit))
    return spark.createDataFrame(rows, schemas.TRIALS)


def test_trial_metrics_and_sinks(spark, tmp_path):
    trials = golden_trials(spark)
    r = E.metrics_report(trials).first()
    assert (r["total_trials"], r["accuracy"], r["macro_f1"], r["latency_count"]) == (50, 1.0, 1.0, 20)
    assert (r["latency_min"], r["latency_max"]) == (2.0, 3.2)
    assert (r["false_positive_count"], r["false_negative_count"], r["safe_scenario_count"]) == (0, 0, 30)
    assert r["mec_length_bytes"] == [0, 76] and r["prototype_can_valid_count"] == 20
    assert r["confusion_matrix"]["Syncope"] == {"Normal": 0, "Syncope": 10, "Seizure": 0}
    tables.write_trials(trials, f"{tmp_path}/trials")
    back = spark.read.schema(schemas.TRIALS).csv(f"{tmp_path}/trials", header=True)
    assert back.count() == 50 and back.exceptAll(trials).count() == 0
    tables.write_report(E.metrics_report(trials), f"{tmp_path}/report")
    text = [open(f"{tmp_path}/report/{f}").read() for f in os.listdir(f"{tmp_path}/report") if f.endswith(".json")]
    assert json.loads(text[0])["accuracy"] == 1.0
    empty = E.latency_summary(trials.filter("not mrm_triggered")).first()
    assert (empty["latency_count"], empty["latency_mean"]) == (0, None)


def test_frame_scan_prunes_columns(spark, tmp_path):
    spark.createDataFrame([], schemas.FRAMES).write.parquet(f"{tmp_path}/frames")
    plan = tables.read_frames(spark, f"{tmp_path}/frames").filter("t >= 4").select("driver_id", "t")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,4.0)" in text and "ReadSchema: struct<driver_id:string,t:double>" in text
    assert tables.read_frames(spark, f"{tmp_path}/frames", streaming=True).isStreaming
    series = spark.createDataFrame([("A", 1.0)], "scenario string, x double")
    tables.write_series(series, f"{tmp_path}/series")
    assert spark.read.parquet(f"{tmp_path}/series").count() == 1
    assert series.select(F.col("x")).count() == 1


def pack_212(samples):
    """Two leads interleaved as 12-bit pairs."""
    flat = [x & 0xFFF for pair in samples for x in pair]
    out = bytearray()
    for a, b in zip(flat[::2], flat[1::2]):
        out += bytes([a & 0xFF, (a >> 8) | ((b >> 8) << 4), b & 0xFF])
    return bytes(out)


def test_ecg_ingest(spark, tmp_path):
    from vitalframe.sources.ecg_files import ingest_ecg

    root = tmp_path / "db"
    root.mkdir()
    digital = [(1024 + (i * 37) % 900 - 450, 1024 - (i * 11) % 500) for i in range(720)]
    (root / "100.hea").write_text("100 2 360 720\n100.dat 212 200 11 1024 995 0 0 MLII\n100.dat 212 200 11 1024 1011 0 0 V5\n")
    (root / "100.dat").write_bytes(pack_212(digital))
    word = lambda code, step: ((code << 10) | step).to_bytes(2, "little")
    aux = word(63, 3) + b"(N\0\0"
    skip = word(59, 0) + (0).to_bytes(2, "little") + (200).to_bytes(2, "little")
    (root / "100.atr").write_bytes(word(28, 18) + aux + word(1, 100) + word(60, 1) + skip + word(5, 20) + word(8, 300) + b"\0\0")
    ingest_ecg(spark, str(root), f"{tmp_path}/s", f"{tmp_path}/a")
    ecg, ann = tables.read_ecg(spark, f"{tmp_path}/s", f"{tmp_path}/a")
    got = ecg.orderBy("idx").collect()
    assert len(got) == 720 and got[0]["fs"] == 360.0 and got[0]["record"] == "100"
    assert [r["lead1"] for r in got] == [(a - 1024) / 200 for a, _ in digital]
    assert [r["lead2"] for r in got] == [(b - 1024) / 200 for _, b in digital]
    assert sorted((r["sample"], r["symbol"]) for r in ann.collect()) == [(18, "+"), (118, "N"), (338, "V"), (638, "A")]


def test_lines_are_numbered_without_a_shuffle_of_text(spark, tmp_path):
    from vitalframe.sources.lines import numbered_lines

    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(50)))
    rows = numbered_lines(spark, str(tmp_path), "*.log")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(path" not in plan.split("BroadcastExchange")[0]
    assert sorted((r["idx"], r["value"]) for r in rows.collect()) == [(i, f"line {i}") for i in range(50)]


def test_small_files_do_not_move_the_splits_of_large_ones(spark, tmp_path):
    """Spark cuts files by the bytes of all it reads; lines of large files keep their numbers where small ones lie beside them."""
    text = "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(5000))
    put(f"{tmp_path}/large.log", text)
    for k in range(40):
        put(f"{tmp_path}/small{k}.log", "".join(f"{k} {i} {'y' * 40}\n" for i in range(30)))
    sizes = {"spark.sql.files.openCostInBytes": "4096", "spark.sql.files.maxPartitionBytes": "1m"}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        rows = lines.numbered_lines(spark, str(tmp_path), "*.log").collect()
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert {r["idx"]: r["value"] for r in rows if r["path"].endswith("large.log")} == dict(enumerate(text.splitlines()))
    for k in range(40):
        assert sorted(r["idx"] for r in rows if r["path"].endswith(f"/small{k}.log")) == list(range(30))


def test_hr_csv_of_many_sessions(spark, tmp_path):
    """Lines of several sessions in one file, also when they alternate or the file is split; files without the column are one session."""
    body = "".join(f"{i / 10},s{i % 3},{60 + i % 30}\n" for i in range(3000))
    put(f"{tmp_path}/many.csv", "seconds,User,heart-rate\n" + body)
    put(f"{tmp_path}/one.csv", "seconds,hr\n5,80\n6,81\n")
    put(f"{tmp_path}/some.csv", "hr,user\n70\n71,\n72,a\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = heart_rate.read_hr_csv(spark, str(tmp_path), "*.csv", session_column="user").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        got.setdefault(r["session_id"].split("/")[-1], []).append((r["idx"], r["t"], r["hr"]))
    for k in range(3):
        assert sorted(got.pop(f"many.csv#s{k}")) == [(j, (3 * j + k) / 10, 60.0 + (3 * j + k) % 30) for j in range(1000)]
    assert {k: sorted(v) for k, v in got.items()} == {
        "one.csv": [(0, 5.0, 80.0), (1, 6.0, 81.0)],
        "some.csv": [(0, None, 70.0), (1, None, 71.0)],
        "some.csv#a": [(0, None, 72.0)],
    }


def test_pulse_files_do_not_grow_with_users(spark, tmp_path):
    """Users by the thousand are read from a bounded number of files, each with its own header."""
    n = 4000
    ev = spark.range(n).selectExpr(
        "id as event_id", "timestamp_seconds(id) as ts", "id div 2 - 3 as user_id", "'x' as event_type", "id / 8.0D as value", "'' as props"
    )
    ev.write.parquet(f"{tmp_path}/events.parquet")
    root = files._session_files(spark, str(tmp_path))
    found = glob.glob(f"{root}/**/part-*", recursive=True)
    assert 0 < len(found) <= len(files.HEADERS) * int(spark.conf.get("spark.sql.shuffle.partitions"))
    equal, message = oracle.compare(spark, oracle.connect(str(tmp_path)), str(tmp_path), files.pulse_csv, files.PULSE_CSV)
    assert equal, message
