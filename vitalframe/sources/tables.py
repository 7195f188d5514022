"""Scans of frame, signal, annotation and bus tables, batch or stream, and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalframe import schemas


def _scan(spark: SparkSession, path: str, schema: StructType, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).parquet(path)


def read_frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Sensor frames stored as parquet."""
    return _scan(spark, path, schemas.FRAMES, streaming)


def read_bus_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Bus frames stored as parquet."""
    return _scan(spark, path, schemas.BUS_LOG, streaming)


def read_hr_samples(spark: SparkSession, path: str) -> DataFrame:
    """Pulse samples addressed by position."""
    return _scan(spark, path, schemas.HR_SAMPLES, False)


def read_ecg(
    spark: SparkSession, samples: str, annotations: str, records: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """ECG samples and beat annotations, optionally of named records only."""
    if records is not None and not records:
        raise ValueError("at least one record name is needed")
    ecg = _scan(spark, samples, schemas.ECG_SAMPLES, False)
    beats = _scan(spark, annotations, schemas.BEAT_ANNOTATIONS, False)
    if records is not None:
        ecg, beats = (d.filter(F.col("record").isin(*records)) for d in (ecg, beats))
    return ecg, beats


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local one only where that is unset
    and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{uuid.uuid4().hex}"


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder and go on from there.

    For a table that several branches of a plan read: it is computed once, and a
    lost executor costs a re-read.
    """
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def union_all(*parts: DataFrame) -> DataFrame:
    """Sessions, splits or subjects of several scans by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_trials(trials: DataFrame, path: str) -> None:
    """Trial table as CSV with a header."""
    trials.select(*schemas.TRIALS.names).write.mode("overwrite").csv(path, header=True)


def write_report(report: DataFrame, path: str) -> None:
    """One-row report as JSON."""
    report.write.mode("overwrite").json(path)


def write_series(series: DataFrame, path: str) -> None:
    """Per-frame series as parquet, a directory per scenario."""
    series.write.mode("overwrite").partitionBy("scenario").parquet(path)
