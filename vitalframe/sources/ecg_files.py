"""Ingest of ECG record files (header, signal, annotation) into two tables.

Records are decoded on the executors, one record per group; a record is a single
recording of bounded length.  Everything after the ingest reads the tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe import schemas

# ---------------------------------------------------------------------------
# Public annotation codes of the record format.
# ---------------------------------------------------------------------------
SYMBOLS = {
    1: "N", 2: "L", 3: "R", 4: "a", 5: "V", 6: "F", 7: "J", 8: "A", 9: "S", 10: "E",
    11: "j", 12: "/", 13: "Q", 14: "~", 16: "|", 18: "s", 19: "T", 20: "*", 21: "D", 22: '"',
    23: "=", 24: "p", 25: "B", 26: "^", 27: "t", 28: "+", 29: "u", 30: "?", 31: "!", 32: "[",
    33: "]", 34: "e", 35: "n", 36: "@", 37: "x", 38: "f", 39: "(", 40: ")", 41: "r",
}
SKIP, NUM, SUB, CHN, AUX = 59, 60, 61, 62, 63
DEFAULT_GAIN, DEFAULT_RATE = 200.0, 250.0
# ---------------------------------------------------------------------------


def parse_header(text: str) -> dict:
    """Rate, sample count and per-signal format, gain, baseline, name."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    first = lines[0]
    signals = []
    for parts in lines[1 : 1 + int(first[1])]:
        gain_text = parts[2].split("/")[0] if len(parts) > 2 else str(DEFAULT_GAIN)
        gain, _, base = gain_text.partition("(")
        zero = float(parts[4]) if len(parts) > 4 else 0.0
        signals.append(
            {
                "file": parts[0],
                "format": int(parts[1].split("x")[0].split(":")[0].split("+")[0]),
                "gain": float(gain) or DEFAULT_GAIN,
                "baseline": float(base.rstrip(")")) if base else zero,
                "name": " ".join(parts[8:]) if len(parts) > 8 else "",
            }
        )
    rate = float(first[2].split("/")[0].split("(")[0]) if len(first) > 2 else DEFAULT_RATE
    return {"rate": rate, "signals": signals}


def unpack_samples(raw: bytes, fmt: int, channels: int) -> np.ndarray:
    """Digital samples [n, channels] of an interleaved signal file (formats 212 and 16)."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if fmt == 16:
        flat = np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2").astype(np.int32)
    elif fmt == 212:
        trio = data[: len(data) // 3 * 3].reshape(-1, 3).astype(np.int32)
        even = trio[:, 0] | ((trio[:, 1] & 0x0F) << 8)
        odd = trio[:, 2] | ((trio[:, 1] & 0xF0) << 4)
        flat = np.stack([even, odd], axis=1).reshape(-1)
        flat = np.where(flat > 2047, flat - 4096, flat)
    else:
        raise ValueError(f"signal format {fmt} is not supported")
    return flat[: len(flat) // channels * channels].reshape(-1, channels)


def unpack_annotations(raw: bytes) -> list[tuple[int, str]]:
    """(sample, symbol) of every annotation that has a symbol."""
    words = np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<u2").astype(np.int64)
    out, at, i = [], 0, 0
    while i < len(words) and words[i]:
        code, step = int(words[i] >> 10), int(words[i] & 0x3FF)
        i += 1
        if code == SKIP:
            jump = (int(words[i]) << 16) | int(words[i + 1])
            at += jump - (1 << 32) if jump >= 1 << 31 else jump
            i += 2
        elif code == AUX:
            i += (step + 1) // 2
        elif code not in (NUM, SUB, CHN):
            at += step
            if code in SYMBOLS:
                out.append((at, SYMBOLS[code]))
    return out


def record_files(spark: SparkSession, root: str) -> DataFrame:
    """(record, part, content) of the record files directly below ``root``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{hea,dat,atr}").load(root)
    name = F.regexp_extract("path", r"([^/]+)\.(hea|dat|atr)$", 1)
    part = F.regexp_extract("path", r"\.(hea|dat|atr)$", 1)
    return files.select(name.alias("record"), part.alias("part"), "content")


def decode_samples(files: DataFrame) -> DataFrame:
    """ECG samples in physical units, one row per sample with up to two leads."""

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = dict(zip(pdf["part"], pdf["content"]))
        columns = schemas.ECG_SAMPLES.names
        if "hea" not in parts or "dat" not in parts:
            return pd.DataFrame(columns=columns)
        head = parse_header(parts["hea"].decode("latin-1"))
        leads = head["signals"]
        digital = unpack_samples(parts["dat"], leads[0]["format"], len(leads))
        values = [(digital[:, k] - s["baseline"]) / s["gain"] for k, s in enumerate(leads[:2])]
        return pd.DataFrame(
            {
                "record": pdf["record"].iloc[0],
                "idx": np.arange(len(digital)),
                "lead1": values[0],
                "lead2": values[1] if len(values) > 1 else np.nan,
                "fs": head["rate"],
            }
        )[columns]

    wanted = files.filter(F.col("part").isin("hea", "dat"))
    return wanted.groupBy("record").applyInPandas(decode, schemas.ECG_SAMPLES)


def decode_annotations(files: DataFrame) -> DataFrame:
    """Beat annotations, one row per symbol."""

    def decode(batches):
        for pdf in batches:
            rows = [
                (record, at, symbol)
                for record, content in zip(pdf["record"], pdf["content"])
                for at, symbol in unpack_annotations(content)
            ]
            yield pd.DataFrame(rows, columns=schemas.BEAT_ANNOTATIONS.names)

    return files.filter("part = 'atr'").mapInPandas(decode, schemas.BEAT_ANNOTATIONS)


def ingest_ecg(spark: SparkSession, root: str, samples: str, annotations: str) -> None:
    """Decode every record below ``root`` once and write both tables by record."""
    files = record_files(spark, root)
    decode_samples(files).write.mode("overwrite").partitionBy("record").parquet(samples)
    decode_annotations(files).write.mode("overwrite").parquet(annotations)
