"""Signal records and dataset windows as structs and maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.schemas import SIGNAL_STATUS


def signal_record(
    channels: Sequence[Column],
    rate_hz: float,
    units: str,
    names: Sequence[str],
    status: str | Column = "measured",
    source: Column | None = None,
) -> Column:
    """One signal with its rate, units, channels and provenance; values are sample rows."""
    if rate_hz <= 0:
        raise ValueError("rate_hz must be positive")
    if isinstance(status, str) and status not in SIGNAL_STATUS:
        raise ValueError(f"unknown status {status}")
    zipped = F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(channels)])
    width = len(channels)
    rows = F.transform(zipped, lambda z: F.array(*[z[f"c{i}"] for i in range(width)]))
    return F.struct(
        rows.alias("values"),
        F.lit(float(rate_hz)).alias("sample_rate_hz"),
        F.lit(units).alias("units"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        F.lit(list(names)).alias("channels"),
        (source if source is not None else F.lit(None).cast("string")).alias("source_path"),
    )


def signal_map(records: Mapping[str, Column]) -> Column:
    return F.create_map(*[x for name, rec in records.items() for x in (F.lit(name), rec)])


def measured_modalities(signals: Column) -> Column:
    """Names of the signals that were measured."""
    return F.map_keys(F.map_filter(signals, lambda _, s: s["status"] == "measured"))


def unavailable_modalities(signals: Column) -> Column:
    """Names of the signals that are missing or not applicable."""
    return F.map_keys(
        F.map_filter(signals, lambda _, s: s["status"].isin("missing", "not_applicable"))
    )


def signal(signals: Column, name: str) -> Column:
    """One signal by name, null if absent."""
    return F.try_element_at(signals, F.lit(name))


def valid_signal(record: Column) -> Column:
    """Whether a record has values, a positive rate and a known status."""
    return F.coalesce(
        (F.size(record["values"]) > 0)
        & (record["sample_rate_hz"] > 0)
        & record["status"].isin(*SIGNAL_STATUS),
        F.lit(False),
    )


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of a check; unknown counts as bad."""
    good = F.coalesce(valid, F.lit(False))
    return rows.filter(good), rows.filter(~good)
