"""Statistics of array columns, a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

STATS = ("mean", "std", "rms", "ptp", "energy")
DOUBLES = ArrayType(DoubleType())


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, start offsets and lengths of a list column (null lists have length 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1], lengths


def uneven(columns: list[pa.Array]) -> np.ndarray:
    """Rows whose lists differ in length; a null list has length 0."""
    lengths = [list_parts(c)[2] for c in columns]
    return np.any([n != lengths[0] for n in lengths], axis=0)


def blocks(columns: list[pa.Array], most: int = 1024):
    """Row numbers and [rows, columns, n] blocks of equally long lists, ``most`` rows each.

    Rows whose columns differ in length belong to no block; ``uneven`` tells them.
    """
    parts = [list_parts(c) for c in columns]
    lengths = parts[0][2]
    even = ~uneven(columns)
    for n in np.unique(lengths[even]):
        same, spots = np.flatnonzero(even & (lengths == n)), np.arange(n)
        for at in range(0, len(same), most):
            rows = same[at : at + most]
            block = np.stack(
                [values[starts[rows][:, None] + spots] for values, starts, _ in parts], axis=1
            )
            yield rows, block.astype(float, copy=False)


def block_stats(block: np.ndarray) -> np.ndarray:
    """Mean, population deviation, RMS, peak-to-peak and energy over the last axis."""
    energy = (block * block).sum(axis=-1)
    return np.stack(
        [
            block.mean(axis=-1),
            block.std(axis=-1),
            np.sqrt(energy / block.shape[-1]),
            np.ptp(block, axis=-1),
            energy,
        ],
        axis=-1,
    )


def list_column(table: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A [rows, width] table as a list column; rows flagged ``null`` become null lists."""
    rows, width = table.shape
    if null is None or not null.any():
        offsets = np.arange(0, rows * width + 1, width, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))
    return pa.array([None if skip else list(row) for row, skip in zip(table, null)], pa.list_(pa.float64()))


@arrow_udf(DOUBLES)
def _stats(values: pa.Array) -> pa.Array:
    out = np.zeros((len(values), len(STATS)))
    empty = np.zeros(len(values), dtype=bool)
    for rows, block in blocks([values]):
        if block.shape[-1]:
            out[rows] = block_stats(block[:, 0])
        else:
            empty[rows] = True
    return list_column(out, empty)


def array_stats(values: Column) -> Column:
    """Array of (mean, std, rms, ptp, energy) of an array column; null when empty."""
    return _stats(values)


def stat(stats: Column | str, name: str) -> Column:
    """One entry of an ``array_stats`` column."""
    return F.get(stats, F.lit(STATS.index(name)))


def grouped_stats(sizes: list[int]):
    """Arrow UDF: struct of channel arrays -> mean, deviation, RMS and peak-to-peak.

    Channels come in groups of the given sizes; a group's values are listed statistic
    by statistic.  Channels of different lengths give null.
    """

    @arrow_udf(DOUBLES)
    def vector(signals: pa.Array) -> pa.Array:
        if isinstance(signals, pa.ChunkedArray):
            signals = signals.combine_chunks()
        out = np.zeros((len(signals), 4 * sum(sizes)))
        for rows, block in blocks(signals.flatten()):
            stats, at = block_stats(block)[:, :, :4], 0
            for size in sizes:
                part = stats[:, at : at + size].transpose(0, 2, 1).reshape(len(rows), 4 * size)
                out[rows, 4 * at : 4 * (at + size)] = part
                at += size
        return list_column(out, uneven(signals.flatten()))

    return vector


@arrow_udf(DOUBLES)
def triple_vectors(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array, f: pa.Array) -> pa.Array:
    """30 features of two axis triples: per triple four statistics of each axis, then
    mean, deviation and maximum of the magnitude.  A missing triple gives zeros, axes of
    different lengths within a triple give null."""
    out = np.zeros((len(a), 30))
    torn = uneven([a, b, c]) | uneven([d, e, f])
    for base, triple in ((0, [a, b, c]), (15, [d, e, f])):
        for rows, block in blocks(triple):
            if not block.shape[-1]:
                continue
            stats = block_stats(block)[:, :, :4]
            length = np.sqrt((block * block).sum(axis=1))
            out[rows, base : base + 12] = stats.transpose(0, 2, 1).reshape(len(rows), 12)
            out[rows, base + 12 : base + 15] = np.stack(
                [length.mean(axis=1), length.std(axis=1), length.max(axis=1)], axis=1
            )
    return list_column(out, torn)
