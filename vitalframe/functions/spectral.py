"""Band-energy ratios of sampled windows (Welch density, Hann, half overlap)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from vitalframe import config as C
from vitalframe.functions.arrays import blocks, uneven

BAND_HZ = (2.0, 6.0)
TOTAL_HZ = (0.5, 20.0)


def welch_density(block: np.ndarray, fs: float, nperseg: int) -> np.ndarray:
    """One-sided density of ``block[..., n]`` averaged over half-overlapping segments."""
    step = nperseg - nperseg // 2
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    pieces = np.lib.stride_tricks.sliding_window_view(block, nperseg, axis=-1)[..., ::step, :]
    pieces = pieces - pieces.mean(axis=-1, keepdims=True)
    power = np.abs(np.fft.rfft(pieces * taper)) ** 2 / (fs * np.sum(taper**2))
    last = power.shape[-1] - (1 - nperseg % 2)
    power[..., 1:last] *= 2.0
    return power.mean(axis=-2)


def ratio_of_block(
    block: np.ndarray, fs: float, max_segment: int, floor: float, clip: bool
) -> np.ndarray:
    """Band ratio per row of ``block[rows, axes, n]``, axis densities summed."""
    nperseg = min(block.shape[-1], max_segment)
    density = welch_density(block, fs, nperseg).sum(axis=1)
    freqs = np.fft.rfftfreq(nperseg, 1.0 / fs)
    total = density[:, (freqs >= TOTAL_HZ[0]) & (freqs <= TOTAL_HZ[1])].sum(axis=1)
    band = density[:, (freqs >= BAND_HZ[0]) & (freqs <= BAND_HZ[1])].sum(axis=1)
    silent = total < floor if clip else ~(total > floor)
    ratio = np.where(silent, 0.0, band / np.where(silent, 1.0, total))
    return np.clip(ratio, 0.0, 1.0) if clip else ratio


def _ratio_udf(fs: float, min_samples: int, max_segment: int, floor: float, clip: bool):
    def ratios(axes: list[pa.Array]) -> pa.Array:
        out = np.zeros(len(axes[0]))
        for rows, block in blocks(axes):
            if block.shape[-1] >= min_samples:
                out[rows] = ratio_of_block(block, fs, max_segment, floor, clip)
        return pa.array(out, mask=uneven(axes))

    @arrow_udf(DoubleType())
    def one_axis(x: pa.Array) -> pa.Array:
        return ratios([x])

    @arrow_udf(DoubleType())
    def three_axes(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return ratios([x, y, z])

    return {1: one_axis, 3: three_axes}


def seizure_energy_ratio(*axes: Column, fs: float = C.IMU_RATE_HZ) -> Column:
    """Clonic band share of a motion window, 0 below 32 samples or when silent, null if the axes differ in length."""
    return _ratio_udf(fs, 32, 64, 1e-6, True)[len(axes)](*axes)


def band_ratio(*axes: Column, fs: float) -> Column:
    """Generic band ratio, 0 below 16 samples, null if the axes differ in length; not clipped."""
    return _ratio_udf(fs, 16, 128, 1e-12, False)[len(axes)](*axes)


def with_band_energy(frames: DataFrame) -> DataFrame:
    """Add ``ser_2_6hz`` and ``ser_gyro_2_6hz`` from the motion windows where absent.

    The windows themselves are dropped, so they never reach the session shuffle.
    """
    for source, name in (
        ("imu_accel_window", "ser_2_6hz"),
        ("imu_gyro_window", "ser_gyro_2_6hz"),
    ):
        if name not in frames.columns and source in frames.columns:
            axes = [F.col(f"{source}.{a}") for a in ("x", "y", "z")]
            frames = frames.withColumn(name, seizure_energy_ratio(*axes))
        frames = frames.drop(source)
    return frames
