"""Frames to decisions in one shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vitalframe.config import FSR_ROWS, HR_ROWS, SessionLayout
from vitalframe.functions.spectral import with_band_energy
from vitalframe.operators.classify import gaussian_classifier, operational_mode
from vitalframe.operators.indexing import chunk_frames, own_frames
from vitalframe.operators.rolling import clinical_flags, rolling_features
from vitalframe.operators.watchdog import interlocks, persistence

Classifier = Callable[[DataFrame], DataFrame]


def features(
    frames: DataFrame,
    layout: SessionLayout = SessionLayout(),
    fsr_rows: int = FSR_ROWS,
    hr_rows: int = HR_ROWS,
) -> DataFrame:
    """The per-frame feature table."""
    return own_frames(_features(frames, layout, fsr_rows, hr_rows), layout)


def _features(frames, layout, fsr_rows=FSR_ROWS, hr_rows=HR_ROWS):
    return clinical_flags(
        rolling_features(chunk_frames(with_band_energy(frames), layout), layout, fsr_rows, hr_rows)
    )


def decide(
    frames: DataFrame, layout: SessionLayout, classifier: Classifier = gaussian_classifier
) -> DataFrame:
    """Decisions for chunked frames, look-back rows included."""
    classified = classifier(operational_mode(_features(frames, layout)))
    return persistence(interlocks(classified), layout)


def detect(
    frames: DataFrame,
    layout: SessionLayout = SessionLayout(),
    classifier: Classifier = gaussian_classifier,
) -> DataFrame:
    """Feature extraction, classification and verification of every frame.

    ``layout.order`` must be the dense position of a frame in its session;
    ``dense_index`` makes one where frames were lost.  ``classifier`` adds the
    posterior columns and may be a learned model.
    """
    return own_frames(decide(frames, layout, classifier), layout)
