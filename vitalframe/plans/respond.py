"""Frames to response timeline, still in the one session shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vitalframe import config as C
from vitalframe.config import SessionLayout
from vitalframe.operators.classify import gaussian_classifier
from vitalframe.operators.indexing import chunk_frames, own_frames
from vitalframe.operators.timeline import timeline
from vitalframe.plans.detect import Classifier, decide


def respond(
    frames: DataFrame,
    layout: SessionLayout = SessionLayout(),
    classifier: Classifier = gaussian_classifier,
    initial_speed_kmh: float = C.INITIAL_SPEED_KMH,
) -> DataFrame:
    """Decisions of every frame with phase, kinematics and actuator flags."""
    decisions = decide(frames, layout, classifier)
    return own_frames(timeline(decisions, layout, initial_speed_kmh), layout)


def respond_to(
    decisions: DataFrame,
    layout: SessionLayout = SessionLayout(),
    initial_speed_kmh: float = C.INITIAL_SPEED_KMH,
) -> DataFrame:
    """Timeline of stored decisions (the output of ``detect``)."""
    return own_frames(timeline(chunk_frames(decisions, layout), layout, initial_speed_kmh), layout)
