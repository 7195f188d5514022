"""Gaussian class posteriors as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.functions.numeric import double

VISION = ("ear", "pitch_deg", "rppg_hr_bpm")


def operational_mode(frames: DataFrame) -> DataFrame:
    """Add both degradation flags and the mode label (the IMU fault names the mode)."""
    blind = (F.col("optical_snr_db") < C.MIN_OPTICAL_SNR_DB) | ~F.col("face_detected")
    return frames.withColumns(
        {"degraded_1": blind, "degraded_2": ~F.col("imu_heartbeat_ok")}
    ).withColumn(
        "operational_mode",
        F.when(F.col("degraded_2"), C.MODE_DEGRADED_2)
        .when(F.col("degraded_1"), C.MODE_DEGRADED_1)
        .otherwise(C.MODE_NOMINAL),
    )


def log_density(value: str, mean: float, std: float) -> str:
    """Natural log of a normal density, as expression text."""
    z = f"(({value} - {double(mean)}) / {double(std)})"
    return f"({double(-math.log(std * math.sqrt(2 * math.pi)))} - {z} * {z} / 2D)"


def _grip_term(cls: str) -> str:
    whens = " ".join(f"WHEN '{g}' THEN {double(math.log(p))}" for g, p in C.GRIP[cls].items())
    return f"CASE wheel_grip {whens} ELSE {double(math.log(C.GRIP_UNKNOWN))} END"


def stateless_scores(features: DataFrame) -> DataFrame:
    """Add ``_base_<class>``: log score of everything that needs no earlier frame.

    Vision terms count only with a face and a signal above -15 dB outside
    Degraded Mode 1, the band-energy term only with a live IMU.
    """
    gates = {
        "_vision": F.expr(
            f"NOT degraded_1 AND face_detected AND optical_snr_db > {double(C.MIN_OPTICAL_SNR_DB)}"
        ),
        "_imu": F.expr("NOT degraded_2 AND imu_heartbeat_ok"),
    }
    scores = {}
    for cls in C.CLASSES:
        params = C.GAUSSIAN[cls]
        vision = " + ".join(log_density(f, *params[f]) for f in VISION)
        motion = log_density("ser_2_6hz", *params["ser_2_6hz"])
        tonic, usual = double(math.log(C.PRIOR_TONIC[cls])), double(math.log(C.PRIOR[cls]))
        scores[f"_base_{cls}"] = F.expr(
            f"CASE WHEN _vision THEN {vision} ELSE 0D END"
            f" + CASE WHEN _imu THEN {motion} ELSE 0D END"
            f" + {_grip_term(cls)}"
            f" + CASE WHEN tonic_detected THEN {tonic} ELSE {usual} END"
        )
    return features.withColumns(gates).withColumns(scores).drop("_vision", "_imu")


def class_scores(features: DataFrame) -> DataFrame:
    """Add one ``_ll_<class>`` log score per class, prior included."""
    scores = {
        f"_ll_{cls}": F.expr(f"_base_{cls} + {log_density('psi', *C.GAUSSIAN[cls]['psi'])}")
        for cls in C.CLASSES
    }
    return (
        stateless_scores(features).withColumns(scores).drop(*[f"_base_{cls}" for cls in C.CLASSES])
    )


def posterior_columns(scored: DataFrame) -> DataFrame:
    """Turn ``_ll_<class>`` scores into posteriors, top class, entropy and gate."""
    names = [f"_ll_{cls}" for cls in C.CLASSES]
    mass = " + ".join(f"exp({n} - _top)" for n in names)
    posteriors = {
        f"p_{cls.lower()}": F.expr(f"exp(_ll_{cls} - _top) / _mass") for cls in C.CLASSES
    }
    scored = (
        scored.withColumn("_top", F.greatest(*names))
        .withColumn("_mass", F.expr(mass))
        .withColumns(posteriors)
        .drop(*names, "_top", "_mass")
    )
    return summarise_posteriors(scored)


def summarise_posteriors(df: DataFrame) -> DataFrame:
    """Add predicted class, confidence, entropy in bits and the confidence gate.

    Ties go to the class declared first.
    """
    p = [f"p_{cls.lower()}" for cls in C.CLASSES]
    best = (
        f"CASE WHEN {p[0]} >= {p[1]} AND {p[0]} >= {p[2]} THEN '{C.CLASSES[0]}' "
        f"WHEN {p[1]} >= {p[2]} THEN '{C.CLASSES[1]}' ELSE '{C.CLASSES[2]}' END"
    )
    bits = " + ".join(f"{x} * log2({x} + 1e-12D)" for x in p)
    return df.withColumns(
        {
            "predicted_class": F.expr(best),
            "top_confidence": F.greatest(*p),
            "shannon_entropy": F.expr(f"greatest(0D, -({bits}))"),
        }
    ).withColumn("is_confident", F.expr(f"top_confidence >= {double(C.CONFIDENCE_GATE)}"))


def gaussian_classifier(features: DataFrame) -> DataFrame:
    """The default classifier: adds D3 columns to a feature table."""
    return posterior_columns(class_scores(features))


def posterior_map(df: DataFrame) -> DataFrame:
    """Add the posteriors as one map column."""
    pairs = [x for cls in C.CLASSES for x in (F.lit(cls), F.col(f"p_{cls.lower()}"))]
    return df.withColumn("posteriors", F.create_map(*pairs))


def parameter_table(spark) -> DataFrame:
    """The class parameters as a table of (class, feature, mean, std)."""
    rows = [
        (cls, feature, mean, std)
        for cls in C.CLASSES
        for feature, (mean, std) in C.GAUSSIAN[cls].items()
    ]
    return spark.createDataFrame(rows, "class string, feature string, mean double, std double")


def weight_table(spark) -> DataFrame:
    """Grip probabilities and priors as a table of (class, kind, name, probability); kind is ``grip`` or ``prior``."""
    rows = [(cls, "grip", grip, p) for cls in C.CLASSES for grip, p in C.GRIP[cls].items()]
    rows += [(cls, "prior", name, table[cls]) for name, table in (("usual", C.PRIOR), ("tonic", C.PRIOR_TONIC)) for cls in C.CLASSES]
    return spark.createDataFrame(rows, "class string, kind string, name string, probability double")


def table_classifier(params: DataFrame, weights: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A classifier for ``detect`` whose parameters are tables, with the gates of the default one.

    ``params`` holds (class, feature, mean, std), ``weights`` (class, kind, name, probability). Both are pivoted to one row, a
    scalar, so frames neither multiply nor shuffle. A feature without parameters does not count for its
    class, a grip without a probability weighs ``GRIP_UNKNOWN``, a class without a prior cannot be.
    """
    features = (*VISION, "ser_2_6hz", "psi")
    grips = sorted({g for table in C.GRIP.values() for g in table})
    cells = {}
    for cls in C.CLASSES:
        for f in features:
            own = (F.col("class") == cls) & (F.col("feature") == f)
            cells[f"m_{cls}_{f}"] = F.max(F.when(own, F.col("mean")))
            cells[f"s_{cls}_{f}"] = F.max(F.when(own, F.col("std")))
    shares = {}
    for cls in C.CLASSES:
        for kind, names in (("grip", grips), ("prior", ("usual", "tonic"))):
            for name in names:
                own = (F.col("class") == cls) & (F.col("kind") == kind) & (F.col("name") == name)
                shares[f"{kind}_{cls}_{name}"] = F.max(F.when(own, F.ln("probability")))
    bells = params.agg(*[c.alias(n) for n, c in cells.items()]).select(F.struct("*").alias("p"))
    logs = weights.agg(*[c.alias(n) for n, c in shares.items()]).select(F.struct("*").alias("w"))

    def density(cls: str, f: str) -> str:
        mean, std = f"_p.m_{cls}_{f}", f"_p.s_{cls}_{f}"
        return f"coalesce(-ln({std} * sqrt(2 * pi())) - power(({f} - {mean}) / {std}, 2) / 2, 0D)"

    def classify(frames: DataFrame) -> DataFrame:
        gated = frames.withColumns(
            {
                "_p": bells.scalar(),
                "_w": logs.scalar(),
                "_vision": F.expr(f"NOT degraded_1 AND face_detected AND optical_snr_db > {double(C.MIN_OPTICAL_SNR_DB)}"),
                "_imu": F.expr("NOT degraded_2 AND imu_heartbeat_ok"),
            }
        )
        scores = {}
        for cls in C.CLASSES:
            grip = " ".join(f"WHEN '{g}' THEN coalesce(_w.grip_{cls}_{g}, {double(math.log(C.GRIP_UNKNOWN))})" for g in grips)
            scores[f"_ll_{cls}"] = F.expr(
                f"CASE WHEN _vision THEN {' + '.join(density(cls, f) for f in VISION)} ELSE 0D END"
                f" + CASE WHEN _imu THEN {density(cls, 'ser_2_6hz')} ELSE 0D END + {density(cls, 'psi')}"
                f" + CASE wheel_grip {grip} ELSE {double(math.log(C.GRIP_UNKNOWN))} END"
                f" + coalesce(CASE WHEN tonic_detected THEN _w.prior_{cls}_tonic ELSE _w.prior_{cls}_usual END, double('-Infinity'))"
            )
        return posterior_columns(gated.withColumns(scores).drop("_p", "_w", "_vision", "_imu"))

    return classify


def table_log_likelihoods(features: DataFrame, params: DataFrame) -> DataFrame:
    """Per-class log likelihood of ungated features under a parameter table.

    ``params`` holds (class, feature, mean, std) of any classes; it is pivoted to
    one array of classes, a scalar, so frames only multiply by the class count.
    """
    names = ["ear", "pitch_deg", "rppg_hr_bpm", "ser_2_6hz", "psi"]
    wide = params.groupBy("class").agg(
        *[F.max(F.when(F.col("feature") == n, F.col("mean"))).alias(f"_m_{n}") for n in names],
        *[F.max(F.when(F.col("feature") == n, F.col("std"))).alias(f"_s_{n}") for n in names],
    )
    per_class = wide.agg(
        F.array_sort(F.collect_list(F.struct("class", *[c for c in wide.columns if c != "class"]))).alias("_params")
    )
    joined = features.withColumn("_p", F.explode(per_class.scalar()))
    terms = [
        f"coalesce(-ln(_p._s_{n} * sqrt(2 * pi())) - power(({n} - _p._m_{n}) / _p._s_{n}, 2) / 2, 0D)"
        for n in names
    ]
    return joined.withColumns(
        {"class": F.col("_p.class"), "log_likelihood": F.expr(" + ".join(terms))}
    ).drop("_p")
