"""Trial and prediction metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.functions.codec import alert_bytes, alert_header_hex, command_bytes
from vitalframe.functions.numeric import half_even, safe_ratio
from vitalframe.operators.audit import frame_checks


def modal_class(
    rows: DataFrame, keys: Sequence[str], label: str, order: str, default: str = "Normal"
) -> DataFrame:
    """Most frequent label per key; the one seen first wins a tie.

    Null labels do not count; keys without any label get ``default``.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys, label).agg(
        F.count(label).alias("_n"), F.min(order).alias("_seen")
    )
    rank = F.struct("_n", (-F.col("_seen")).alias("_early"))
    return counts.groupBy(*keys).agg(
        F.coalesce(F.max_by(label, F.when(F.col(label).isNotNull(), rank)), F.lit(default)).alias(label)
    )


def trial_summary(timeline: DataFrame, keys: Sequence[str], key: bytes) -> DataFrame:
    """One row per trial from its decided and responded frames.

    ``timeline`` is the output of ``respond`` with ``scenario``, ``seed`` and
    ``expected_class``.  Class counts are aggregated first, so that a trial's
    frames are combined before they meet.  At the first trigger the alert is packed and
    measured, and a command frame is packed and put through the bus checks with ``key``.
    """
    keys = list(keys)
    first_frame = F.struct(
        "t",
        "seq",
        "active_class",
        "top_confidence",
        (F.col("persistence_seconds") * 1000).cast("int").alias("latency_ms"),
        F.unix_timestamp("event_time").alias("epoch_s"),
        "longitudinal_accel_mss",
        "hazard_flashers_active",
    )
    after = F.col("t") >= C.EVENT_ONSET_S
    per_class = timeline.groupBy(*keys, "active_class").agg(
        F.count_if(after).alias("_n"),
        F.min(F.when(after, F.col("seq"))).alias("_seen"),
        F.min(F.when(F.col("mrm_trigger_flag"), first_frame)).alias("_first"),
        F.max("seq").alias("_last"),
        F.count(F.lit(1)).alias("frames"),
        F.max_by("mrm_state", "seq").alias("_state"),
        F.max_by("lateral_pos_m", "seq").alias("_lateral"),
        F.first("scenario").alias("scenario"),
        F.first("seed").alias("seed"),
        F.first("expected_class").alias("expected_class"),
    )
    rank = F.when(F.col("_n") > 0, F.struct("_n", (-F.col("_seen")).alias("_early")))
    trials = per_class.groupBy(*keys).agg(
        F.first("scenario").alias("scenario"),
        F.first("seed").alias("seed"),
        F.first("expected_class").alias("expected_class"),
        F.coalesce(F.max_by("active_class", rank), F.lit("Normal")).alias("predicted_class"),
        F.min("_first").alias("_first"),
        F.sum("frames").alias("frames"),
        F.max_by("_state", "_last").alias("_state"),
        F.max_by("_lateral", "_last").alias("_lateral"),
    )
    alert = alert_bytes(
        key, alert_header_hex(*[F.col(f"_first.{c}") for c in ("active_class", "top_confidence", "latency_ms", "epoch_s")])
    )
    command = command_bytes(
        key,
        F.lit(C.COUNTER_START + 1),
        F.lit(C.COMMAND_STATE_CODE),
        F.col("_first.longitudinal_accel_mss"),
        F.col("_first.hazard_flashers_active"),
    )
    trials = frame_checks(
        trials.withColumns(
            {
                "arb_id": F.lit(C.COMMAND_ARB_ID),
                "freshness_counter": F.lit(C.COUNTER_START + 1),
                "payload": command,
                "dlc": F.octet_length(command),
                "_alert": F.octet_length(alert),
            }
        ),
        key,
    )
    checked = F.col("id_ok") & F.col("length_ok") & F.col("tag_ok") & F.col("counter_ok")
    fired = F.col("_first").isNotNull()
    safe = F.col("scenario").isin(*C.SAFE_SCENARIOS)
    return trials.withColumns(
        {
            "mrm_triggered": fired,
            "detection_latency_s": half_even(F.col("_first.t") - C.EVENT_ONSET_S, 3),
            "safe_no_mrm_expected": safe,
            "safe_no_mrm_observed": safe & ~fired,
            "standstill_reached": F.col("_state") == C.PHASES[4],
            "final_lateral_position_m": half_even(F.col("_lateral"), 3),
            "mec_length_bytes": F.when(fired, F.col("_alert")).otherwise(F.lit(0)),
            "prototype_can_verification": fired & F.coalesce(checked, F.lit(False)),
        }
    ).drop(
        "_first", "_state", "_lateral", "_alert", "arb_id", "freshness_counter", "payload", "dlc", "id_ok", "length_ok", "tag_ok", "counter_ok"
    )


def pair_counts(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of (actual, predicted) pairs: all a report needs, and small."""
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(rows: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """Dense matrix, rows actual and columns predicted, zero where nothing fell."""
    spark = rows.sparkSession
    kind = rows.schema[actual].dataType.simpleString()
    domain = spark.createDataFrame([(x,) for x in labels], f"actual {kind}")
    counts = (
        rows.groupBy(F.col(actual).alias("actual"))
        .agg(*[F.count_if(F.col(predicted) == F.lit(x)).alias(str(x)) for x in labels])
    )
    return domain.join(counts, "actual", "left").na.fill(0, [str(x) for x in labels])


def per_class_counts(rows: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """True positives, false positives and false negatives per label."""
    spark = rows.sparkSession
    kind = rows.schema[actual].dataType.simpleString()
    domain = spark.createDataFrame([(x,) for x in labels], f"label {kind}")
    pairs = pair_counts(rows, actual, predicted)
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.lit(True).alias("of_actual")),
                F.struct(F.col("predicted").alias("label"), F.lit(False).alias("of_actual")),
            )
        ).alias("s"),
        "actual",
        "predicted",
        "n",
    ).select("s.label", "s.of_actual", "actual", "predicted", "n")
    hit = F.col("actual") == F.col("predicted")
    counted = sides.groupBy("label").agg(
        F.sum(F.when(hit & F.col("of_actual"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit & ~F.col("of_actual"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & F.col("of_actual"), F.col("n")).otherwise(0)).alias("fn"),
    )
    return domain.join(counted, "label", "left").na.fill(0, ["tp", "fp", "fn"])


def class_metrics(
    rows: DataFrame, actual: str, predicted: str, labels: Sequence, places: int | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per label; 0/0 counts as 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = (
        per_class_counts(rows, actual, predicted, labels)
        .withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn)})
        .withColumn(
            "f1",
            safe_ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
        .withColumn("support", tp + fn)
    )
    if places is not None:
        scored = scored.withColumns(
            {c: half_even(F.col(c), places) for c in ("precision", "recall", "f1")}
        )
    return scored


def overall_metrics(
    rows: DataFrame, actual: str, predicted: str, labels: Sequence, places: int = 4
) -> DataFrame:
    """Accuracy and macro F1 (the mean of the rounded class values)."""
    return class_metrics(rows, actual, predicted, labels, places).agg(
        half_even(safe_ratio(F.sum("tp"), F.sum("support")), places).alias("accuracy"),
        half_even(F.avg("f1"), places).alias("macro_f1"),
        F.sum("support").alias("total"),
    )


def classification_report(rows: DataFrame, actual: str, predicted: str, labels: Sequence) -> DataFrame:
    """Per-label rows plus accuracy, macro and weighted averages, unrounded.

    The input is read once; the summary rows come from the few label rows.
    """
    metrics = ("precision", "recall", "f1")
    scored = class_metrics(rows, actual, predicted, labels).withColumn(
        "label", F.col("label").cast("string")
    )
    total = F.sum("support")

    def line(name: str, values: Sequence[Column]) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            *[v.alias(m) for v, m in zip(values, metrics)],
            total.alias("support"),
        )

    rate = safe_ratio(F.sum("tp"), total)
    weighted = [safe_ratio(F.sum(F.col(m) * F.col("support")), total) for m in metrics]
    packed = scored.agg(
        F.concat(
            F.array_sort(F.collect_list(F.struct("label", *metrics, "support"))),
            F.array(
                line("accuracy", [rate] * 3),
                line("macro avg", [F.avg(m) for m in metrics]),
                line("weighted avg", weighted),
            ),
        ).alias("lines")
    )
    return packed.select(F.inline("lines"))


def latency_summary(trials: DataFrame) -> DataFrame:
    """Count, mean, minimum and maximum latency of the trials that fired."""
    value = F.col("detection_latency_s")
    return trials.agg(
        F.count(value).alias("latency_count"),
        half_even(F.avg(value), 4).alias("latency_mean"),
        F.min(value).alias("latency_min"),
        F.max(value).alias("latency_max"),
    )


def trial_counts(trials: DataFrame) -> DataFrame:
    """False alarms, misses, verified commands and safe trials."""
    wanted, got = F.col("expected_class") == "Normal", F.col("predicted_class") == "Normal"
    return trials.agg(
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if(wanted & ~got).alias("false_positive_count"),
        F.count_if(~wanted & got).alias("false_negative_count"),
        F.count_if("safe_no_mrm_expected").alias("safe_scenario_count"),
        F.count_if("prototype_can_verification").alias("prototype_can_valid_count"),
    )


def distinct_sorted(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of a low-cardinality column as one sorted array."""
    return rows.select(column).distinct().agg(F.array_sort(F.collect_list(column)).alias(column))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(rows: DataFrame, column: str) -> DataFrame:
    """Histogram of a low-cardinality column as one map."""
    return histogram(rows, column).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("histogram")
    )


def balanced_enough(rows: DataFrame, label: str) -> DataFrame:
    """Whether every class has at least two rows (stratifying needs that)."""
    return histogram(rows, label).agg(
        (F.min("n") >= 2).alias("can_stratify"), F.count(F.lit(1)).alias("classes")
    )


def unknown_labels(rows: DataFrame, label: str, domain: Sequence[str]) -> DataFrame:
    """Distinct labels outside the class list."""
    return rows.select(label).distinct().filter(~F.col(label).isin(*domain))


def trial_grid(seeds: DataFrame) -> DataFrame:
    """Every scenario with its expected class for each distinct seed."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("scenario"), F.lit(e).alias("expected_class")) for n, e in C.SCENARIOS]
    )
    return (
        seeds.select("seed").distinct().withColumn("_c", F.explode(cells)).select("seed", "_c.*")
    )


def metrics_report(trials: DataFrame) -> DataFrame:
    """The whole benchmark report as one row, from one pass over the trials.

    Class metrics score the clinical scenarios; write it with ``write_report``.
    """
    wanted, got = F.col("expected_class"), F.col("predicted_class")
    clinical = F.col("scenario").isin(*C.CLINICAL_SCENARIOS)
    latency = F.col("detection_latency_s")
    cells = {
        (a, p): F.count_if(clinical & (wanted == a) & (got == p)).alias(f"_{a}_{p}")
        for a in C.CLASSES
        for p in C.CLASSES
    }
    counted = trials.agg(
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if((wanted == "Normal") & (got != "Normal")).alias("false_positive_count"),
        F.count_if((wanted != "Normal") & (got == "Normal")).alias("false_negative_count"),
        F.count_if("safe_no_mrm_expected").alias("safe_scenario_count"),
        F.count_if("prototype_can_verification").alias("prototype_can_valid_count"),
        F.count(latency).alias("latency_count"),
        half_even(F.avg(latency), 4).alias("latency_mean"),
        F.min(latency).alias("latency_min"),
        F.max(latency).alias("latency_max"),
        F.array_sort(F.collect_set("mec_length_bytes")).alias("mec_length_bytes"),
        *cells.values(),
    )

    def cell(a: str, p: str) -> Column:
        return F.col(f"_{a}_{p}")

    def total(parts: list[Column]) -> Column:
        return reduce(add, parts)

    rows = []
    for label in C.CLASSES:
        hits = cell(label, label)
        recall = safe_ratio(hits, total([cell(label, p) for p in C.CLASSES]))
        precision = safe_ratio(hits, total([cell(a, label) for a in C.CLASSES]))
        rows.append(
            F.struct(
                F.lit(label).alias("label"),
                half_even(precision, 4).alias("precision"),
                half_even(recall, 4).alias("recall"),
                half_even(safe_ratio(2 * precision * recall, precision + recall), 4).alias("f1"),
                total([cell(label, p) for p in C.CLASSES]).alias("support"),
            )
        )
    everything = total([F.col(f"_{a}_{p}") for a, p in cells])
    matrix = F.create_map(
        *[
            x
            for a in C.CLASSES
            for x in (F.lit(a), F.create_map(*[y for p in C.CLASSES for y in (F.lit(p), cell(a, p))]))
        ]
    )
    f1 = total([F.get("per_class", F.lit(i))["f1"] for i in range(len(C.CLASSES))])
    return (
        counted.withColumn("per_class", F.array(*rows))
        .withColumns(
            {
                "confusion_matrix": matrix,
                "accuracy": half_even(
                    safe_ratio(total([cell(c, c) for c in C.CLASSES]), everything), 4
                ),
                "macro_f1": half_even(f1 / len(C.CLASSES), 4),
            }
        )
        .drop(*[f"_{a}_{p}" for a, p in cells])
    )


def scenario_peaks(timeline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final speed, highest confidence and entropy, and any spoof or degraded frame."""
    return timeline.groupBy(*keys).agg(
        F.max_by("speed_kmh", "seq").alias("final_speed_kmh"),
        F.max("top_confidence").alias("peak_confidence"),
        F.max("shannon_entropy").alias("max_entropy"),
        F.bool_or(
            F.col("laser_spoofing_detected") | (F.col("operational_mode") != C.MODE_NOMINAL)
        ).alias("security_or_fault"),
    )


def run_summary(timeline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final state and etiology, spoofs, degradation and a stop on the shoulder."""
    at_end = F.col("_state") == C.PHASES[4]
    return (
        timeline.groupBy(*keys)
        .agg(
            F.max_by(
                F.struct("mrm_state", "confirmed_etiology", "lateral_pos_m"), "seq"
            ).alias("_end"),
            F.bool_or("laser_spoofing_detected").alias("spoofing_blocked"),
            F.bool_or(F.col("operational_mode") != C.MODE_NOMINAL).alias("degraded_mode"),
        )
        .withColumns(
            {
                "_state": F.col("_end.mrm_state"),
                "final_state": F.col("_end.mrm_state"),
                "confirmed_etiology": F.col("_end.confirmed_etiology"),
            }
        )
        .withColumn("safe_shoulder_stop", at_end & (F.col("_end.lateral_pos_m") <= C.SHOULDER_STOP_MAX_M))
        .drop("_end", "_state")
    )
