"""Registered queries: trial evaluation and prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.catalog.common import SESSION, frames, responses, timeline_sql, trials_sql
from vitalframe.catalog.messages import KEY
from vitalframe.operators import evaluate as E
from vitalframe.operators.splits import group_split, stratified_split
from vitalframe.sources.tables import union_all
from vitalframe.sources.testviews import frames_sql, table

TRIAL_COLUMNS = [
    "driver_id",
    "session_id",
    "scenario",
    "seed",
    "expected_class",
    "predicted_class",
    "frames",
    "mrm_triggered",
    "detection_latency_s",
    "safe_no_mrm_expected",
    "safe_no_mrm_observed",
    "standstill_reached",
    "final_lateral_position_m",
    "mec_length_bytes",
    "prototype_can_verification",
]


def trials(spark, sf):
    return E.trial_summary(responses(spark, sf), SESSION, KEY)


def trial_summary(spark, sf):
    return trials(spark, sf).select(*TRIAL_COLUMNS)


TRIAL_SUMMARY = f"WITH {trials_sql()} SELECT {', '.join(TRIAL_COLUMNS)} FROM trials"

LABELS = list(C.CLASSES)


def trial_confusion(spark, sf):
    return E.confusion_matrix(trials(spark, sf), "expected_class", "predicted_class", LABELS)


TRIAL_CONFUSION = f"""WITH {trials_sql()}, d(actual) AS (VALUES ('Normal'), ('Syncope'), ('Seizure'))
SELECT actual, count(*) FILTER (predicted_class = 'Normal') AS "Normal",
  count(*) FILTER (predicted_class = 'Syncope') AS "Syncope",
  count(*) FILTER (predicted_class = 'Seizure') AS "Seizure"
FROM d LEFT JOIN trials ON actual = expected_class GROUP BY actual"""


def metrics_sql(source: str, actual: str, predicted: str, labels: list, places: int | None) -> str:
    """Per-label metrics over a relation, one correlated count per cell."""
    values = ", ".join(f"('{x}')" if isinstance(x, str) else f"({x})" for x in labels)
    r = (lambda c: f"round({c}, {places})") if places is not None else (lambda c: c)
    return f"""dom(label) AS (VALUES {values}),
c AS (SELECT label, (SELECT count(*) FROM {source} WHERE {actual} = label AND {predicted} = label) AS tp,
        (SELECT count(*) FROM {source} WHERE {actual} <> label AND {predicted} = label) AS fp,
        (SELECT count(*) FROM {source} WHERE {actual} = label AND {predicted} <> label) AS fn FROM dom),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS p,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS r FROM c),
m AS (SELECT label, tp, fp, fn, {r('p')} AS precision, {r('r')} AS recall,
        {r('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END')} AS f1, tp + fn AS support FROM pr)"""


def trial_class_metrics(spark, sf):
    clinical = trials(spark, sf).filter(F.col("scenario").isin(*C.CLINICAL_SCENARIOS))
    return E.class_metrics(clinical, "expected_class", "predicted_class", LABELS, 4)


CLINICAL = f"{trials_sql()}, clin AS (SELECT * FROM trials WHERE scenario IN {C.CLINICAL_SCENARIOS})"
TRIAL_METRICS = f"""WITH {CLINICAL}, {metrics_sql('clin', 'expected_class', 'predicted_class', LABELS, 4)}
SELECT label, tp, fp, fn, precision, recall, f1, support FROM m"""


def trial_overall_metrics(spark, sf):
    clinical = trials(spark, sf).filter(F.col("scenario").isin(*C.CLINICAL_SCENARIOS))
    return E.overall_metrics(clinical, "expected_class", "predicted_class", LABELS)


TRIAL_OVERALL = f"""WITH {CLINICAL}, {metrics_sql('clin', 'expected_class', 'predicted_class', LABELS, 4)}
SELECT round(CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support)::DOUBLE ELSE 0.0::DOUBLE END, 4) AS accuracy,
  round(avg(f1), 4) AS macro_f1, sum(support)::BIGINT AS total FROM m"""


def pairs(spark, sf):
    """Actual and predicted classes for every event: two labellings of the same row."""
    kind = F.col("event_type")
    actual = F.when(kind == "error", "Seizure").when(kind == "signup", "Syncope").otherwise("Normal")
    guess = (
        F.when(F.col("event_id") % 11 == 0, "Normal")
        .when(F.col("event_id") % 13 == 0, "Seizure")
        .otherwise(actual)
    )
    return table(spark, sf, "events").select("event_id", actual.alias("actual"), guess.alias("predicted"))


PAIRS = """pairs AS (SELECT event_id, actual, CASE WHEN event_id % 11 = 0 THEN 'Normal'
    WHEN event_id % 13 = 0 THEN 'Seizure' ELSE actual END AS predicted
  FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'Seizure' WHEN 'signup' THEN 'Syncope'
          ELSE 'Normal' END AS actual FROM events))"""


def confusion_matrix(spark, sf):
    return E.confusion_matrix(pairs(spark, sf), "actual", "predicted", LABELS)


CONFUSION = f"""WITH {PAIRS} SELECT actual, count(*) FILTER (predicted = 'Normal') AS "Normal",
  count(*) FILTER (predicted = 'Syncope') AS "Syncope", count(*) FILTER (predicted = 'Seizure') AS "Seizure"
FROM pairs GROUP BY actual"""


def report_rows(rows, actual, predicted, labels):
    out = E.classification_report(rows, actual, predicted, labels)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def report_sql(head: str, source: str, actual: str, predicted: str, labels: list) -> str:
    cols = ("precision", "recall", "f1")
    r = lambda exprs: ", ".join(f"round({e}, 9) AS {c}" for e, c in zip(exprs, cols))
    rate = "sum(tp) / sum(support)::DOUBLE"
    return f"""WITH {head}{metrics_sql(source, actual, predicted, labels, None)}
SELECT CAST(label AS VARCHAR) AS label, {r(cols)}, support FROM m
UNION ALL SELECT 'accuracy', {r([rate] * 3)}, sum(support)::BIGINT FROM m
UNION ALL SELECT 'macro avg', {r([f'avg({c})' for c in cols])}, sum(support)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', {r([f'sum({c} * support) / sum(support)' for c in cols])}, sum(support)::BIGINT FROM m"""


def classification_report(spark, sf):
    return report_rows(pairs(spark, sf), "actual", "predicted", LABELS)


def quality_report(spark, sf):
    return report_rows(table(spark, sf, "labels"), "quality", "toxic", [0, 1])


def latency_summary(spark, sf):
    return E.latency_summary(trials(spark, sf))


LATENCY = f"""WITH {trials_sql()} SELECT count(detection_latency_s) AS latency_count,
  round(avg(detection_latency_s), 4) AS latency_mean, min(detection_latency_s) AS latency_min,
  max(detection_latency_s) AS latency_max FROM trials"""


def trial_counts(spark, sf):
    return E.trial_counts(trials(spark, sf))


COUNTS = f"""WITH {trials_sql()} SELECT count(*) AS total_trials,
  count(*) FILTER (expected_class = 'Normal' AND predicted_class <> 'Normal') AS false_positive_count,
  count(*) FILTER (expected_class <> 'Normal' AND predicted_class = 'Normal') AS false_negative_count,
  count(*) FILTER (safe_no_mrm_expected) AS safe_scenario_count,
  count(*) FILTER (prototype_can_verification) AS prototype_can_valid_count FROM trials"""


def metrics_report(spark, sf):
    report = E.metrics_report(trials(spark, sf))
    return report.drop("per_class", "confusion_matrix").withColumn(
        "mec_length_bytes", F.array_join("mec_length_bytes", ",")
    )


METRICS_REPORT = f"""WITH {CLINICAL}, {metrics_sql('clin', 'expected_class', 'predicted_class', LABELS, 4)},
o AS (SELECT round(CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support)::DOUBLE ELSE 0.0::DOUBLE END, 4) AS accuracy,
      round(avg(f1), 4) AS macro_f1 FROM m),
t AS ({COUNTS[COUNTS.rindex('SELECT count(*) AS total'):]}),
l AS ({LATENCY[LATENCY.rindex('SELECT count(detection'):]}),
n AS (SELECT string_agg(CAST(mec_length_bytes AS VARCHAR), ',' ORDER BY mec_length_bytes) AS mec_length_bytes
      FROM (SELECT DISTINCT mec_length_bytes FROM trials))
SELECT * FROM t, o, l, n"""


def distinct_labels(spark, sf):
    return E.distinct_sorted(pairs(spark, sf), "predicted").select(
        F.array_join("predicted", ",").alias("labels")
    )


DISTINCT = f"""WITH {PAIRS} SELECT string_agg(predicted, ',' ORDER BY predicted) AS labels
FROM (SELECT DISTINCT predicted FROM pairs)"""


def mode_histogram(spark, sf):
    from vitalframe.catalog.common import decisions

    return E.histogram(decisions(spark, sf), "operational_mode")


def mode_histogram_map(spark, sf):
    out = E.histogram_map(pairs(spark, sf), "actual")
    return out.select(F.to_json("histogram").alias("histogram"))


HISTOGRAM_MAP = f"""WITH {PAIRS}, h AS (SELECT actual, count(*) AS n FROM pairs GROUP BY actual)
SELECT '{{' || string_agg('"' || actual || '":' || n, ',' ORDER BY actual) || '}}' AS histogram FROM h"""


def modal_class(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return E.modal_class(ev, ["user_id"], "event_type", "event_id")


MODAL = """SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen
  FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1"""


def trial_grid(spark, sf):
    return E.trial_grid(frames(spark, sf))


TRIAL_GRID = f"""WITH {frames_sql()}, s AS (SELECT DISTINCT seed FROM frames_v),
c(scenario, expected_class) AS (VALUES {', '.join(str(x) for x in C.SCENARIOS)})
SELECT seed, scenario, expected_class FROM s, c"""


def scenario_peaks(spark, sf):
    out = E.scenario_peaks(responses(spark, sf), [*SESSION, "scenario"])
    return out.withColumns(
        {c: F.round(c, 6) for c in ("final_speed_kmh", "peak_confidence", "max_entropy")}
    )


PEAKS = f"""WITH {timeline_sql()} SELECT driver_id, session_id, scenario,
  round(arg_max(speed_kmh, seq), 6) AS final_speed_kmh, round(max(top_confidence), 6) AS peak_confidence,
  round(max(shannon_entropy), 6) AS max_entropy,
  bool_or(laser_spoofing_detected OR operational_mode <> 'Nominal Mode') AS security_or_fault
FROM timeline GROUP BY driver_id, session_id, scenario"""


def fault_summary(spark, sf):
    return E.run_summary(responses(spark, sf), [*SESSION, "scenario"])


FAULTS = f"""WITH {timeline_sql()} SELECT driver_id, session_id, scenario, arg_max(mrm_state, seq) AS final_state,
  arg_max(confirmed_etiology, seq) AS confirmed_etiology, bool_or(laser_spoofing_detected) AS spoofing_blocked,
  bool_or(operational_mode <> 'Nominal Mode') AS degraded_mode,
  arg_max(mrm_state, seq) = 'PHASE_4_STANDSTILL' AND arg_max(lateral_pos_m, seq) <= -6.5 AS safe_shoulder_stop
FROM timeline GROUP BY driver_id, session_id, scenario"""


def class_balance(spark, sf):
    return E.balanced_enough(pairs(spark, sf), "actual")


BALANCE = f"""WITH {PAIRS} SELECT min(n) >= 2 AS can_stratify, count(*) AS classes
FROM (SELECT actual, count(*) AS n FROM pairs GROUP BY actual)"""


def unknown_labels(spark, sf):
    return E.unknown_labels(table(spark, sf, "events"), "event_type", ["click", "view", "signup"])


def split_sizes(spark, sf):
    parted = stratified_split(pairs(spark, sf), "actual", ["event_id"])
    return parted.groupBy("actual").agg(
        F.count_if("is_train").alias("train_rows"), F.count_if(~F.col("is_train")).alias("test_rows")
    )


SPLIT_SIZES = f"""WITH {PAIRS} SELECT actual, floor(count(*) * 0.75)::BIGINT AS train_rows,
  count(*) - floor(count(*) * 0.75)::BIGINT AS test_rows FROM pairs GROUP BY actual"""


def group_split_sizes(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 30).alias("seed"))
    return group_split(rows, "seed").groupBy("is_train").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seed").alias("groups")
    )


GROUP_SPLIT = """WITH g AS (SELECT user_id % 30 AS seed FROM events), n AS (SELECT max(seed) + 1 AS n FROM g)
SELECT seed < greatest(2, floor(n * 0.8)) AS is_train, count(*) AS n, count(DISTINCT seed) AS groups
FROM g, n GROUP BY 1"""


def session_union(spark, sf):
    left = table(spark, sf, "events").select("event_id", F.lit("first").alias("part"))
    right = table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"), F.lit("second").alias("part"))
    return union_all(left, right).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total")
    )


SESSION_UNION = """SELECT part, count(*) AS n, sum(event_id)::BIGINT AS total FROM (
  SELECT event_id, 'first' AS part FROM events UNION ALL SELECT doc_id, 'second' FROM labels) GROUP BY part"""

QUERIES = {
    "trial_summary": (trial_summary, TRIAL_SUMMARY),
    "trial_confusion": (trial_confusion, TRIAL_CONFUSION),
    "trial_class_metrics": (trial_class_metrics, TRIAL_METRICS),
    "trial_overall_metrics": (trial_overall_metrics, TRIAL_OVERALL),
    "confusion_matrix": (confusion_matrix, CONFUSION),
    "classification_report": (
        classification_report,
        report_sql(f"{PAIRS}, ", "pairs", "actual", "predicted", LABELS),
    ),
    "quality_report": (quality_report, report_sql("", "labels", "quality", "toxic", [0, 1])),
    "latency_summary": (latency_summary, LATENCY),
    "trial_counts": (trial_counts, COUNTS),
    "metrics_report": (metrics_report, METRICS_REPORT),
    "distinct_labels": (distinct_labels, DISTINCT),
    "mode_histogram": (
        mode_histogram,
        f"WITH {timeline_sql()} SELECT operational_mode, count(*) AS n FROM timeline GROUP BY operational_mode",
    ),
    "histogram_map": (mode_histogram_map, HISTOGRAM_MAP),
    "modal_class": (modal_class, MODAL),
    "trial_grid": (trial_grid, TRIAL_GRID),
    "scenario_peaks": (scenario_peaks, PEAKS),
    "fault_summary": (fault_summary, FAULTS),
    "class_balance": (class_balance, BALANCE),
    "unknown_labels": (
        unknown_labels,
        "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view', 'signup')",
    ),
    "stratified_split_sizes": (split_sizes, SPLIT_SIZES),
    "group_split_sizes": (group_split_sizes, GROUP_SPLIT),
    "session_union": (session_union, SESSION_UNION),
}
