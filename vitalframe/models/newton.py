"""Multinomial logistic regression by Newton steps on summed statistics.

A step needs the gradient and the Hessian of the loss, both sums over the rows. Every task sums what its rows add, the
sums of the tasks meet in one grouped sum, and the driver solves one small linear system: rows are never collected, and
what travels has the size of the parameters squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.models.learned import usable
from vitalframe.sources.tables import cut_lineage

#: Penalty of an intercept: only there to make the solution unique; a shift of all intercepts changes no probability.
INTERCEPT_RIDGE = 1e-6


@dataclass
class NewtonModel:
    """Class list, scaling and weights (classes x (intercept, features)); ``norms`` are the gradient's norms before each step."""

    classes: list
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    norms: list[float]

    def score(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Add ``prediction`` and ``probability`` as column expressions; null where a row is not ``usable``."""
        centre, factor = F.lit(self.mean.tolist()), F.lit(_factor(self.std).tolist())
        x = F.zip_with(F.zip_with(F.col(features), centre, lambda v, m: v - m), factor, lambda v, f: v * f)
        scored = rows.withColumn("_usable", usable(features)).withColumn("_x", F.when(F.col("_usable"), x))
        sums = [
            F.aggregate(F.zip_with("_x", F.lit(w[1:].tolist()), lambda a, b: a * b), F.lit(float(w[0])), lambda s, v: s + v) for w in self.weights
        ]
        scored = scored.withColumn("_s", F.array(*sums)).withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))))
        total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
        scored = scored.withColumn("probability", F.when(F.col("_usable"), F.transform("_e", lambda e: e / total)))
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return scored.withColumn("prediction", F.get(F.lit(list(self.classes)), best - 1)).drop("_usable", "_x", "_s", "_e")

    def coefficients(self) -> list[tuple]:
        """(class, feature number or -1 for the intercept, weight); intercepts are shown with mean zero."""
        w = self.weights.copy()
        w[:, 0] -= w[:, 0].mean()
        return [(str(c), j - 1, float(w[k, j])) for k, c in enumerate(self.classes) for j in range(w.shape[1])]


def _factor(std: np.ndarray) -> np.ndarray:
    return np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)


def fit_newton(
    rows: DataFrame, label: str, features: str = "features", classes: Sequence | None = None, steps: int = 25, ridge: float = 1.0, tolerance: float = 1e-9
) -> NewtonModel:
    """Weights that minimise the summed log loss plus ``ridge`` / 2 times the squared coefficients of standardised features.

    Each step is halved until the loss does not rise. It ends after ``steps`` steps or when the gradient is below ``tolerance``
    times the rows. Rows that are not ``usable`` or whose label is not among ``classes`` (default: all labels) are left out.
    """
    kept = rows.filter(usable(features, label)).select(F.col(features).alias("x"), F.col(label).alias("label"))
    counts = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes = [c for c in (classes or sorted(counts)) if c in counts]
    if not classes:
        raise ValueError("none of the rows has features and a label")
    kept = cut_lineage(kept.filter(F.col("label").isin(classes)).select("x", (F.array_position(F.lit(classes), F.col("label")) - 1).cast("int").alias("y")))
    moments = kept.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect()
    width = len(moments)
    mean, std = np.zeros(width), np.zeros(width)
    for r in moments:
        mean[r["i"]], std[r["i"]] = r["m"], r["s"] or 0.0
    n, k, p = sum(counts[c] for c in classes), len(classes), width + 1
    penalty = np.tile(np.append(INTERCEPT_RIDGE, np.full(width, ridge)), k)
    factor = _factor(std)

    def statistics(w: np.ndarray, second: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """(loss, gradient, Hessian) at ``w`` in one pass."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k * p + 1, k * p + 1 if second else 2))
            for batch in batches:
                x = np.asarray(batch.column(0).flatten()).reshape(-1, width)
                y = np.asarray(batch.column(1))
                x = np.hstack([np.ones((len(x), 1)), (x - mean) * factor])
                s = x @ w.T
                s -= s.max(axis=1, keepdims=True)
                mass = np.exp(s).sum(axis=1)
                q = np.exp(s) / mass[:, None]
                total[-1, -1] += (np.log(mass) - s[np.arange(len(y)), y]).sum()
                d = q.copy()
                d[np.arange(len(y)), y] -= 1.0
                total[:-1, -1] += (d.T @ x).ravel()
                if second:
                    for a in range(k):
                        for b in range(a + 1):
                            weight = q[:, a] * ((a == b) - q[:, b])
                            part = x.T @ (x * weight[:, None])
                            total[a * p : a * p + p, b * p : b * p + p] += part
                            if a != b:
                                total[b * p : b * p + p, a * p : a * p + p] += part
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

        out = np.zeros((k * p + 1, k * p + 1 if second else 2))
        for r in kept.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
            out[r["i"], r["j"]] = r["s"]
        flat = w.ravel()
        return out[-1, -1] + (penalty * flat * flat).sum() / 2, out[:-1, -1] + penalty * flat, out[:-1, :-1]

    w, norms = np.zeros((k, p)), []
    loss, gradient, hessian = statistics(w, True)
    for _ in range(steps):
        norms.append(float(np.abs(gradient).max()))
        if norms[-1] <= tolerance * n:
            break
        move = np.linalg.solve(hessian + np.diag(penalty), gradient).reshape(k, p)
        share = 1.0
        ahead = statistics(w - move, True)
        while ahead[0] > loss + 1e-12 * abs(loss) and share > 1e-3:
            share /= 2
            ahead = statistics(w - share * move, True)
        w = w - share * move
        loss, gradient, hessian = ahead
    return NewtonModel(list(classes), mean, std, w, norms)


def newton_sql(rows: str, width: int, classes: Sequence[int], steps: int, ridge: float = 1.0) -> str:
    """CTEs that take full Newton steps from zero, ending in ``w<steps>`` (w: the weights in a list).

    ``rows`` is a relation (id, y, x): y the class's place from 0 and x the standardised features after a leading 1.
    """
    k, p = len(classes), width + 1
    size = k * p
    parts = [f"w0 AS (SELECT list_transform(range({size}), lambda i: 0.0::DOUBLE) AS w)", f"ks AS (SELECT range AS k FROM range({k}))", f"js AS (SELECT range AS j FROM range({p}))"]
    ridge_of = f"CASE WHEN i % {p} = 0 THEN {INTERCEPT_RIDGE!r}::DOUBLE ELSE {float(ridge)!r}::DOUBLE END"
    for s in range(steps):
        parts.append(
            f"""s{s} AS (SELECT id, y, x, k, list_dot_product(w[k * {p} + 1 : k * {p} + {p}], x) AS s FROM {rows}, ks, w{s}),
q{s} AS (SELECT id, y, x, k, exp(s - max(s) OVER (PARTITION BY id)) / sum(exp(s - m)) OVER (PARTITION BY id) AS q FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM s{s})),
g{s} AS (SELECT k * {p} + j AS i, sum((q - CASE WHEN y = k THEN 1 ELSE 0 END) * x[j + 1]) AS g FROM q{s}, js GROUP BY ALL),
h{s} AS (SELECT a.k * {p} + ja.j AS i, b.k * {p} + jb.j AS c, sum(a.q * (CASE WHEN a.k = b.k THEN 1 ELSE 0 END - b.q) * a.x[ja.j + 1] * a.x[jb.j + 1]) AS h
  FROM q{s} a JOIN q{s} b USING (id), js ja, js jb GROUP BY ALL),
r{s} AS (SELECT i, list(h + CASE WHEN i = c THEN {ridge_of} ELSE 0 END ORDER BY c) AS row FROM h{s} GROUP BY i),
m{s} AS (SELECT list(list_append(row, g + ({ridge_of}) * (SELECT w FROM w{s})[i + 1]) ORDER BY i) AS m FROM r{s} JOIN g{s} USING (i)),
e{s} AS (SELECT 1 AS t, m FROM m{s}
  UNION ALL SELECT t + 1, list_transform(range(1, {size + 1}), lambda i: CASE WHEN i = t THEN list_transform(m[t], lambda v: v / m[t][t])
    ELSE list_transform(list_zip(m[i], m[t]), lambda z: z[1] - m[i][t] / m[t][t] * z[2]) END) FROM e{s} WHERE t <= {size}),
w{s + 1} AS (SELECT list_transform(list_zip(w, m), lambda z: z[1] - z[2][{size + 1}]) AS w FROM w{s}, e{s} WHERE t = {size + 1})"""
        )
    return ", ".join(parts)
