"""Toxicity: a convolutional text classifier over hashed word embeddings, trained by Spark over all labelled rows: shards learn
side by side in numpy, and after each pass their changes are averaged.

A word's vector is the sum of three rows of one hashed table: the whole word and its first four and five
bytes, so inflected forms share what was learned about their stem. Filters of several widths slide over the
words, each keeps its maximum over the whole text, and a logistic layer weighs these maxima. A group of
languages, told by the letters of the text alone, has its own threshold, which is moved to score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalframe.llm.common import documents, joined_small, lowered, prefix_sums, range_hashes, remainder, sent, stored, text_slices, word_ranges

BUCKETS = 1 << 15
PAD = BUCKETS
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled rows of a shard; a task goes through one shard, batch by batch.
SHARD_ROWS = 8192
#: Texts and words of a gradient step, and of the rows that are put in a new order at a time; a longer text is a step of its own.
STEP_TEXTS, STEP_WORDS = 48, 1 << 18
POOL_TEXTS, POOL_WORDS = 2048, 1 << 21
EPOCHS = 8
#: Step size of the first pass; it falls evenly, since the moments of the steps begin anew with each pass.
RATE = 0.01
#: Changes of weights are added up as whole numbers of this unit, so their sum does not depend on the order.
UNIT = 2.0**-32
#: Logits are counted in steps of 1 / LOGIT_STEPS between -LOGIT_END and LOGIT_END to find thresholds.
LOGIT_STEPS, LOGIT_END = 128, 32

# Second bytes of two-byte letters (first byte C3) that mark a group of languages.
LETTERS = {1: "äöüßÄÖÜ", 2: "éèêàâçîôûÉÈÊÀÇ", 3: "ñóíáúÑÓÍÁÚ"}
GROUPS = 1 + len(LETTERS)

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_words long"


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of three table rows per word, bounds of the texts)."""
    data = lowered(data)
    start, end, bounds = word_ranges(data, offsets, letters=True)
    sums = prefix_sums(data)
    ids = np.empty((len(start), 3), np.int32)
    for k, stop in enumerate((end, np.minimum(start + 4, end), np.minimum(start + 5, end))):
        ids[:, k] = (range_hashes(sums, start, stop) + np.uint64(k * 7919)) % np.uint64(BUCKETS)
    return ids, bounds


def language_groups(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Group of languages of each text by the letters it holds: 0 where none of the marked ones occurs."""
    kind = np.zeros(256, np.int64)
    for group, letters in LETTERS.items():
        for letter in letters:
            kind[letter.encode()[1]] = group
    pair = np.flatnonzero((data[:-1] == 0xC3) & (kind[data[1:]] > 0)) + 1
    text = np.searchsorted(offsets, pair, "right") - 1
    n = len(offsets) - 1
    counts = np.bincount(text * GROUPS + kind[data[pair]], minlength=n * GROUPS).reshape(n, GROUPS)
    return counts.argmax(axis=1)


def padded(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other with padding words behind each: (ids, first, end of filter positions)."""
    n = np.diff(bounds)
    gap = max(WIDTHS) - 1
    first = bounds[:-1] + (gap + 1) * np.arange(len(n))
    out = np.full((len(ids) + (gap + 1) * len(n), 3), PAD, np.int32)
    out[np.arange(len(ids)) + np.repeat(first - bounds[:-1], n)] = ids
    return out, first, first + np.maximum(n, 1)


@dataclass
class Model:
    table: np.ndarray  # (BUCKETS + 1, DIM), the last row is padding and stays 0
    kernels: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    shifts: list[np.ndarray]  # per width: (FILTERS,)
    weights: np.ndarray  # (len(WIDTHS) * FILTERS,)
    bias: float
    thresholds: np.ndarray  # per group of languages, on the logit
    learned: bool = True  # from labels of both kinds

    def pooled(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over each text before the rectifier, and the word vectors."""
        vectors = self.table[ids[:, 0]] + self.table[ids[:, 1]] + self.table[ids[:, 2]]
        cuts = np.empty(2 * len(first), np.int64)
        cuts[::2], cuts[1::2] = first, end
        tops = []
        for kernel, shift in zip(self.kernels, self.shifts):
            seen = vectors @ kernel[0]
            for k in range(1, len(kernel)):
                seen[:-k] += vectors[k:] @ kernel[k]
            tops.append(np.maximum.reduceat(seen, cuts, axis=0)[::2] + shift)
        return np.concatenate(tops, axis=1), vectors

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) == 1:
            return np.zeros(0)
        tops, _ = self.pooled(*padded(ids, bounds))
        return np.maximum(tops, 0) @ self.weights + self.bias

    def flat(self) -> np.ndarray:
        """All weights as rows of DIM numbers: the table, then the rest."""
        rest = np.concatenate([*(k.ravel() for k in self.kernels), *self.shifts, self.weights, [self.bias]])
        return np.concatenate([self.table, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float64)

    def with_flat(self, rows: np.ndarray) -> Model:
        """The model whose weights these rows are."""
        rest, at = rows[BUCKETS + 1 :].ravel(), 0
        parts = []
        for like in (*self.kernels, *self.shifts, self.weights):
            parts.append(rest[at : at + like.size].reshape(like.shape).astype(np.float32))
            at += like.size
        n = len(WIDTHS)
        return replace(
            self, table=rows[: BUCKETS + 1].astype(np.float32), kernels=parts[:n], shifts=parts[n : 2 * n], weights=parts[-1], bias=float(np.float32(rest[at]))
        )

    def scores(self, logits: np.ndarray, groups: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[groups], -30, 30)))


def _fresh(rng: np.random.Generator) -> Model:
    table = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    table[PAD] = 0
    kernels = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weights = np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
    return Model(table, kernels, shifts, weights, 0.0, np.zeros(GROUPS))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.step = rate, {}, 0

    def __call__(self, key: str, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Move ``value`` (or only its ``rows``) against the gradient."""
        m, v = self.state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.99 * v[at] + 0.01 * gradient * gradient
        lift = self.rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        value[at] -= (lift * m[at] / (np.sqrt(v[at]) + 1e-7)).astype(np.float32)


def _steps(texts: list[np.ndarray], order: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the texts of each gradient step."""
    part, size = [], 0
    for i in order:
        if part and (len(part) == STEP_TEXTS or size + len(texts[i]) > STEP_WORDS):
            yield np.array(part)
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield np.array(part)


def _learn(model: Model, pools: Iterator[tuple[list[np.ndarray], np.ndarray]], positive: float, rng: np.random.Generator, rate: float) -> None:
    """One pass of stochastic gradient steps over pools of (word ids, labels); ``positive`` is the share of label 1 among all
    rows. Only the words under a filter's maximum get a gradient."""
    adam = _Adam(rate)
    positive = min(max(positive, 1e-3), 1 - 1e-3)
    for texts, labels in pools:
        weight = np.where(labels > 0, 0.5 / positive, 0.5 / (1 - positive))
        for batch in _steps(texts, rng.permutation(len(texts))):
            adam.step += 1
            bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in batch])])
            ids, first, end = padded(np.concatenate([texts[i] for i in batch]), bounds)
            tops, vectors = model.pooled(ids, first, end)
            active = np.maximum(tops, 0)
            off = 1 / (1 + np.exp(-np.clip(active @ model.weights + model.bias, -30, 30))) - labels[batch]
            off = (off * weight[batch] / len(batch)).astype(np.float32)
            back = off[:, None] * model.weights[None, :] * (tops > 0)
            adam("weights", model.weights, off @ active + 1e-4 * model.weights)
            bias = np.array([model.bias], np.float32)
            adam("bias", bias, np.array([off.sum()]))
            model.bias = float(bias[0])
            rows, parts = [], []
            for w, (kernel, shift) in enumerate(zip(model.kernels, model.shifts)):
                span = slice(w * FILTERS, (w + 1) * FILTERS)
                seen = vectors @ kernel[0]
                for k in range(1, len(kernel)):
                    seen[:-k] += vectors[k:] @ kernel[k]
                best = np.stack([a + seen[a:b].argmax(axis=0) for a, b in zip(first, end)])
                change = np.zeros_like(kernel)
                for k in range(len(kernel)):
                    under = vectors[best + k]  # (texts, FILTERS, DIM)
                    change[k] = np.einsum("tf,tfd->df", back[:, span], under)
                    parts.append((back[:, span, None] * kernel[k].T[None]).reshape(-1, DIM))
                    rows.append(ids[best + k].reshape(-1, 3))
                adam(f"kernel{w}", kernel, change + 1e-5 * kernel)
                adam(f"shift{w}", shift, back[:, span].sum(axis=0))
            flat = np.concatenate(rows)
            pieces = np.concatenate(parts)
            used, slot = np.unique(flat.reshape(-1), return_inverse=True)
            total = np.zeros((len(used), DIM), np.float32)
            np.add.at(total, slot, np.repeat(pieces, 3, axis=0))
            keep = used != PAD
            adam("table", model.table, total[keep], used[keep])


def _threshold(counts: np.ndarray) -> float | None:
    """The middle of the gap that makes the fewest mistakes, of (value, label 0, label 1) rows in order; None without both labels."""
    if not len(counts) or not counts[:, 1].sum() or not counts[:, 2].sum():
        return None
    x, no, yes = counts.T
    mistakes = np.concatenate([[0], np.cumsum(yes)]) + np.concatenate([np.cumsum(no[::-1])[::-1], [0]])
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    best = np.flatnonzero(mistakes == mistakes.min())
    return float(edges[best[len(best) // 2]])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row to learn from, stored: (shard, h, doc_id, label, text, aside). All that follow from the ids alone are the same in
    every run; a shard lies together in one file, in the order of ``h``. A fifth is set aside for the thresholds."""
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0) & F.col("doc_id").isNotNull())
    known = stored(known.select("doc_id", F.col("toxic").cast("int").alias("label")).distinct(), "toxicity_labels")
    n = known.count()
    shards = max(1, -(-n // SHARD_ROWS))
    texts = docs.filter(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = joined_small(texts, known, ["doc_id"], n, 500_000).withColumn("h", F.xxhash64("doc_id"))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartition(shards, "shard")
    # of rows that repeat an id one is learned from
    first = F.row_number().over(Window.partitionBy("shard", "h", "doc_id", "label").orderBy("text"))
    rows = rows.withColumn("_n", first).filter("_n = 1").drop("_n").sortWithinPartitions("shard", "h", "doc_id", "label")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 4
    kept = stored(rows.select("shard", "h", "doc_id", "label", "text", aside.alias("aside")), "toxicity_rows")
    return kept.select("shard", "label", "aside", "text")


def _pools(batches: Iterator[tuple[list[np.ndarray], np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Texts of several slices together, up to the size of a pool."""
    texts, labels, size = [], [], 0
    for some, marks in batches:
        for text, mark in zip(some, marks):
            texts.append(text)
            labels.append(mark)
            size += len(text)
            if len(texts) == POOL_TEXTS or size > POOL_WORDS:
                yield texts, np.asarray(labels, np.float32)
                texts, labels, size = [], [], 0
    if texts:
        yield texts, np.asarray(labels, np.float32)


CHANGES = "slot int, touched long, " + ", ".join(f"d{k} long" for k in range(DIM))


def _pass(rows: DataFrame, model: Model, positive: float, seed: int, rate: float) -> Model:
    """One pass over all ``rows``: each shard learns from the same model, and each weight moves by the mean of the changes of the
    shards that changed it. Sums are made in tasks; what reaches the driver has the size of the model."""
    boxes = []
    shared = sent(rows.sparkSession, model, boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                shard = batch.column(0).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if b > a:
                        yield int(shard[a]), batch.slice(a, b - a)

        def words(of: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for _, batch in of:
                marks = batch.column(1).to_numpy(zero_copy_only=False)
                for first, end, data, offsets in text_slices(batch.column(3)):
                    ids, bounds = word_ids(data, offsets)
                    yield np.split(ids, bounds[1:-1]), marks[first:end]

        for shard, some in groupby(parts(), key=lambda p: p[0]):
            own = shared()
            before = own.flat()
            _learn(own, _pools(words(some)), positive, np.random.default_rng([seed, shard]), rate)
            change = np.rint((own.flat() - before) / UNIT).astype(np.int64)
            slots = np.flatnonzero(change.any(axis=1))
            columns = [pa.array(slots.astype(np.int32)), pa.array(np.ones(len(slots), np.int64))]
            columns += [pa.array(np.ascontiguousarray(change[slots, k])) for k in range(DIM)]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "touched", *(f"d{k}" for k in range(DIM))])

    changes = rows.mapInArrow(run, CHANGES).groupBy("slot").agg(F.sum("touched").alias("touched"), *[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIM)])
    found = changes.toArrow()  # at most one row per row of the model
    boxes.pop().destroy()
    moved = model.flat()
    total = np.stack([found.column(f"d{k}").to_numpy() for k in range(DIM)], axis=1)
    moved[found.column("slot").to_numpy()] += total * UNIT / found.column("touched").to_numpy()[:, None]
    return model.with_flat(moved)


def _logit_counts(rows: DataFrame, model: Model) -> np.ndarray:
    """(group of languages, aside, logit, rows of label 0, of label 1) of all ``rows``, logits in steps."""
    boxes = []
    shared = sent(rows.sparkSession, model, boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(3)):
                logits = np.clip(own.logits(*word_ids(data, offsets)), -LOGIT_END, LOGIT_END)
                step = np.floor(logits * LOGIT_STEPS).astype(np.int32)
                columns = [pa.array(language_groups(data, offsets).astype(np.int32)), batch.column(2).slice(first, end - first)]
                columns += [pa.array(step), batch.column(1).slice(first, end - first)]
                yield pa.RecordBatch.from_arrays(columns, ["language", "aside", "step", "label"])

    told = rows.mapInArrow(run, "language int, aside boolean, step int, label int").groupBy("language", "aside", "step")
    found = told.agg(F.count_if(F.col("label") == 0).alias("no"), F.count_if(F.col("label") == 1).alias("yes")).toArrow()
    boxes.pop().destroy()
    table = np.stack([found.column(i).to_numpy().astype(np.float64) for i in range(5)], axis=1)
    table[:, 2] = (table[:, 2] + 0.5) / LOGIT_STEPS
    return table[np.lexsort(table.T[:3])]


def _summed(table: np.ndarray) -> np.ndarray:
    """(logit, label 0, label 1) of rows of ``_logit_counts``, each logit once, in order."""
    values, slot = np.unique(table[:, 2], return_inverse=True)
    return np.stack([values, np.bincount(slot, table[:, 3], len(values)), np.bincount(slot, table[:, 4], len(values))], axis=1)


def train(docs: DataFrame, labels: DataFrame, seed: int = 9, epochs: int = EPOCHS) -> Model:
    """The model learned from every labelled row, on four fifths of them; the rest gives the thresholds, or all where it lacks a label.

    Each pass goes over all rows, shard by shard in tasks; the driver holds nothing but weights and counts.
    """
    rows = training_rows(docs, labels)
    model = _fresh(np.random.default_rng(seed))
    sizes = {(r["aside"], r["label"]): r["n"] for r in rows.groupBy("aside", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    no, yes = ({a: sizes.get((a, k), 0) for a in (False, True)} for k in (0, 1))
    n, ones = sum(sizes.values()), sum(yes.values())
    if not 0 < ones < n:
        model.bias = float(np.log((ones + 1) / (n - ones + 1)))
        model.weights[:] = 0
        model.learned = False
        return model
    if no[False] and yes[False]:
        fitted, positive = rows.filter("not aside"), yes[False] / (no[False] + yes[False])
    else:
        fitted, positive = rows, ones / n
    for k in range(epochs):
        model = _pass(fitted, model, positive, seed + k, RATE * (1 - k / epochs))
    table = _logit_counts(rows, model)
    aside = table[table[:, 1] > 0] if no[False] and yes[False] else table[:0]
    base = _threshold(_summed(aside))
    base = _threshold(_summed(table)) if base is None else base
    for g in range(GROUPS):
        own = _summed(aside[aside[:, 0] == g])
        found = _threshold(own) if own[:, 2].sum() >= 5 else None
        model.thresholds[g] = base if found is None else found
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and n_words of every document; reads the whole text and nothing else.

    Null and empty texts are padding only and get the score of no words. Repeated rows get equal scores.
    """
    shared = sent(docs.sparkSession, model)  # about 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            scores, sizes = [], []
            for _, _, data, offsets in text_slices(batch.column(2)):
                ids, bounds = word_ids(data, offsets)
                scores.append(own.scores(own.logits(ids, bounds), language_groups(data, offsets)))
                sizes.append(np.diff(bounds))
            value = np.concatenate(scores) if scores else np.zeros(0)
            count = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array(value),
                    pa.array((value >= 0.5).astype(np.int32)),
                    pa.array(count.astype(np.int64)),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_words"],
            )

    return docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled documents whose crc32 remainder by 5 is not 0, score all.

    Labels other than 0 and 1, null ids and labels without a document are not learned from; a document with both
    labels counts for each, of rows that repeat an id one is learned from. Without both
    labels the model is the share of toxic rows. An empty table gives no rows.
    """
    return score(docs, train(docs, labels))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that the classifier does not reject; rows with a null id are scored too.

    Without labels of both kinds nothing can be told apart, and all documents stay.
    """
    model = train(docs, labels)
    if not model.learned:
        return docs
    shared = sent(docs.sparkSession, model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            fine = [
                own.scores(own.logits(*word_ids(data, offsets)), language_groups(data, offsets)) < 0.5
                for _, _, data, offsets in text_slices(batch.column("text"))
            ]
            yield batch.filter(pa.array(np.concatenate(fine))) if fine else batch

    return docs.mapInArrow(keep, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
