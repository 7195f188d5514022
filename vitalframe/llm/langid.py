"""Language ID: script ranges narrow the languages of each word, Viterbi with a switching penalty labels spans.

A word is a run of letters. Each letter with its two neighbours (or the word's edge) is a hashed trigram; a
word's score in a language is the sum of log probabilities of its trigrams. Only languages that were seen in the
word's script compete for it. The best path over all words of a text pays SWITCH for each change of language;
its runs are the spans. The text's language is the one that labels most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import documents, mixed, remainder, sent, text_slices

BUCKETS = 1 << 15
SMOOTHING = 0.05
SWITCH = 6.0
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"

# First code points of script ranges; ranges without a name are "other".
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_KINDS = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.int8)
_TABLES: dict[str, np.ndarray] = {}

SCHEMA = (
    "doc_id long, held_out boolean, lang_pred string, score double, n_words long, "
    "spans array<struct<first:int,end:int,lang:string>>"
)


def _tables() -> dict[str, np.ndarray]:
    """Per code point: is it a letter, its lower case, its script."""
    if not _TABLES:
        n = 0x32000
        chars = [chr(c) for c in range(n)]
        _TABLES["letter"] = np.array([unicodedata.category(c)[0] == "L" for c in chars] + [False])
        lower = np.arange(n + 1, dtype=np.int32)
        for i, c in enumerate(chars):
            low = c.lower() if _TABLES["letter"][i] else c
            if len(low) == 1:
                lower[i] = ord(low)
        _TABLES["lower"] = lower
        _TABLES["script"] = _KINDS[np.searchsorted(_STARTS, np.arange(n + 1), "right") - 1]
    return _TABLES


@dataclass
class Words:
    """Words of a slice of texts."""

    buckets: np.ndarray  # per letter
    script: np.ndarray  # per letter
    start: np.ndarray  # per word: its first letter
    first: np.ndarray  # per word: its first character in the text
    end: np.ndarray  # per word: the character behind it
    bounds: np.ndarray  # per text: its first word

    @property
    def letters(self) -> np.ndarray:
        return np.diff(np.append(self.start, len(self.buckets)))


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    tables = _tables()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.minimum(points, len(tables["letter"]) - 1)
    inside = tables["letter"][points]
    fresh = np.zeros(len(points) + 1, bool)
    fresh[heads] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | fresh[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | fresh[1:-1]
    at = np.flatnonzero(inside)
    low = tables["lower"][points]
    before = np.zeros(len(points), np.int32)
    before[1:] = low[:-1]
    before[opens] = 1
    after = np.zeros(len(points), np.int32)
    after[:-1] = low[1:]
    after[closes] = 2
    code = (before[at].astype(np.uint64) << np.uint64(42)) | (low[at].astype(np.uint64) << np.uint64(21)) | after[at].astype(np.uint64)
    first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    bounds = np.searchsorted(first, heads)
    text = np.repeat(heads[:-1], np.diff(bounds))
    return Words(
        (mixed(code) >> np.uint64(49)).astype(np.int32),
        tables["script"][points[at]],
        np.searchsorted(at, first),
        first - text,
        end - text,
        bounds,
    )


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages), float32 log probabilities
    allowed: np.ndarray  # (scripts, languages)

    def word_scores(self, w: Words) -> np.ndarray:
        """(words, languages): sums of log probabilities; a language the word's script rules out has -1e9."""
        scores = np.empty((len(w.start), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            scores[:, k] = np.add.reduceat(self.table[:, k][w.buckets], w.start)
        scores[~self.allowed[w.script[w.start]]] = -1e9
        return scores

    def paths(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Best language of every word. Texts advance together, one word a step, longest first."""
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        path = np.zeros(len(scores), np.int16)
        if not len(order):
            return path
        size, head = n[order], bounds[:-1][order]
        alive = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with more than t words
        stay = np.empty(scores.shape, bool)  # per word and language: it follows the same language
        jump = np.zeros(len(scores), np.int16)  # else it follows this one
        total = scores[head].astype(np.float64)
        for t in range(1, size[0]):
            k = alive[t]
            now = total[:k]
            top = now.argmax(axis=1)
            switched = now[np.arange(k), top] - SWITCH
            at = head[:k] + t
            keep = now >= switched[:, None]
            stay[at] = keep
            jump[at] = top
            total[:k] = np.where(keep, now, switched[:, None]) + scores[at]
        state = total.argmax(axis=1).astype(np.int16)
        for t in range(size[0] - 1, 0, -1):
            k = alive[t]
            at = head[:k] + t
            path[at] = state[:k]
            state[:k] = np.where(stay[at, state[:k]], state[:k], jump[at])
        path[head] = state
        return path


def counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, slot, n): trigrams by bucket (kind 0) and letters by script (kind 1) of rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, _, data, offsets in text_slices(batch.column(1)):
                w = split_words(data, offsets)
                at = np.append(w.start, len(w.buckets))[w.bounds]
                for t, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    own = sums.setdefault(langs[first + t], (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
                    np.add.at(own[0], w.buckets[a:b], 1)
                    np.add.at(own[1], w.script[a:b], 1)
        for lang, both in sums.items():
            for kind, values in enumerate(both):
                slot = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(slot), pa.string()), pa.array(np.full(len(slot), kind, np.int32)), pa.array(slot.astype(np.int32)), pa.array(values[slot])],
                    ["lang", "kind", "slot", "n"],
                )

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, kind int, slot int, n long")
    return rows.groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model | None:
    """Counts over all rows with a language; BUCKETS numbers per language reach the driver. None without a letter."""
    table = counts(docs.filter("lang is not null")).toPandas()
    languages = sorted(table["lang"].unique())
    if not languages:
        return None
    slot = {name: i for i, name in enumerate(languages)}
    grams = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for kind, out in ((0, grams), (1, scripts)):
        part = table[table["kind"] == kind]
        out[part["slot"], part["lang"].map(slot)] = part["n"]
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    allowed = share >= SCRIPT_SHARE
    allowed[~allowed.any(axis=1)] = True
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
    return Model(languages, logs.astype(np.float32), allowed)


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and spans (characters [first, end) and their language).

    score is the share of the text's letters that lang_pred labels; ties go to the first language by name.
    Null texts and texts without a letter are ``und`` with score 0 and no spans; so is all without a model.
    """
    shared = sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        span = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(2)):
                n = end - first
                w = split_words(data, offsets)
                names = own.languages if own else [UNKNOWN]
                path = np.zeros(len(w.start), np.int16)
                if own and len(w.start):
                    path = own.paths(own.word_scores(w), w.bounds)
                text = np.repeat(np.arange(n), np.diff(w.bounds))
                mass = np.bincount(text * len(names) + path, weights=w.letters, minlength=n * len(names)).reshape(n, len(names))
                best, whole = mass.argmax(axis=1), mass.sum(axis=1)
                known = (whole > 0) & (own is not None)
                opens = np.ones(len(path), bool)
                opens[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(opens) if own else np.zeros(0, np.int64)
                last = np.append(at[1:], len(path))[: len(at)] - 1
                spans = pa.StructArray.from_arrays(
                    [pa.array(w.first[at].astype(np.int32)), pa.array(w.end[last].astype(np.int32)), pa.array([names[k] for k in path[at]], pa.string())],
                    fields=list(span),
                )
                heads = np.searchsorted(at, w.bounds).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n).cast(pa.int64()),
                        batch.column(1).slice(first, n),
                        pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, known)], pa.string()),
                        pa.array(np.where(known, mass.max(axis=1) / np.maximum(whole, 1), 0.0)),
                        pa.array(np.diff(w.bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(heads), spans),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "n_words", "spans"],
                )

    return docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from documents with a language whose crc32 remainder by 3 is not 1, label all documents.

    Documents without a language or an id are labelled too. Repeated rows get equal labels. An empty table gives
    no rows. Other columns are not read.
    """
    return label(docs, train(docs.filter(remainder(F.col("doc_id"), 3) != 1)))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
