"""Periodic runs of words by seed and extend along diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no neighbouring word
extends. Words q apart agree on at least max(5, 3 q) places in a row, so for the periods of one octave, 2**j to
2**(j+1) - 1, every run holds whole pairs of k-grams, k = 3 * 2**j (5 for period 1). Grams of k words are indexed octave
by octave; a gram at least one period long returns inside its run after exactly q words, so the pairs of one
occurrence with the next are all that is needed: one pair a word and octave, however often a gram occurs. Pairs on one
diagonal (one lag) are extended to both sides; a table of the furthest place covered at each lag keeps later pairs of
the same stretch from being extended again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import documents, text_slices, word_ranges

LEAST_WORDS = 6
LEAST_PERIODS = 4
RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    joined = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return np.asarray(words.dictionary_encode().indices, np.int64)


def repeated(key: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Rank of the key at each place; -1 where there is none or it occurs once."""
    out = np.full(n, -1, np.int64)
    _, rank, count = np.unique(key, return_inverse=True, return_counts=True)
    more = count[rank] > 1
    out[place[more]] = rank[more]
    return out


def longer(first: np.ndarray, second: np.ndarray, shift: int, text: np.ndarray) -> np.ndarray:
    """Ranks of the grams that are ``first`` here and ``second`` ``shift`` words on, in one text and more than once."""
    n = len(first)
    if shift >= n:
        return np.full(n, -1, np.int64)
    place = np.flatnonzero((first[:-shift] >= 0) & (second[shift:] >= 0) & (text[:-shift] == text[shift:]))
    return repeated(first[place] * (second.max(initial=0) + 1) + second[place + shift], place, n)


def next_occurrences(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag to the next place) of equal grams."""
    place = np.flatnonzero(grams >= 0)
    place = place[np.argsort(grams[place], kind="stable")]
    lag = np.diff(place)
    same = grams[place[1:]] == grams[place[:-1]]
    return place[:-1][same], lag[same]


def agreeing(codes: np.ndarray, at: int, lag: int, bound: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step`` and up to ``bound``, equal the word ``lag`` later."""
    found, block = 0, 64
    while True:
        size = min(block, (bound - at) * step - found)
        if size <= 0:
            return found
        x = at + step * (found + np.arange(size))
        differ = np.flatnonzero(codes[x] != codes[x + lag])
        if len(differ):
            return found + int(differ[0])
        found += size
        block *= 2


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of all texts, by start and period; a start counts from the first word of all."""
    n = len(codes)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    longest = int(np.diff(bounds).max(initial=0))
    one = repeated(text * (codes.max(initial=0) + 1) + codes, np.arange(n), n)
    two = longer(one, one, 1, text)
    three = longer(two, one, 2, text)
    found, low, size, grams = [], 1, 5, longer(three, two, 3, text)
    while LEAST_PERIODS * low <= longest and (grams >= 0).any():
        place, lag = next_occurrences(grams)
        held = (lag >= low) & (lag < 2 * low)
        place, lag = place[held], lag[held]
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # occurrence pairs that touch on a diagonal are one seed
        head = np.ones(len(place), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + size)
        tail = np.append(head[1:], True)[: len(place)]
        covered: dict[int, int] = {}
        for q, first, end in zip(lag[head].tolist(), place[head].tolist(), (place[tail] + size).tolist()):
            if first < covered.get(q, 0):
                continue
            own = int(text[first])
            end += agreeing(codes, end, q, int(bounds[own + 1]) - q, 1)
            first -= agreeing(codes, first - 1, q, int(bounds[own]) - 1, -1)
            covered[q] = end
            if end - first + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((first, end - first + q, q))
        if low == 1:
            low, size, grams = 2, 6, longer(three, three, 3, text)
        else:
            low, size, grams = 2 * low, 2 * size, longer(grams, grams, size, text)
    runs = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 1], runs[:, 2]


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the words of each text with one blank between."""
    size = end - start + 1
    last = heads[1:][np.diff(heads) > 0] - 1
    size[last] -= 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    blank = np.ones(len(size), bool)
    blank[last] = False
    at[offsets[1:][blank] - 1] = len(data)
    return np.append(data, np.uint8(32))[at], offsets[heads]


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their runs (word number, words, period; by start, then period) and the collapsed text.

    Words are runs of characters other than ASCII blanks, compared byte by byte. The collapsed text is the words with one
    blank between, without those that a run holds after its first period. Null, empty and blank texts have no runs and
    collapse to the empty text; texts may be of any length. Ids are not read: rows that repeat or lack one are
    treated one by one. Other columns stay; columns named ``runs`` or ``collapsed`` are replaced. An empty table gives no rows.
    """
    docs = docs.drop("runs", "collapsed")
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [RUNS])
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in text_slices(batch.column(at)):
                first, last, bounds = word_ranges(data, offsets)
                start, length, period = runs_of(word_codes(data, first, last), bounds)
                own = np.searchsorted(bounds, start, "right") - 1
                # words of a run behind its first period go
                change = np.zeros(len(first) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                heads = np.concatenate([[0], np.cumsum(keep)])[bounds]
                rest, ends = joined_words(data, first[keep], last[keep], heads)
                items = pa.StructArray.from_arrays([pa.array(x) for x in (start - bounds[own], length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(stop - row + 1)).astype(np.int32)), items)
                collapsed = pa.LargeStringArray.from_buffers(stop - row, pa.py_buffer(ends), pa.py_buffer(rest))
                columns = [*batch.slice(row, stop - row).columns, lists, collapsed.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document, by the checksum of its id, goes on periodically from some word. A document
    without an id stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            chosen = [None if i is None else zlib.crc32(str(i).encode()) for i in ids]
            changed = {}
            for k, h in enumerate(chosen):
                if h is None or h % 10 or not column[k].is_valid:
                    continue
                words = column[k].as_py().encode().split()
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words[a:] = (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
                    changed[k] = b" ".join(words).decode()
            if changed:
                column = pa.array([changed[k] if k in changed else column[k].as_py() for k in range(len(ids))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "text"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all runs of every document, its run of the greatest exponent and a digest of the collapsed text."""
    found = periodic_runs(with_repeats(documents(spark, sf_dir)))
    # of two runs the one with the greater length / period comes first, then the smaller start, then the smaller period
    best = F.reduce(
        "runs",
        F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
