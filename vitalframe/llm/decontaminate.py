"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A benchmark item of n words is compared with windows of n words. Both are weighted sets of five-word shingles,
the weight being the bytes of the shingle's words and of one blank between them. Their 64-bit SimHash values are compared through four 16-bit blocks: two
values at most RADIUS bits apart agree in some block up to RADIUS // 4 bits, so a table of all block values that
near gives every fingerprint within the radius. Candidates within the radius are verified on the sets: weighted
Jaccard similarity of 0.75 or more. Windows that share no shingle with any item cannot reach that and are not
fingerprinted. An item or text of under five words is one shingle, its whole sequence, so it matches its equals only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import documents, lowered, sent, shingle_hashes, stored, text_slices, word_hashes, word_ranges

SHINGLE = 5
RADIUS = 23
BLOCKS = 4
BLOCK_BITS = 16
NUMERATOR, DENOMINATOR = 75, 100
#: Items per index. A larger benchmark is searched in blocks of about so many, each against all documents.
ITEMS_PER_INDEX = 500
FILTER_BITS = 20
#: Places of windows that are fingerprinted at a time, so a very long text needs no more memory than another.
WINDOWS = 1 << 12

SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def weighted_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, their weights, bounds of the texts among them, words per text); none for texts without words."""
    data = lowered(data)
    start, end, bounds = word_ranges(data, offsets)
    n = np.diff(bounds)
    grams, spans = shingle_hashes(word_hashes(data, start, end), bounds, SHINGLE)
    count = np.diff(spans)
    at = np.arange(len(grams)) - np.repeat(spans[:-1], count) + np.repeat(bounds[:-1], count)
    held = np.repeat(np.minimum(n, SHINGLE), count)
    length = np.concatenate([[0], np.cumsum(end - start)])
    return grams, length[at + held] - length[at] + held - 1, spans, n


def fingerprints(grams: np.ndarray, weights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the shingle ranges [start, end)."""
    sums = np.zeros((len(grams) + 1, 64), np.int64)
    bits = ((grams[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    np.cumsum((2 * bits - 1) * weights[:, None], axis=0, out=sums[1:])
    up = (sums[end] - sums[start]) > 0
    return (up.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _masks() -> np.ndarray:
    """All 16-bit words with at most RADIUS // BLOCKS bits set."""
    out = [0]
    for k in range(1, RADIUS // BLOCKS + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(BLOCK_BITS), k)]
    return np.array(out, np.uint16)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


@dataclass
class Index:
    """Items of one block of the benchmark and the tables to find them."""

    ids: list[int]
    sizes: np.ndarray  # words
    sets: list[tuple[np.ndarray, np.ndarray]]  # sorted shingles and weights
    prints: np.ndarray = field(init=False)
    heads: list[np.ndarray] = field(init=False)  # per block: begin of each value's items
    near: list[np.ndarray] = field(init=False)  # per block: items by block value
    known: np.ndarray = field(init=False)  # all shingles, sorted
    owners: dict = field(init=False)  # shingle -> sizes of the items that have it

    def __post_init__(self):
        self.prints = np.array([fingerprints(g, w, np.array([0]), np.array([len(g)]))[0] for g, w in self.sets], np.uint64)
        masks = _masks()
        self.heads, self.near = [], []
        for block in range(BLOCKS):
            value = (self.prints >> np.uint64(block * BLOCK_BITS)).astype(np.uint16)
            around = (value[:, None] ^ masks[None, :]).reshape(-1)
            item = np.repeat(np.arange(len(value), dtype=np.int16 if len(value) < 1 << 15 else np.int32), len(masks))
            order = np.argsort(around, kind="stable")
            self.near.append(item[order])
            self.heads.append(np.searchsorted(around[order], np.arange((1 << BLOCK_BITS) + 1)))
        self.known = np.unique(np.concatenate([g for g, _ in self.sets]))
        self.owners = {}
        for (grams, _), size in zip(self.sets, self.sizes):
            for g in grams.tolist():
                self.owners.setdefault(g, set()).add(int(size))

    def within(self, value: int, size: int) -> np.ndarray:
        """Items of that size whose fingerprint is at most RADIUS bits from ``value``."""
        found = []
        for block in range(BLOCKS):
            part = (value >> (block * BLOCK_BITS)) & 0xFFFF
            found.append(self.near[block][self.heads[block][part] : self.heads[block][part + 1]])
        items = np.unique(np.concatenate(found))
        items = items[self.sizes[items] == size]
        return items[_popcount(self.prints[items] ^ np.uint64(value)) <= RADIUS]

    def similarity(self, item: int, grams: np.ndarray, weights: np.ndarray) -> float:
        mine, mass = self.sets[item]
        grams, first = np.unique(grams, return_index=True)
        own = weights[first]
        shared = np.isin(mine, grams, assume_unique=True)
        both = mass[shared].sum()
        return float(both / (mass.sum() + own.sum() - both))

    def matches(self, grams: np.ndarray, weights: np.ndarray, words: int, hits: np.ndarray) -> dict:
        """item -> (similarity, first word, words) of the best window of a text, given where it has known shingles."""
        best: dict = {}
        sizes = set().union(*(self.owners[g] for g in grams[hits].tolist()))
        for size in sorted(sizes):
            span = max(min(size, words) - SHINGLE + 1, 1)  # shingles of a window
            last = len(grams) - span
            open_at = np.zeros(len(grams) + 1, np.int64)
            np.add.at(open_at, np.maximum(hits - span + 1, 0), 1)
            np.add.at(open_at, np.minimum(hits, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(open_at)[: last + 1] > 0)
            if not len(starts):
                continue
            for some in np.split(starts, np.flatnonzero(np.diff(starts // WINDOWS)) + 1):
                low = some[0]
                part = slice(low, some[-1] + span)
                values = fingerprints(grams[part], weights[part], some - low, some - low + span)
                for at, value in zip(some.tolist(), values.tolist()):
                    for item in self.within(value, size).tolist():
                        s = self.similarity(item, grams[at : at + span], weights[at : at + span])
                        if s * DENOMINATOR >= NUMERATOR and s > best.get(item, (0,))[0]:
                            best[item] = (s, at, min(size, words))
        return best


def build_index(rows: list) -> Index | None:
    """Index of (item_id, text) rows; None if no item has words."""
    ids, sizes, sets = [], [], []
    for item_id, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        grams, weights, _, n = weighted_grams(data, np.array([0, len(data)]))
        if item_id is not None and len(grams):
            grams, first = np.unique(grams, return_index=True)
            ids.append(item_id)
            sizes.append(int(n[0]))
            sets.append((grams, weights[first]))
    return Index(ids, np.array(sizes), sets) if ids else None


def _search(docs: DataFrame, index: Index) -> DataFrame:
    shared = sent(docs.sparkSession, index)  # ITEMS_PER_INDEX bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        mask = np.uint64((1 << FILTER_BITS) - 1)
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[(own.known & mask).astype(np.int64)] = True
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            out: list = []
            for first, _, data, offsets in text_slices(batch.column(1)):
                grams, weights, bounds, n = weighted_grams(data, offsets)
                hits = np.flatnonzero(maybe[(grams & mask).astype(np.int64)])
                hits = hits[np.isin(grams[hits], own.known)]
                text = np.searchsorted(bounds, hits, "right") - 1
                for t in np.unique(text).tolist():
                    a, b = bounds[t], bounds[t + 1]
                    found = own.matches(grams[a:b], weights[a:b], int(n[t]), hits[text == t] - a)
                    out += [(ids[first + t].as_py(), own.ids[i], *v) for i, v in sorted(found.items())]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                    ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the most similar window, the first of equals, of each
    leaked item in each document.

    Null and blank texts on either side match nothing, nor do items without an id; texts shorter
    than an item are one window, those of under five words match items of the same words. At a similarity just above the threshold
    RADIUS misses a window in some thousands. Repeated documents and repeated items are reported each. A benchmark of any size
    is searched in blocks; an empty one, or an empty table, gives no rows. Other columns are not read.
    """
    items = benchmark.select("item_id", "text")
    parts = -(-items.count() // ITEMS_PER_INDEX)
    out = None
    for part in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        index = build_index([(r["item_id"], r["text"]) for r in mine.collect()])
        if index is not None:
            found = _search(docs, index)
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, in which no benchmark item was found; those without an id stay."""
    hit = stored(leaks(docs, benchmark).filter("doc_id is not null").select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    small = hit.count() <= 500_000
    return docs.join(F.broadcast(hit) if small else hit, docs["doc_id"] == hit["_leak"], "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
