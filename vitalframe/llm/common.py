"""Helpers that the corpus operators share: words, hashes, text slices and tables in the shared folder."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 20
LONG_WORD = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of words with A-Z lower-cased; empty for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.filter(parts, lambda w: w != "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. A local session that names none gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_small(large: DataFrame, small: DataFrame, on: list[str], rows: int, limit: int = 100_000) -> DataFrame:
    """Join with a table of ``rows`` rows: broadcast while it has at most ``limit`` rows, else by shuffle."""
    return large.join(F.broadcast(small) if rows <= limit else small, on)


def only(large: DataFrame, ids: DataFrame, key: str, limit: int = 500_000) -> DataFrame:
    """Rows of ``large`` whose key is in the stored, distinct ``ids``: broadcast while these are at most ``limit``
    numbers (some 10 MB), else by shuffle."""
    return large.join(F.broadcast(ids) if ids.count() <= limit else ids, key, "left_semi")


def sent(spark: SparkSession, value: object, boxes: list | None = None) -> Callable[[], object]:
    """Broadcast a value of bounded size with the code of its class, so executors need not have this package.

    The driver keeps a file of it until the session ends, unless the broadcast, added to ``boxes``, is destroyed.
    """
    box = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    if boxes is not None:
        boxes.append(box)
    return lambda: pickle.loads(box.value)


# --- numpy helpers for Arrow batches -------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, given ``prefix_sums`` of the bytes."""
    down = _powers(len(sums))[1]
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up = _powers(len(data) + 1)[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words given by their byte ranges. Polynomials modulo 2**64 collide on some long regular strings (such as
    Thue-Morse words), so words of over ``LONG_WORD`` bytes are hashed with XXH64."""
    out = range_hashes(prefix_sums(data), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null is empty."""
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.ones(256, bool)
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = _MARK[128:] = False


def word_ranges(data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): byte ranges of all words, and where each text's words begin among them.

    Words are runs between ASCII blanks; with ``letters``, runs of letters, digits and non-ASCII bytes.
    """
    inside = ~(_MARK if letters else _SPACE)[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | fresh[:-1]))
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of each text and their bounds; a shorter text is one n-gram of all its words."""
    n = np.diff(bounds)
    grams = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        part = hashes[k:]
        grams[: len(part)] = grams[: len(part)] * _BASE + part
        grams[len(part) :] = grams[len(part) :] * _BASE
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    at = np.repeat(bounds[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    result = mixed(grams[at])
    for i in np.flatnonzero((n > 0) & (n < size)):
        value = np.uint64(n[i])
        for h in hashes[bounds[i] : bounds[i + 1]]:
            value = np.uint64((int(value) * int(_BASE) + int(h)) & 0xFFFFFFFFFFFFFFFF)
        result[out[i]] = mixed(np.array([value], np.uint64) ^ np.uint64(0x5BF03635))[0]
    return result, out
