"""Substring dedup by hashing units: lines, broken further at sentence ends and at places their words define.

A unit ends behind a run of line breaks or of sentence ends. A sentence of twice MIN_WORDS words or more is broken
further: before each word whose digest is the least among itself and REACH words on either side, so the breaks inside a
passage are the same wherever it stands and all units of a broken sentence have MIN_WORDS words. The units of a text lie end
to end and each has its place. Its normal form is its words (runs of non-blanks), A-Z lower-cased, with one space
between; two units are the same if the 128-bit digests of their normal forms are. The first unit of each digest in the
order (doc_id, place) is kept. A unit of under MIN_WORDS words and MIN_BYTES bytes is too short to tell: it is the same as
another only if the units before both are the same too, and together they have MIN_WORDS words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import LOWER, UPPER, documents, lowered, mixed, stored, text_slices, word_hashes, word_ranges

MIN_WORDS = 6
#: Bytes of words that make a unit long enough without MIN_WORDS words, for scripts without blanks.
MIN_BYTES = 48
REACH = MIN_WORDS - 1
# Characters that end a unit.
ENDS = ".!?\n"
WIDE_ENDS = "。！？"

_END = np.zeros(256, bool)
_END[[ord(c) for c in ENDS]] = True
_FILED = "doc_id long, h1 array<long>, h2 array<long>, first array<int>, end array<int>"


def _endings(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a character that ends a unit."""
    ending = _END[data]
    for mark in WIDE_ENDS:
        a, b, c = mark.encode()
        at = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c))
        for k in range(3):
            ending[at + k] = True
    return ending


def _breaks(low: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First bytes of the words that begin a unit inside a sentence; ``bounds`` are those of sentences among words."""
    count = np.diff(bounds)
    size = np.repeat(count, count)
    place = np.arange(len(start)) - np.repeat(bounds[:-1], count)
    wide = np.flatnonzero(size >= 2 * MIN_WORDS)
    _, one, which = np.unique(hashes[wide], return_index=True, return_inverse=True)
    raw = low.tobytes()
    digest = [hashlib.md5(raw[a:b], usedforsecurity=False).digest()[:8] for a, b in zip(start[wide[one]].tolist(), stop[wide[one]].tolist())]
    key = np.zeros(len(start), np.uint64)
    key[wide] = np.frombuffer(b"".join(digest), ">u8").astype(np.uint64)[which]
    least = (place >= MIN_WORDS) & (size - place >= MIN_WORDS)
    for k in range(1, REACH + 1):  # of equal words the first begins the unit
        least[k:] &= key[k:] < key[:-k]
        least[:-k] &= key[:-k] <= key[k:]
    return start[least]


def units_of(data: np.ndarray, offsets: np.ndarray):
    """(text, first byte, end byte, whether it can be told, digest halves) of every unit of a slice of texts."""
    ending = _endings(data)
    head = np.zeros(len(data), bool)
    head[1:] = ending[:-1] & ~ending[1:]
    size = np.diff(offsets)
    head[offsets[:-1][size > 0]] = True
    first = np.flatnonzero(head)
    low = lowered(data)
    start, stop, bounds = word_ranges(low, np.append(first, len(data)))
    hashes = word_hashes(low, start, stop)
    first = np.sort(np.concatenate([first, _breaks(low, start, stop, hashes, bounds)]))
    end = np.append(first[1:], len(data))
    text = np.searchsorted(offsets, first, "right") - 1
    bounds = np.searchsorted(start, np.append(first, len(data)))
    count = np.diff(bounds)
    length = np.concatenate([[0], np.cumsum(stop - start)])[bounds]
    enough = (count >= MIN_WORDS) | (np.diff(length) >= MIN_BYTES)
    behind = np.zeros(len(first), bool)
    behind[1:] = (text[1:] == text[:-1]) & ~enough[1:] & (count[1:] > 0) & (count[1:] + count[:-1] >= MIN_WORDS)
    after = np.flatnonzero(behind)
    # a digest is a sum over the words, each mixed with its place
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], count)
    halves = []
    for k in (1, 2):
        turned = mixed(hashes * np.uint64(2 * k + 1) + mixed(place.astype(np.uint64) + np.uint64(k << 40)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turned, dtype=np.uint64)])
        half = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + count.astype(np.uint64))
        half[after] = mixed(half[after] + mixed(half[after - 1] ^ np.uint64(k << 56)))
        halves.append(half)
    return text, first, end, enough | behind, halves


def filed(docs: DataFrame) -> DataFrame:
    """One row per text: digests and character ranges of its units that can be told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in text_slices(batch.column(1)):
                text, first, end, told, halves = units_of(data, offsets)
                keep = np.flatnonzero(told)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = chars[offsets[text[keep]]]
                heads = pa.array(np.searchsorted(text[keep], np.arange(stop - row + 1)).astype(np.int32))
                lists = [
                    *(h[keep].view(np.int64) for h in halves),
                    (chars[first[keep]] - base).astype(np.int32),
                    (chars[end[keep]] - base).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row).cast(pa.int64())] + [pa.ListArray.from_arrays(heads, pa.array(x)) for x in lists],
                    ["doc_id", "h1", "h2", "first", "end"],
                )

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, _FILED)


def repeated_units(docs: DataFrame) -> DataFrame:
    """(doc_id, first, end, kept_doc_id, kept_first) of every unit to remove, in characters of the original text.

    Null and empty texts have no units; documents without an id keep theirs and remove none elsewhere. Rows that
    repeat an id are one document: equal units at equal places are one, so such rows stay whole. Texts may be of any
    length. An empty table gives no rows. Other columns are not read.
    """
    files = stored(filed(docs), "units")
    units = files.select("doc_id", F.explode(F.arrays_zip("h1", "h2", "first", "end")).alias("u")).select("doc_id", "u.*")
    # copies of a unit are combined before they meet
    kept = units.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "first")).alias("least"), F.max(F.struct("doc_id", "first")).alias("most")
    )
    kept = kept.filter("least <> most").select("h1", "h2", F.col("least.doc_id").alias("kept_doc_id"), F.col("least.first").alias("kept_first"))
    rows = units.join(kept, ["h1", "h2"]).filter("doc_id <> kept_doc_id or first <> kept_first")
    return rows.select("doc_id", "first", "end", "kept_doc_id", "kept_first").distinct()


def drop_units(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without repeated units; a text of which nothing is left is empty."""
    gone = repeated_units(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("_gone"))
    ends = F.concat(F.array(F.lit(0)), F.col("_gone.end"))
    starts = F.concat(F.col("_gone.first"), F.array(F.length("text")))
    parts = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left").withColumn("text", text).select(*docs.columns)


def op4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(documents(spark, sf_dir))


_ENDS = r".!?\n" + WIDE_ENDS
_NEAR = "OVER (PARTITION BY r, k ORDER BY j ROWS BETWEEN"

OP4_SQL = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^{_ENDS}]+[{_ENDS}]*|[{_ENDS}]+') AS s
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
sentence AS (
  SELECT r, doc_id, k, regexp_extract_all(sentence, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+') AS p
  FROM (SELECT r, doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS k FROM cut)),
piece AS (
  SELECT r, doc_id, k, j, piece, translate(regexp_extract(piece, '^[^\x20\x09-\x0D]+'), '{UPPER}', '{LOWER}') AS x
  FROM (SELECT r, doc_id, k, unnest(p) AS piece, generate_subscripts(p, 1) AS j FROM sentence)),
word AS (
  SELECT *, substr(md5(x), 1, 16) AS h, count(*) FILTER (x <> '') OVER (PARTITION BY r, k ORDER BY j) - 1 AS i,
    count(*) FILTER (x <> '') OVER (PARTITION BY r, k) AS m FROM piece),
headed AS (
  SELECT *, (j = 1 OR (i >= {MIN_WORDS} AND m - i >= {MIN_WORDS} AND h < min(h) {_NEAR} {REACH} PRECEDING AND 1 PRECEDING)
    AND h <= min(h) {_NEAR} 1 FOLLOWING AND {REACH} FOLLOWING)))::INT AS head FROM word),
numbered AS (
  SELECT *, sum(head) OVER (PARTITION BY r ORDER BY k, j) AS u, sum(length(piece)) OVER (PARTITION BY r ORDER BY k, j) AS upto FROM headed),
unit AS (
  SELECT r, doc_id, u, min(upto - length(piece))::INT AS first, max(upto)::INT AS "end",
    coalesce(list(x ORDER BY k, j) FILTER (x <> ''), []::VARCHAR[]) AS w
  FROM numbered GROUP BY r, doc_id, u),
followed AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY u) AS p FROM unit),
told AS (
  SELECT doc_id, first, "end", CASE
    WHEN len(w) >= {MIN_WORDS} OR strlen(array_to_string(w, '')) >= {MIN_BYTES} THEN w
    WHEN len(w) > 0 AND len(w) + len(p) >= {MIN_WORDS} THEN w || [''] || p END AS t FROM followed),
kept AS (SELECT t, min({{'d': doc_id, 'f': first}}) AS k FROM told WHERE t IS NOT NULL GROUP BY t)
SELECT DISTINCT n.doc_id, n.first, n."end", k.k.d AS kept_doc_id, k.k.f AS kept_first
FROM told n JOIN kept k USING (t) WHERE n.doc_id <> k.k.d OR n.first <> k.k.f
"""
