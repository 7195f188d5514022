"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 fingerprint bits is given a nonzero vector of RADIUS + 1 bits; table v, of 2**(RADIUS + 1) - 1, keeps the
bits whose vector has an odd product with v. Whatever RADIUS bits two fingerprints differ in, some v is orthogonal to
all of their vectors, so the two agree on all that table v keeps: no pair within the radius is missed, by construction.

A table that keeps half of the bits still puts many different fingerprints of one large family into one bucket. Such a
bucket is not paired: its fingerprints are dealt again by the same scheme over the bits they do not yet share, which
again covers every pair within the radius, and so on. After three rounds eight bits at most are open, so a bucket holds at most 256 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import documents, lowered, stored, text_slices, word_ranges
from vitalframe.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
#: Buckets of up to so many fingerprints are paired; larger ones are dealt again.
PAIRED = 48
#: A fingerprint that more than one row in so many has is joined by broadcast; at most as many can exist.
SHARE = 2000


def fingerprint_batch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the texts of a slice."""
    start, end, bounds = word_ranges(data, offsets)
    size = end - start + 1
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    at[ends - 1] = len(data)
    plain = np.append(lowered(data), np.uint8(32))[at].tobytes()  # words with one blank behind each
    n = np.diff(bounds)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    heads = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bounds[:-1] - heads[:-1], count) + np.arange(heads[-1])
    last = np.minimum(first + SHINGLE, np.repeat(bounds[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    cut = zip((ends - size)[first].tolist(), (ends[last] - 1).tolist())
    hashes = np.fromiter((digest(plain[a:b], SEED) for a, b in cut), np.uint64, len(first))
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        for k in range(BITS):
            bit = ((hashes >> np.uint64(k)) & np.uint64(1)).astype(np.int64)
            held = np.add.reduceat(bit, heads[:-1][full])
            out[full] |= (2 * held > count[full]).astype(np.uint64) << np.uint64(k)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the 64-bit SimHash of the text's word triples, repeats counted, as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in text_slices(batch.column(1)):
                values = pa.array(fingerprint_batch(data, offsets).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), values], ["doc_id", "fingerprint"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def covering_masks(kept: int, radius: int = RADIUS) -> list[int]:
    """Masks over the bits that are not in ``kept``, one for each nonzero v, each united with ``kept``."""
    free = [k for k in range(BITS) if not kept >> k & 1]
    tables = (1 << radius + 1) - 1
    # the free bits take the nonzero vectors in turn, so every table keeps about half of them
    vector = {k: 1 + i % tables for i, k in enumerate(free)}
    return [kept | sum(1 << k for k in free if (vector[k] & v).bit_count() % 2) for v in range(1, tables + 1)]


def mask_tree(radius: int, rounds: int) -> list[list[tuple[int, int, int]]]:
    """By round, rows (path of the round before, path, mask): of fixed size, 15, 225 and 3375 for radius 3."""
    before, out = [(0, 0)], []
    for _ in range(rounds):
        rows = [(path, path << radius + 1 | v, mask) for path, kept in before for v, mask in enumerate(covering_masks(kept, radius), 1)]
        out.append(rows)
        before = [(path, mask) for _, path, mask in rows]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(values: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct ``fingerprint`` values within ``radius`` that share a bucket of at most ``paired``
    of some round, which is all pairs within the radius. A pair may come more than once."""
    spark = values.sparkSession
    left = values.select("fingerprint", F.lit(0).cast("long").alias("path"))
    links = []
    rounds = mask_tree(radius, 3)
    for depth, rows in enumerate(rounds):
        masks = spark.createDataFrame([(a, b, _signed(m)) for a, b, m in rows], "path long, next long, mask long")
        # a broadcast of fixed size
        keyed = left.join(F.broadcast(masks), "path").select(
            "fingerprint", F.col("next").alias("path"), F.expr("fingerprint & mask").alias("key")
        )
        sizes = keyed.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1")
        last = depth == len(rounds) - 1
        shared = stored(keyed.join(sizes, ["path", "key"]), "buckets")
        small = shared if last else shared.filter(F.col("n") <= paired)
        groups = small.groupBy("path", "key").agg(F.array_sort(F.collect_list("fingerprint")).alias("own"))
        near = F.expr(
            "transform(own, (a, i) -> transform(filter(slice(own, i + 2, size(own)), b -> bit_count(a ^ b) <= " + str(radius) + "), b -> struct(a as u, b as v)))"
        )
        links.append(stored(groups.select(F.explode(F.flatten(near)).alias("p")).select("p.u", "p.v").distinct(), "close"))
        if last:
            break
        # one fingerprint may be in several crowded buckets; their bits differ, so each is dealt anew
        left = shared.filter(F.col("n") > paired).select("fingerprint", "path")
        if left.isEmpty():
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id reachable over fingerprints within ``radius`` bits.

    A text without words (null, empty, blank) has fingerprint zero and is linked like any other. Rows without an id have a
    fingerprint and link others, but give no component its number: a component of such rows alone has a null component_id.
    Repeated rows share a fingerprint. Texts may be of any length. An empty table gives no rows; other columns are not read.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    kinds = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "kinds")
    merged = components(close_pairs(kinds.select("fingerprint"), radius))
    named = kinds.join(merged.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(first, "component").select("fingerprint", "n", "component_id"), "named")
    # fingerprints that many rows share would meet in one task: there are at most SHARE of them, which travel to the rows
    frequent = named.filter(F.col("n") * SHARE > rows.count()).select("fingerprint", "component_id", F.lit(True).alias("found"))
    first = stored(rows.join(F.broadcast(frequent), "fingerprint", "left"), "frequent")
    rest = first.filter("found is null").drop("component_id", "found").join(named.select("fingerprint", "component_id"), "fingerprint")
    return first.filter("found").drop("found").unionByName(rest).select("doc_id", "fingerprint", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_fingerprints(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
