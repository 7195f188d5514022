"""Suffix-array dedup: bytes in strings of SPAN bytes that also start elsewhere, found by suffix sorting in shards.

A shard must hold everything that may be equal to what it holds. So every SPAN-byte window is filed under its anchor,
the GRAM-byte string in it with the least hash (the first of equals): equal windows have equal anchors at equal
places. Neighbouring windows of one anchor form a piece. Anchors that occur once cannot hold a repeat. Pieces that
occur twice as a whole are repeats without further work. What is left, pieces that agree only in part, is sorted:
all pieces of an anchor go to one shard. Windows whose surroundings stand in one piece alone drop out there, and an anchor
becomes one symbol. The suffix array of the rest, with common prefixes, is built by induction on disk-backed
queues (``induced``). A window is a repeat if its suffix shares all SPAN bytes with a neighbour in order.

An anchor of very many different pieces is split before: the windows at a range of places relative to the anchor
have a common core and are filed anew under it, in narrower ranges until the group is small or a range is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import documents, mixed, only, prefix_sums, range_hashes, stored, text_slices
from vitalframe.llm.induced import CAP, _ranges, suffix_array

SPAN = CAP
GRAM = 80
#: An anchor with more different pieces is split by ranges of so many windows.
CROWD = 512
RANGES = (16, 4, 1)
SHARD_BYTES = 1_000_000
#: Windows of a range whose common bytes are looked for in other pieces before a shard is sorted.
CORE = 8

_FILED = "uid long, n_bytes long, lo array<int>, anchor array<long>, at array<int>, piece array<long>"


def _uid():
    """Equal rows share it: what is found for one holds for the other."""
    return F.xxhash64("doc_id", "text").alias("uid")


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Pieces of a slice of texts: (text, first window, windows, anchor position, anchor hash, hash of the piece)."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_sums(data)
    start = np.arange(len(data) - GRAM + 1)
    hashes = range_hashes(sums, start, start + GRAM)
    bits = np.uint64(len(data).bit_length())
    value = ((hashes >> bits) << bits) | start.astype(np.uint64)  # the first of equal hashes is the least
    width = SPAN - GRAM + 1
    windows = len(value) - width + 1
    full = np.full(-(-len(value) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(value)] = value
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.diff(offsets)
    whole = np.flatnonzero(size >= SPAN)
    first = _ranges(offsets[:-1][whole], size[whole] - SPAN + 1)  # windows inside their text
    text = np.repeat(whole, size[whole] - SPAN + 1)
    of = anchor[first]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(first)))
    low = first[head]
    return text[head], low, count, of[head], hashes[of[head]], range_hashes(sums, low, low + count + SPAN - 1)


def filed(docs: DataFrame) -> DataFrame:
    """One row per text: its pieces by first window, with the anchor's hash and place in the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                text, low, _, at, anchor, piece = anchors(data, offsets)
                heads = pa.array(np.searchsorted(text, np.arange(end - first + 1)).astype(np.int32))
                lists = [
                    (low - offsets[text]).astype(np.int32),
                    anchor.view(np.int64),
                    (at - low).astype(np.int32),
                    piece.view(np.int64),
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(offsets))] + [pa.ListArray.from_arrays(heads, pa.array(x)) for x in lists],
                    ["uid", "n_bytes", "lo", "anchor", "at", "piece"],
                )

    return docs.select(_uid(), "text").mapInArrow(run, _FILED)


def _pieces(files: DataFrame) -> DataFrame:
    """(uid, lo, n, at, anchor, piece): n windows from byte lo on; the anchor begins at byte at of the piece."""
    rows = files.select("uid", "n_bytes", F.explode(F.arrays_zip("lo", "anchor", "at", "piece", F.slice("lo", 2, 1 << 30).alias("next"))).alias("p"))
    following = F.coalesce("p.next", (F.col("n_bytes") - SPAN + 1).cast("int"))
    return rows.select("uid", F.col("p.lo").alias("lo"), (following - F.col("p.lo")).alias("n"), F.col("p.at").alias("at"), F.col("p.anchor").alias("anchor"), F.col("p.piece").alias("piece"))


def _with_bytes(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, uid, lo, n, at, live, data) of pieces (key, uid, lo, n, at, live)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                lists = [batch.column(k).slice(first, end - first) for k in range(2, 7)]
                count = np.diff(lists[0].offsets.to_numpy())
                key, lo, n, at, live = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
                text = np.repeat(np.arange(end - first), count)
                size = n.astype(np.int64) + SPAN - 1
                cut = data[_ranges(offsets[text] + lo, size)] if len(lo) else data[:0]
                where = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                strings = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(cut))])
                uid = batch.column(0).slice(first, end - first).to_numpy()[text]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key, uid, lo, n, at, live)), strings], ["key", "uid", "lo", "n", "at", "live", "data"])

    by_text = pieces.groupBy("uid").agg(F.collect_list(F.struct("key", "lo", "n", "at", "live")).alias("p"))
    wanted = stored(by_text, "wanted-pieces")
    texts = only(docs.select(_uid(), "text").filter("text is not null"), wanted.select("uid"), "uid").dropDuplicates(["uid"])
    rows = texts.join(wanted, "uid").select("uid", "text", "p.key", "p.lo", "p.n", "p.at", "p.live")
    return rows.mapInArrow(run, "key long, uid long, lo int, n int, at int, live boolean, data binary")


def _split(rows: DataFrame, width: int) -> DataFrame:
    """The pieces cut into ranges of ``width`` windows by place, each filed under the hash of its common core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, uid, lo, n, at, live = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            where = np.frombuffer(batch.column(6).buffers()[1], np.int32)[batch.column(6).offset :][: batch.num_rows + 1].astype(np.int64)
            data = np.frombuffer(batch.column(6).buffers()[2], np.uint8)[where[0] : where[-1]]
            where = where - where[0]
            at = at.astype(np.int64)
            # windows lie at places at - (n - 1) .. at before the anchor; range j holds places [j, j + 1) * width
            low_j, high_j = np.maximum(at - n + 1, 0) // width, at // width
            count = high_j - low_j + 1
            row = np.repeat(np.arange(len(key)), count)
            j = _ranges(low_j, count)
            begin = np.maximum(at[row] - (j + 1) * width + 1, 0)
            stop = np.minimum(at[row] - j * width, n[row] - 1)
            core = at[row] - j * width
            sums = prefix_sums(data)
            base = where[row]
            new = mixed(range_hashes(sums, base + core, base + core - width + 1 + SPAN) + mixed(key[row].view(np.uint64) + j.astype(np.uint64)))
            size = stop - begin + SPAN
            cut = data[_ranges(base + begin, size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            strings = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(cut))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(new.view(np.int64)),
                    pa.array(uid[row]),
                    pa.array((lo[row] + begin).astype(np.int32)),
                    pa.array((stop - begin + 1).astype(np.int32)),
                    pa.array((at[row] - begin).astype(np.int32)),
                    pa.array(live[row]),
                    strings,
                ],
                ["key", "uid", "lo", "n", "at", "live", "data"],
            )

    return rows.mapInArrow(run, rows.schema)


def may_repeat(text: np.ndarray, base: np.ndarray, key: np.ndarray, n: np.ndarray, at: np.ndarray, live: np.ndarray):
    """(piece, first window, windows) of the runs that need sorting; piece i begins at byte ``base[i]`` of ``text``.

    Equal windows have their anchor at equal places, so they share the bytes that all windows of a range of CORE
    places have in common. Ranges whose common bytes stand in no other piece of the key, or in known ones only, drop out.
    """
    at, n = at.astype(np.int64), n.astype(np.int64)
    low_j, high_j = np.maximum(at - n + 1, 0) // CORE, at // CORE
    count = high_j - low_j + 1
    piece = np.repeat(np.arange(len(key)), count)
    j = np.repeat(high_j + low_j, count) - _ranges(low_j, count)  # falling places are rising windows
    core = base[piece] + at[piece] - j * CORE
    common = mixed(range_hashes(prefix_sums(text), core, core - CORE + 1 + SPAN) + mixed(key[piece].view(np.uint64) + j.astype(np.uint64)))
    _, kind = np.unique(common, return_inverse=True)
    kept = np.flatnonzero((np.bincount(kind)[kind] > 1) & (np.bincount(kind, live[piece])[kind] > 0)) if len(kind) else kind
    piece, j = piece[kept], j[kept]
    low, stop = np.maximum(at[piece] - (j + 1) * CORE + 1, 0), np.minimum(at[piece] - j * CORE + 1, n[piece])
    fresh = np.ones(len(piece), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (low[1:] != stop[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(piece))[: len(first)] - 1
    return piece[first], low[first], stop[last] - low[first]


def shard_line(text: np.ndarray, base: np.ndarray, at: np.ndarray, low: np.ndarray, n: np.ndarray):
    """(symbols, head of each run) of a shard: 0 ends it, 1 ends a run, bytes follow, and then the anchors.

    Every window of a run holds its whole anchor, so one symbol stands for it, the same for equal bytes: windows
    are equal if SPAN - GRAM + 1 symbols are.
    """
    raw, seen = text.tobytes(), {}
    name = np.array([seen.setdefault(raw[x : x + GRAM], len(seen)) for x in (base + at).tolist()], np.int32)
    size = n + SPAN - 1
    byte = _ranges(base + low, size)
    past = byte - np.repeat(base + at, size)
    symbols = text[byte].astype(np.int32) + 2
    symbols[past == 0] = name + 258
    symbols = symbols[(past <= 0) | (past >= GRAM)]
    length = n + SPAN - GRAM
    head = np.concatenate([[0], np.cumsum(length + 1)])
    line = np.ones(head[-1] + 1, np.int32)
    line[_ranges(head[:-1], length)] = symbols
    line[-1] = 0
    return line, head[:-1]


def _sorted_repeats(rows: DataFrame) -> DataFrame:
    """(uid, lo, n): runs of repeated windows among the pieces of each key, by suffix arrays of shards."""
    size = rows.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # about SHARD_BYTES: keys of at most CROWD pieces, dealt by hash
        key, uid, lo, n, at, live = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("key", "uid", "lo", "n", "at", "live"))
        strings = [s for p in parts for s in p.column("data").to_pylist()]
        text = np.frombuffer(b"".join(strings), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(s) for s in strings])])[:-1]
        piece, low, n = may_repeat(text, base, key, n, at, live)
        line, head = shard_line(text, base[piece], at[piece], low, n)
        uid, lo, live = uid[piece], lo[piece] + low, live[piece]
        order, shared = suffix_array(line)
        same = shared >= SPAN - GRAM + 1
        same[:-1] |= shared[1:] >= SPAN - GRAM + 1
        hit = np.zeros(len(line), bool)
        hit[order[same]] = True
        starts = _ranges(head, n)
        piece = np.repeat(np.arange(len(n)), n)
        found = hit[starts] & live[piece]
        starts, piece = starts[found], piece[found]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (starts[1:] != starts[:-1] + 1) | (piece[1:] != piece[:-1])
        at = np.flatnonzero(fresh)
        run_length = np.diff(np.append(at, len(starts)))
        of = piece[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid[of]), pa.array((lo[of] + starts[at] - head[of]).astype(np.int32)), pa.array(run_length.astype(np.int32))], ["uid", "lo", "n"]
        )

    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    return rows.select(shard.alias("shard"), "key", "uid", "lo", "n", "at", "live", "data").groupBy("shard").applyInArrow(run, "uid long, lo int, n int")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(uid, lo, n): the windows at bytes lo .. lo + n - 1 of the text also start elsewhere."""
    files = stored(filed(docs), "files")
    pieces = _pieces(files)
    crowd = pieces.groupBy("anchor").agg(F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    pieces = stored(pieces.join(crowd, "anchor"), "pieces")
    kinds = stored(
        pieces.groupBy("anchor", "piece").agg(F.count("*").alias("m"), F.min(F.struct("uid", "lo", "n", "at")).alias("rep")), "kinds"
    )
    spans = pieces.join(kinds.filter("m > 1").select("anchor", "piece"), ["anchor", "piece"]).select("uid", "lo", "n")

    # anchors of several pieces, one of them not yet known to repeat
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("m").alias("least")).filter("kinds > 1 and least = 1")
    part = kinds.join(sizes, "anchor").select(F.col("anchor").alias("key"), "rep.*", (F.col("m") == 1).alias("live"), "kinds")
    rows = stored(_with_bytes(docs, part), "piece-bytes")
    big = stored(sizes.filter(F.col("kinds") > CROWD).select(F.col("anchor").alias("key")), "crowded")
    small = [rows.join(big, "key", "left_anti")]
    rows = rows.join(big, "key")
    for width in RANGES:
        if not big.count():
            break
        rows = stored(_split(rows, width).withColumn("h", F.sha2("data", 256)), "ranges")
        own = rows.groupBy("key", "h").agg(
            F.count("*").alias("m"), F.max(F.when(~F.col("live"), 1).otherwise(0)).alias("known"), F.min(F.struct("uid", "lo", "n", "at", "data")).alias("rep")
        )
        own = stored(own, "range-kinds")
        again = own.filter("m > 1")
        spans = spans.unionByName(rows.filter("live").join(again.select("key", "h"), ["key", "h"]).select("uid", "lo", "n"))
        sizes = own.groupBy("key").agg(F.count("*").alias("kinds"), F.min(F.col("m") + F.col("known")).alias("least")).filter("kinds > 1 and least = 1")
        big = stored(sizes.filter(F.col("kinds") > CROWD).select("key"), "crowded")
        left = own.join(sizes.select("key"), "key").select("key", "rep.uid", "rep.lo", "rep.n", "rep.at", ((F.col("m") == 1) & (F.col("known") == 0)).alias("live"), "rep.data")
        small.append(left.join(big, "key", "left_anti"))
        rows = left.join(big, "key")
    together = small[0].select("key", "uid", "lo", "n", "at", "live", "data")
    for more in small[1:]:
        together = together.unionByName(more.select("key", "uid", "lo", "n", "at", "live", "data"))
    return spans.unionByName(_sorted_repeats(together))


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(size: int, low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which bytes of a text stay, given its repeated windows."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, np.minimum(low + count - 1 + SPAN, size), -1)
    return np.cumsum(edge[:-1]) == 0


def _rows_with_spans(docs: DataFrame) -> DataFrame:
    found = stored(repeated_windows(docs).groupBy("uid").agg(F.collect_list("lo").alias("_lo"), F.collect_list("n").alias("_n")), "windows")
    return docs.select("*", _uid()).join(found, "uid", "left")


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the SHA-256 of the kept bytes of every document.

    Null is empty text; texts under SPAN bytes lose nothing. A null id is kept as null. Repeated rows are documents of
    their own, so all their windows repeat. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [[], [], [], []]
            low, count = batch.column(2), batch.column(3)
            for first, _, data, offsets in text_slices(batch.column(1)):
                for t in range(len(offsets) - 1):
                    text = data[offsets[t] : offsets[t + 1]]
                    if low[first + t].is_valid and len(text):
                        a, b = (np.asarray(x[first + t].values.to_numpy(), np.int64) for x in (low, count))
                        stays = _kept(len(text), a, b)
                        gone = ~stays
                        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        out[1].append(int(gone.sum()))
                        out[2].append(runs)
                        text = text[stays]
                    else:
                        out[1].append(0)
                        out[2].append(0)
                    out[0].append(int(offsets[t + 1] - offsets[t]))
                    out[3].append(hashlib.sha256(text.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = _rows_with_spans(docs.select("doc_id", "text"))
    return rows.select("doc_id", "text", "_lo", "_n").mapInArrow(run, SCHEMA)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(documents(spark, sf_dir))
