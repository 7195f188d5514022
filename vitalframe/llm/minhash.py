"""MinHash near-duplicates with tensored banding and verified links.

A document has two small collections of band values, A and B, of a few min-hashes each. A table key joins one
value of A with one of B, so M + M values give M * M tables: two documents of Jaccard similarity s share a
table with probability (1 - (1 - s^R)^M)^2, 0.9997 at s = 0.75 and nearer to 1 above. Links are confirmed
on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm.common import (
    documents,
    lowered,
    mixed,
    only,
    shingle_hashes,
    stored,
    text_slices,
    word_hashes,
    word_ranges,
)
from vitalframe.llm.components import components

SHINGLE = 5
BANDS = 16  # values per collection
ROWS = 3  # min-hashes per value
NUMERATOR, DENOMINATOR = 75, 100
#: Pairs that meet outside the leader rounds are verified if so many of the 96 min-hashes agree. At similarity 0.75
#: 72 do on average; fewer than 54 have a chance of 1 in 70,000.
AGREEING = 54
#: 64-bit words of a set's parities. Each shingle belongs to one of 64 * PARITY classes, and a bit tells whether the set has an
#: odd number of a class. Two sets have at least as many different shingles as they have different bits, which rules out
#: pairs for certain; sets of some 700 shingles and more fill the classes, and for them the min-hashes decide.
PARITY = 16
#: Sets whose forms are broadcast at most (some 6 MB); more are joined by shuffle.
FORMS = 20_000
#: Rounds in which a table's documents meet a seeded leader of that table before the rest meet each other.
LEADER_ROUNDS = 3

_MULT = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(1001, 1001 + 2 * BANDS * ROWS, dtype=np.uint64))


def text_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their bounds."""
    data = lowered(data)
    start, end, bounds = word_ranges(data, offsets)
    grams, bounds = shingle_hashes(word_hashes(data, start, end), bounds, SHINGLE)
    sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    out = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else grams[:0], out


def band_values(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 2 * BANDS) band values, and one byte of each min-hash; a row of an empty set is meaningless."""
    n = len(bounds) - 1
    out = np.zeros((n, 2 * BANDS), np.uint64)
    sketch = np.zeros((n, 2 * BANDS * ROWS), np.uint8)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out, sketch
    starts = bounds[:-1][full]
    for k in range(2 * BANDS * ROWS):
        turned = grams * _MULT[k]
        turned ^= turned >> np.uint64(29)
        turned *= _ADD[k] | np.uint64(1)
        low = np.minimum.reduceat(turned, starts)
        out[full, k // ROWS] = mixed(out[full, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + low)
        sketch[full, k] = mixed(low) >> np.uint64(56)
    return out, sketch


def parities(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, PARITY) words of the parities of the shingle classes."""
    out = np.zeros((len(bounds) - 1, PARITY), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        bit, word = np.uint64(1) << (grams >> np.uint64(58)), (grams >> np.uint64(50)) % np.uint64(PARITY)
        for k in range(PARITY):
            out[full, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), bounds[:-1][full])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(values: pa.Array, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, width, dtype=np.int32)), values)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the whole set), bands, sketch and parity of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, end, data, offsets in text_slices(batch.column(1)):
                grams, bounds = text_sets(data, offsets)
                n = np.diff(bounds)
                keys = []
                for k in (3, 5):  # two independent 64-bit sums over the set
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams * np.uint64(k)), dtype=np.uint64)])
                    keys.append(sums[bounds[1:]] - sums[bounds[:-1]])
                bands, sketch = band_values(grams, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, end - first),
                        pa.array(n.astype(np.int64)),
                        pa.array([f"{a:016x}{b:016x}" if c else None for a, b, c in zip(*keys, n)], pa.string()),
                        _rows(_signed(bands.reshape(-1)), bands.shape[1]),
                        _rows(pa.array(sketch.reshape(-1).view(np.int8)), sketch.shape[1]),
                        _rows(_signed(parities(grams, bounds).reshape(-1)), PARITY),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands", "sketch", "parity"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_key string, bands array<long>, sketch array<tinyint>, parity array<long>"
    )


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, end, data, offsets in text_slices(batch.column(1)):
                grams, bounds = text_sets(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _signed(grams))],
                    ["doc_id", "grams"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            x, y = a.flatten().to_numpy(), b.flatten().to_numpy()
            at, bt = a.offsets.to_numpy() - a.offsets[0].as_py(), b.offsets.to_numpy() - b.offsets[0].as_py()
            fine = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[at[i] : at[i + 1]], y[bt[i] : bt[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                fine[i] = DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both)
            yield batch.select([0, 1]).filter(pa.array(fine))

    left = sets.select(F.col("doc_id").alias("u"), F.col("grams").alias("a"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("grams").alias("b"))
    # sizes alone rule out many pairs before the sets meet
    rows = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    n, m = F.size("a"), F.size("b")
    rows = rows.filter(DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m))
    return rows.mapInArrow(run, "u long, v long").distinct()


def table_keys(reps: DataFrame) -> DataFrame:
    """(key, node) of all tables in which a representative may meet another one.

    A pair of band values can only collide where both values do, so single values are counted first and
    pairs are formed from shared values alone: most documents form none.
    """
    values = reps.select("node", F.posexplode("bands").alias("band", "value"))
    shared = values.groupBy("band", "value").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    met = values.join(shared, ["band", "value"])
    sides = met.groupBy("node").agg(
        F.collect_list(F.when(F.col("band") < BANDS, F.struct("band", "value"))).alias("a"),
        F.collect_list(F.when(F.col("band") >= BANDS, F.struct("band", "value"))).alias("b"),
    )
    return sides.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b")).select(
        F.xxhash64("a.band", "a.value", "b.band", "b.value").alias("key"), "node"
    )


def _labelled(keys: DataFrame, links: DataFrame) -> DataFrame:
    """(key, node, comp) with the components that ``links`` make."""
    return keys.join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))


def _still_apart(keys: DataFrame, links: DataFrame) -> DataFrame:
    """(key, node, comp, main) of the tables whose nodes are in several components; main: the largest one's."""
    rows = stored(_labelled(keys, links), "apart")
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("kinds")).filter("kinds > 1")
    return stored(rows.join(main.drop("kinds"), "key"), "apart-tables")


def _forms_of(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, form) of the nodes of ``rows``; few are broadcast, so that no shuffle carries them."""
    nodes = stored(rows.select("node").distinct(), "apart-nodes")
    forms = only(reps.select("node", "form"), nodes, "node")
    return F.broadcast(forms) if nodes.count() <= FORMS else forms


def _form() -> Column:
    """Size, parity words and min-hashes of a set; words are fields, since a table compares all its pairs by them."""
    return F.struct(F.col("n_shingles").alias("n"), *[F.col("parity")[k].alias(f"p{k}") for k in range(PARITY)], "sketch")


def _may_link(a: Column, b: Column) -> Column:
    """Whether two forms (``_form``) may belong to linked sets: sizes and parities rule out for certain, then min-hashes are counted."""
    n, m = a["n"], b["n"]
    sizes = DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)
    odd = sum((F.bit_count(a[f"p{k}"].bitwiseXOR(b[f"p{k}"])) for k in range(PARITY)), F.lit(0))
    near = odd * (DENOMINATOR + NUMERATOR) <= (n + m) * (DENOMINATOR - NUMERATOR)
    same = F.size(F.filter(F.zip_with(a["sketch"], b["sketch"], lambda x, y: x == y), lambda equal: equal))
    return sizes & near & (same >= AGREEING)


def node_links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (u, v) that connect all representatives (node, bands, form) as all links of the tables would.

    Only components count, so a pair inside one need not meet. First every node meets the node that shares tables
    with most others, the likely original of a group of copies. In the next rounds every table has a seeded leader of
    its own that the nodes of other components meet. Last, all that is still outside a table's main component meets
    all other components there. Parities and min-hashes go along, so that pairs that share a common passage and little else,
    or copies edited too far apart, are never made.
    """
    keys = stored(table_keys(reps), "tables")
    crowd = keys.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    keys = stored(keys.join(crowd, "key"), "shared-tables")
    wanted = stored(keys.groupBy(F.col("node").alias("doc_id")).agg(F.sum("_n").alias("met")), "wanted")
    sets = stored(full_sets(only(docs.select("doc_id", "text"), wanted.select("doc_id"), "doc_id")), "sets")

    ranked = keys.drop("_n").join(wanted.select(F.col("doc_id").alias("node"), "met"), "node")
    hub = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("low"))).alias("hub"))
    first = ranked.select("key", "node").join(hub, "key").groupBy("node").agg(F.max("hub").alias("hub"))
    first = first.select(F.col("node").alias("u"), (-F.col("hub.low")).alias("v")).filter("u <> v")
    links = stored(confirmed(first, sets), "found")
    keys = keys.drop("_n")
    for turn in range(LEADER_ROUNDS):
        rows = _still_apart(keys, links)
        forms = _forms_of(rows, reps)
        lead = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("o"), "node", "comp")).alias("lead"))
        met = rows.join(lead, "key").filter(F.col("comp") != F.col("lead.comp"))
        # the same two meet in many tables; their forms are looked up once
        pairs = met.select(F.greatest("node", "lead.node").alias("u"), F.least("node", "lead.node").alias("v")).distinct()
        pairs = pairs.join(forms.withColumnsRenamed({"node": "u", "form": "fu"}), "u").join(forms.withColumnsRenamed({"node": "v", "form": "fv"}), "v")
        pairs = pairs.filter(_may_link(F.col("fu"), F.col("fv"))).select("u", "v")
        links = stored(links.unionByName(confirmed(pairs, sets)), "found")

    rows = _still_apart(keys, links)
    forms = _forms_of(rows, reps)
    outer = rows.filter("comp <> main").select("key", F.col("node").alias("x"), F.col("comp").alias("cx"))
    others = forms.withColumnsRenamed({"node": "x", "form": "fx"})
    apart = (F.col("comp") != F.col("cx")) & ((F.col("comp") == F.col("main")) | (F.col("x") > F.col("node")))
    # the pairs of a table may be very many: forms come to the tables, and the join itself compares them
    may = _may_link(F.col("form"), F.col("fx"))
    met = outer.join(others, "x").join(rows.join(forms, "node"), "key").filter(apart & may)
    pairs = met.select(F.greatest("x", "node").alias("u"), F.least("x", "node").alias("v")).distinct()
    return links.unionByName(confirmed(pairs, sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Words are lower-cased (A-Z) runs of non-blanks; a text of under five words is one shingle; null, empty and
    blank texts have no shingle and stand alone. Equal sets are one representative, the smallest id. A null id
    is linked with nothing and kept. Rows that repeat an id are one node: each has its own n_shingles, and the
    links of all hold for it. An empty table gives no rows. Other columns are not read.
    """
    rows = stored(signatures(docs), "signatures")
    named = rows.filter("set_key is not null and doc_id is not null")
    classes = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first(_form()).alias("form")), "classes")
    repeated = (
        named.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).filter("a <> b").select("doc_id")
    )
    links = node_links(classes.select("node", "bands", "form"), docs)
    # classes of other texts under the same id are one node
    ties = named.join(repeated, "doc_id").select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key")
    links = links.unionByName(ties.select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    merged = components(links)
    whole = classes.select("set_key", "node").join(merged, "node", "left").select("set_key", F.coalesce("component", "node").alias("found"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return rows.join(whole, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that are the first of their component. Of rows that repeat an id all stay or none."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
