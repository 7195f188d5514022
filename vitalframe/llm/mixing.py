"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitalframe.llm.common import documents, joined_small, stored, word_count

#: Words per source are cut into about sqrt(words / 64) shards, so both the shards of a source and the
#: documents of a shard grow as the square root of the source.
SHARD_UNIT = 64
SEED = "mix-1"
#: A source has at least so many blocks, and a shard about so many at least.
LEAST_BLOCKS, SHARD_BLOCKS = 256, 16


def _digits(text: Column) -> Column:
    """Eight hex digits of an md5 as a number."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def apportion(votes: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Sainte-Lague seats: adds ``seats`` to rows (group, key, votes, house), where house is the group's seats.

    Highest quotients votes / (2 j - 1) win, ties go to the smaller key. Seats below a bound that every
    result exceeds are given at once; only the last few per row compete, so a group of n rows ranks at most
    3 n quotients however many seats it has.
    """
    whole = W.partitionBy(*group)
    rows = (
        votes.withColumn("_n", F.sum((F.col("votes") > 0).cast("int")).over(whole) / F.lit(2.0))
        .withColumn("_all", F.sum("votes").over(whole).cast("double"))
        .withColumn("_share", F.when(F.col("_all") > 0, F.col("votes") / F.col("_all")).otherwise(0.0))
        .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_share") * (F.col("house") - F.col("_n")) - 0.5)).cast("long"))
        .withColumn("_high", F.ceil(F.col("_share") * (F.col("house") + F.col("_n")) + 1.0).cast("long"))
        .withColumn("_open", F.col("house") - F.sum("_low").over(whole))
    )
    quotient = F.col("votes") / (2 * F.col("_j") - 1)
    won = (
        rows.filter((F.col("votes") > 0) & (F.col("house") > 0))
        .withColumn("_j", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
        .withColumn("_rank", F.row_number().over(whole.orderBy(quotient.desc(), *key, "_j")))
        .filter(F.col("_rank") <= F.col("_open"))
        .groupBy(*group, *key)
        .agg(F.count("*").alias("_won"))
    )
    return (
        rows.join(won, [*group, *key], "left")
        .withColumn("seats", F.when(F.col("votes") > 0, F.col("_low")).otherwise(0) + F.coalesce("_won", F.lit(0)))
        .drop("_n", "_all", "_share", "_low", "_high", "_open", "_won")
    )


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeat: int) -> DataFrame:
    """Add rank, target (words) and total to rows (key, source, source_size), one row per source.

    A source gets its weight's share of ``share`` times all words, at most ``repeat`` times its own; what
    is cut off goes to the others by weight. Sorted by cap / weight, the capped sources are a head of the list.
    """
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.partitionBy(F.lit(0)).orderBy("ratio", "rank")
    whole = W.partitionBy(F.lit(0))
    level = (F.col("goal") - F.col("capped")) / F.col("open_weight")
    return (
        sources.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", (F.col("source_size") * repeat).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("goal", F.col("total") * F.lit(float(share)))
        .withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)["level"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("level"), F.col("ratio")) * F.col("weight")))
        .select("key", "source", "source_size", "rank", "target", "total")
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2, seed: str = SEED, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Words that a mix takes from each document: doc_id, size, source_size, target, taken, source and the ``carry`` columns.

    Sources in code-point order (null last) weigh ``weights`` in turn. The mix is cut into equal-token blocks;
    sources get blocks, then the shards of a source get theirs, by highest quotients. A shard lays its documents
    end to end in seeded order; its quota takes every block ``quota div blocks`` times and a seeded run of blocks
    once more. Blocks are counted, never listed, so no document meets more than two block borders.

    A source of under LEAST_BLOCKS blocks has smaller blocks of its own and as many as meet its target, and shards
    are not smaller than blocks, so that small sources too come near their target.

    Null text or text without words has size 0 and nothing taken. A row without an id is placed by its text. Repeated rows
    are laid out one after the other. An empty table gives no rows. Other columns are not read.
    """
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")))))
    mark = F.md5(F.concat(F.lit(seed + ":"), own))
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"),
            word_count(F.col("text")).alias("size"),
            mark.alias("mark"),
            *carry,
        ),
        "mix-sizes",
    )
    return mix_sizes(sized, weights, share, repeat, seed, carry)


def mix_sizes(sized: DataFrame, weights: tuple[int, ...], share: float, repeat: int, seed: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``mix_sources`` from a stored table (doc_id, source, key, size, mark and the ``carry`` columns)."""
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sources, weights, share, repeat)
    block = F.greatest(F.lit(1.0), F.ceil(F.sqrt("total") / 64).cast("double"))
    own = F.greatest(F.lit(1.0), F.ceil(F.col("source_size") / LEAST_BLOCKS).cast("double"))
    many = F.greatest(F.lit(1.0), F.ceil(F.sqrt(F.col("source_size") / SHARD_UNIT))).cast("long")
    few = F.greatest(F.lit(1.0), F.floor(F.col("source_size") / (F.col("own") * SHARD_BLOCKS))).cast("long")
    small = F.col("own") < F.col("block")
    sources = (
        sources.withColumn("block", block)
        .withColumn("own", F.least("block", own))
        .withColumn("shards", F.least(many, few))
        .withColumn("votes", F.when(small, 0.0).otherwise(F.col("target")))
        .withColumn("house", F.floor(F.sum("votes").over(W.partitionBy(F.lit(0))) / F.col("block") + 0.5).cast("long"))
    )
    sources = apportion(sources, [], ["rank"]).withColumn(
        "seats", F.when(small, F.floor(F.col("target") / F.col("own") + 0.5).cast("long")).otherwise(F.col("seats"))
    )
    sources = stored(sources.drop("votes", "house", "block").withColumnsRenamed({"seats": "blocks", "own": "block"}), "mix-sources")
    n = sources.count()

    placed = joined_small(sized.drop("source"), sources, ["key"], n).withColumn("shard", F.pmod(_digits(F.col("mark")), "shards"))
    shards = (
        placed.groupBy("key", "shard")
        .agg(F.sum("size").alias("tokens"), F.first("block").alias("block"), F.first("blocks").alias("blocks"))
        .withColumn("votes", F.when(F.col("tokens") > 0, F.greatest(F.lit(1.0), F.floor(F.col("tokens") / F.col("block") + 0.5))).otherwise(0.0).cast("long"))
        .withColumn("house", F.least(F.col("blocks"), 2 * F.sum("votes").over(W.partitionBy("key"))))
        .select("key", "shard", "tokens", "votes", "house")
    )
    if repeat != 2:
        shards = shards.withColumn("house", F.least(F.col("house"), repeat * F.sum("votes").over(W.partitionBy("key"))))
    quotas = apportion(shards, ["key"], ["shard"]).select("key", "shard", "tokens", F.col("votes").alias("cells"), F.col("seats").alias("quota"))

    line = W.partitionBy("key", "shard").orderBy("mark", "doc_id", "size")
    laid = placed.withColumn("stop", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("size"))
    cell = F.md5(F.concat(F.lit(seed + ":"), F.col("key"), F.lit(":"), F.col("shard").cast("string")))
    rows = laid.join(quotas, ["key", "shard"]).withColumn("from", F.when(F.col("cells") > 0, F.pmod(_digits(cell), "cells")).otherwise(0))

    def edge(b: Column) -> Column:
        """First token of block b of the shard."""
        return F.floor(b * F.col("tokens") / F.greatest(F.col("cells"), F.lit(1))).cast("long")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least("stop", high) - F.greatest("start", low))

    extra = F.when(F.col("cells") > 0, F.col("quota") % F.col("cells")).otherwise(0)
    times = F.when(F.col("cells") > 0, F.floor(F.col("quota") / F.col("cells"))).otherwise(0)
    last = F.col("from") + extra
    taken = (
        times * F.col("size")
        + overlap(edge(F.col("from")), edge(F.least(last, F.col("cells"))))
        + overlap(F.lit(0).cast("long"), edge(F.greatest(F.lit(0), last - F.col("cells"))))
    )
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", *carry)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def _apportion_sql(name: str, votes: str, group: str, key: str) -> str:
    """The same seats by ranking every quotient that can win."""
    by = f"PARTITION BY {group}" if group else ""
    cols = f"{group}, {key}" if group else key
    return f"""
{name}_q AS (
  SELECT {cols}, house, row_number() OVER ({by} ORDER BY votes::DOUBLE / (2 * j - 1) DESC, {key}, j) AS place
  FROM (SELECT *, unnest(generate_series(1, least(house, ceil(votes::DOUBLE / allv * (house + n) + 1)::BIGINT))) AS j
        FROM (SELECT *, sum(votes) OVER ({by}) AS allv, count(*) OVER ({by}) AS n FROM {votes})
        WHERE votes > 0 AND house > 0)),
{name} AS (
  SELECT v.*, coalesce(w.won, 0)::BIGINT AS seats
  FROM {votes} v LEFT JOIN (SELECT {cols}, count(*) AS won FROM {name}_q WHERE place <= house GROUP BY {cols}) w USING ({cols}))"""


OP8_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, '')))) AS mark
  FROM documents),
src AS (
  SELECT key, source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY key, source),
weighed AS (
  SELECT *, (CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS weight, (2 * source_size)::DOUBLE AS cap,
         sum(source_size) OVER () AS total FROM src),
poured AS (
  SELECT *, cap / weight AS ratio, sum(cap) OVER o - cap AS capped, sum(weight) OVER f AS open_weight FROM weighed
  WINDOW o AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING),
         f AS (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
levels AS (SELECT *, (total * 1.5::DOUBLE - capped) / open_weight AS level FROM poured),
one AS (SELECT min({{'ratio': ratio, 'rank': rank, 'level': level}}) AS first FROM levels WHERE level <= ratio),
aimed AS (
  SELECT key, source, rank, source_size, least(cap, coalesce((SELECT first.level FROM one), ratio) * weight) AS target,
         greatest(1, ceil(sqrt(total) / 64))::DOUBLE AS block,
         least(greatest(1, ceil(sqrt(total) / 64)), greatest(1, ceil(source_size / {LEAST_BLOCKS}.0)))::DOUBLE AS own
  FROM levels),
sharded AS (
  SELECT *, least(greatest(1, ceil(sqrt(source_size / {SHARD_UNIT}.0))), greatest(1, floor(source_size / (own * {SHARD_BLOCKS}))))::BIGINT AS shards,
         CASE WHEN own < block THEN 0 ELSE target END AS votes
  FROM aimed),
voted AS (SELECT *, floor(sum(votes) OVER () / block + 0.5)::BIGINT AS house FROM sharded),
{_apportion_sql("shared", "voted", "", "rank")},
given AS (
  SELECT * EXCLUDE (seats, block, own), own AS block,
         CASE WHEN own < block THEN floor(target / own + 0.5)::BIGINT ELSE seats END AS seats FROM shared),
placed AS (
  SELECT d.doc_id, d.source, d.size, d.mark, g.* EXCLUDE (source), ('0x' || substr(d.mark, 1, 8))::BIGINT % g.shards AS shard
  FROM sized d JOIN given g USING (key)),
cells AS (
  SELECT key, shard, sum(size)::BIGINT AS tokens, any_value(seats) AS blocks,
         (CASE WHEN sum(size) > 0 THEN greatest(1, floor(sum(size) / any_value(block) + 0.5)) ELSE 0 END)::BIGINT AS votes
  FROM placed GROUP BY key, shard),
housed AS (SELECT key, shard, tokens, votes, least(blocks, 2 * sum(votes) OVER (PARTITION BY key))::BIGINT AS house FROM cells),
{_apportion_sql("quota", "housed", "key", "shard")},
laid AS (
  SELECT p.doc_id, p.source, p.size, p.source_size, p.target, q.tokens, q.votes AS m, q.seats,
         sum(p.size) OVER (PARTITION BY p.key, p.shard ORDER BY p.mark, p.doc_id, p.size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop,
         CASE WHEN q.votes > 0
              THEN ('0x' || substr(md5('{SEED}:' || p.key || ':' || p.shard::VARCHAR), 1, 8))::BIGINT % q.votes ELSE 0 END AS b
  FROM placed p JOIN quota q USING (key, shard)),
cut AS (
  SELECT *, stop - size AS start, CASE WHEN m > 0 THEN seats // m ELSE 0 END AS times,
         CASE WHEN m > 0 THEN b + seats % m ELSE 0 END AS last FROM laid)
SELECT doc_id, size, source_size, target, source,
       (times * size
        + greatest(0, least(stop, least(last, m) * tokens // greatest(m, 1)) - greatest(start, b * tokens // greatest(m, 1)))
        + greatest(0, least(stop, greatest(0, last - m) * tokens // greatest(m, 1)) - greatest(start, 0)))::BIGINT AS taken
FROM cut
"""
