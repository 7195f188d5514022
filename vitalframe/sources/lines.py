"""Text files as numbered lines, in file order, without reading a file whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "\ufeff"


def text_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, block, size, value) of every non-blank line below ``path``, in file order within a split.

    Files are split like any text source.  ``block`` is the byte offset of the split, ``size`` the bytes of the file.
    """
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path)
    )
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.ltrim(F.col("value"), F.lit(BOM)).alias("value"),
    ).filter(F.trim("value") != "")


RUNS = "path string, block long, first long, header string, lines array<string>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a split that came in one batch as one row: position of the first in the split, the split's first line."""
    last, taken, header = None, 0, None
    for batch in batches:
        paths, blocks, values = batch.column(0), batch.column(1), batch.column(2)
        n = batch.num_rows
        if not n:
            continue
        differs = pc.or_(pc.not_equal(paths.slice(1), paths.slice(0, n - 1)), pc.not_equal(blocks.slice(1), blocks.slice(0, n - 1)))
        starts = np.concatenate([[0], np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1])
        ends = np.append(starts[1:], n)
        first, headers = np.zeros(len(starts), np.int64), values.take(pa.array(starts)).to_pylist()
        if (paths[0].as_py(), blocks[0].as_py()) == last:
            first[0], headers[0] = taken, header
        last, taken, header = (paths[n - 1].as_py(), blocks[n - 1].as_py()), int(first[-1] + ends[-1] - starts[-1]), headers[-1]
        at = pa.array(starts)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), values)
        columns = [paths.take(at), blocks.take(at), pa.array(first), pa.array(headers, pa.string()), lists]
        yield pa.RecordBatch.from_arrays(columns, ["path", "block", "first", "header", "lines"])


_UNITS = {"": 1, "b": 1, **{u + b: 1 << 10 * (k + 1) for k, u in enumerate("kmgt") for b in ("", "b")}}


def _unsplit(spark: SparkSession) -> int:
    """Bytes up to which a file is never split; 0 if the settings cannot be read."""
    found = [re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(f"spark.sql.files.{n}").lower()) for n in ("openCostInBytes", "maxPartitionBytes")]
    return min(int(m[1]) * _UNITS.get(m[2], 0) if m else 0 for m in found)


def line_runs(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, start, header, lines): stretches of lines of one file, the file's position of the first and its first line.

    Lines are numbered where they are read and never shuffled. Only files above the split size are read a second time, for
    the number of lines of their splits; that list has at most bytes / split size rows. Spark cuts files by the bytes of all
    files it reads, so these files are read alone both times: a filter on their size also takes away the others.
    """
    lines, unsplit = text_lines(spark, path, glob), _unsplit(spark)
    whole = lines.filter(F.col("size") <= unsplit).select("path", "block", "value").mapInArrow(_runs, RUNS)
    runs = lines.filter(F.col("size") > unsplit).select("path", "block", "value").mapInArrow(_runs, RUNS)
    splits = runs.groupBy("path", "block").agg(
        F.sum(F.size("lines")).alias("_n"), F.max(F.when(F.col("block") == 0, F.col("header"))).alias("_head")
    )
    file = Window.partitionBy("path")
    earlier = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    later = splits.select("path", "block", before, F.max("_head").over(file).alias("_head")).filter("block > 0")
    header = F.when(F.col("block") == 0, F.col("header")).otherwise(F.col("_head"))
    lost = F.raise_error(F.lit("a file was cut in two ways")).cast("long")
    start = F.col("first") + F.when(F.col("block") == 0, 0).otherwise(F.coalesce("_before", lost))
    numbered = runs.join(F.broadcast(later), ["path", "block"], "left").select("path", start.alias("start"), header.alias("header"), "lines")
    return whole.select("path", F.col("first").alias("start"), "header", "lines").unionByName(numbered)


def numbered_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, idx, value): lines numbered from 0 per file."""
    runs = line_runs(spark, path, glob).select("path", "start", F.posexplode("lines").alias("_at", "value"))
    return runs.select("path", (F.col("start") + F.col("_at")).alias("idx"), "value")


def with_headers(spark: SparkSession, path: str, glob: str, of_header: dict[str, Column]) -> DataFrame:
    """(path, idx, value, ...): data lines numbered from 0, each with what its file's ``header`` tells.

    ``of_header`` is evaluated once per stretch of lines.
    """
    told = line_runs(spark, path, glob).select("path", "start", "lines", *[c.alias(name) for name, c in of_header.items()])
    lines = told.select("path", "start", *of_header, F.posexplode("lines").alias("_at", "value"))
    return lines.select("path", (F.col("start") + F.col("_at") - 1).alias("idx"), "value", *of_header).filter("idx >= 0")


def fields(line: Column) -> Column:
    """Comma-separated fields; commas inside double quotes do not split. One pass over the line."""
    parts = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit('((?:"[^"]*"|[^,"])*+),'), F.lit(1))
    return F.transform(parts, lambda p: F.btrim(F.trim(p), F.lit('"')))


def words(line: Column) -> Column:
    """Whitespace-separated fields."""
    return F.split(F.trim(line), r"\s+")


