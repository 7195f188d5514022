"""Reorder buffers of stateful streams: rows wait in numbered blocks of keyed state until their turn."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessorHandle


class Blocks:
    """Waiting rows of one key; a block is one value of a map state, so new rows touch only the blocks they fall into.

    A block is one Arrow stream: it is written and read by column, not row by row.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: T.StructType):
        self.schema = to_arrow_schema(schema)
        self.state = handle.getMapState(name, "block long", T.StructType([T.StructField("rows", T.BinaryType())]))

    def get(self, block: int) -> pd.DataFrame:
        (rows,) = self.state.getValue((block,))
        return pa.ipc.open_stream(bytes(rows)).read_all().to_pandas()

    def put(self, block: int, rows: pd.DataFrame) -> None:
        table = pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type, from_pandas=True) for f in self.schema], schema=self.schema)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.schema) as writer:
            writer.write_batch(table)
        self.state.updateValue((block,), (out.getvalue().to_pybytes(),))

    def take(self, block: int) -> pd.DataFrame:
        rows = self.get(block)
        self.drop(block)
        return rows

    def drop(self, block: int) -> None:
        self.state.removeKey((block,))


def complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in ``columns``; with the watermark's column among them, the watermark sees all rows first.

    The test is one expression over an array, so no part of it is moved below the watermark.
    """
    values: list[Column] = [F.col(c).cast("string") for c in columns]
    return rows.filter(F.forall(F.array(*values), lambda x: x.isNotNull()))
