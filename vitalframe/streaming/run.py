"""Run a bounded stream to its end and read what it wrote; count what streams take in and give out."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from vitalframe.sources.tables import shared_folder
from vitalframe.streaming.sinks import start_writer

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of the row that closes an input: the watermark then passes every row before it.
END = datetime(9000, 1, 1)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state in RocksDB while a query starts; the session setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class RowCounts(StreamingQueryListener):
    """Sums of the observed row counts (metrics with a field ``n``) of every query, and the rows dropped as too late.

    ``totals`` is keyed by query id, so a query that is restarted from its checkpoint goes on counting.
    """

    def __init__(self) -> None:
        self.totals: dict[str, Counter] = defaultdict(Counter)
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        totals = self.totals[str(progress.id)]
        for name, row in progress.observedMetrics.items():
            totals[name] += row["n"]
        for operator in progress.stateOperators:
            totals["dropped_by_watermark"] += operator.numRowsDroppedByWatermark

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()


class Replay:
    """A bounded stream run to its end: its rows and, after ``run``, its counts and the state left."""

    def __init__(self, source: DataFrame, time: str, build: Callable[[DataFrame], DataFrame]) -> None:
        self.spark = source.sparkSession
        self.folder = shared_folder(self.spark)
        self.ends, self.time, self.schema = f"{self.folder}/ends", time, source.schema
        self.spark.createDataFrame([], self.schema).write.parquet(self.ends)
        # the row that closes the input comes through a second folder of the same shape
        closing = self.spark.readStream.schema(self.schema).parquet(self.ends)
        self.stream = build(source.unionByName(closing))

    def close(self) -> None:
        """Write the closing row: no value but a time after all others."""
        row = F.lit(END).cast(self.schema[self.time].dataType)
        columns = [(row if f.name == self.time else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*columns).write.mode("append").parquet(self.ends)

    def run(self) -> DataFrame:
        listener = RowCounts()
        self.spark.streams.addListener(listener)
        try:
            for last in (False, True):
                if last:
                    self.close()
                with rocksdb_state(self.spark):
                    query = start_writer(self.stream, f"{self.folder}/rows", f"{self.folder}/state")
                query.awaitTermination()
                listener.ended[str(query.runId)].wait(60)
            self.counts = dict(listener.totals[str(query.id)])
            operators = (query.lastProgress or {}).get("stateOperators") or []
            self.rows_left = sum(o["numRowsTotal"] for o in operators)
        finally:
            self.spark.streams.removeListener(listener)
        reader = self.spark.read.option("recursiveFileLookup", "true").schema(self.stream.schema)
        return reader.parquet(f"{self.folder}/rows")


def drain(source: DataFrame, time: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Process all a bounded stream holds, in as many micro-batches as its source makes, and return the rows written.

    ``build`` makes the query of the stream ``source``; ``time`` is the source's column that its watermark follows. When all is
    read, one closing row with a time after all others lets the watermark pass whatever still waits.
    """
    return Replay(source, time, build).run()
