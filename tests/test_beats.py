"""Beats at the end of a record that is cut inside a window."""

from __future__ import annotations

import os

import duckdb
import oracle
from vitalframe.catalog import registry


def _cut(sf, folder, text):
    os.makedirs(folder, exist_ok=True)
    duckdb.sql(f"COPY ({text}) TO '{folder}/embeddings.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{sf}/events.parquet' WHERE event_id < 400) TO '{folder}/events.parquet'")
    return str(folder)


def test_beats_of_a_record_cut_inside_a_window(spark, sf, tmp_path):
    one = f"SELECT embedding, label FROM '{sf}/embeddings.parquet' ORDER BY vec_id LIMIT 1"
    # record 0 lacks vector 3 and half of a window, record 1 ends inside its second window, record 2 has no sample
    folder = _cut(sf, tmp_path / "cut", f"SELECT i AS vec_id, embedding, label FROM ({one}), range(0, 63) r(i) WHERE i <> 3 AND i NOT BETWEEN 25 AND 29")
    fn, sql = registry()["beat_vectors"]
    equal, message = oracle.compare(spark, oracle.connect(folder), folder, fn, sql)
    assert equal, message
    assert fn(spark, folder).select("record").distinct().count() == 2
