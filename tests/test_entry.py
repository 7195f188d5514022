"""The driver contract."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), len(s))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, with_sql = map(int, done.stdout.split()[-2:])
    assert queries >= 70 and with_sql >= 60


def test_entry(spark):
    import __spark_entry__ as entry

    first = entry.entry(spark)
    assert first.columns == ["driver_id", "session_id", "scenario", "first_seq", "active_class", "latency_s"]
    assert first.count() > 0
