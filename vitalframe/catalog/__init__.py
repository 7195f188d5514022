"""Registry of runnable queries, each with the SQL it must equal."""

from __future__ import annotations


def registry() -> dict:
    """Name -> (callable(spark, table directory), SQL or None)."""
    from vitalframe.catalog import detection, evaluation, files, learning, messages, replay, signals, streams

    out: dict = {}
    for module in (detection, evaluation, signals, messages, replay, files, learning, streams):
        out.update(module.QUERIES)
    return out
