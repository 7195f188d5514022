"""The pipeline's stages in order, and what each must keep."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from vitalframe.llm.common import documents, stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        now = docs.count()
        assert now <= before
        if name != "mixing":
            assert docs.columns == columns
            assert now >= 0.7 * before
        before = now
    assert {"size", "target", "taken"} <= set(docs.columns)
    assert docs.filter("taken <= 0 or taken > 2 * size").count() == 0


def test_mixing_tells_rows_apart_by_text(spark):
    """Rows without an id, rows that share one and equal rows: each gets its own size and takes at most twice that."""
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    rows = [(None, words(10, "a"), "s"), (None, words(3000, "b"), "s"), (7, words(20, "c"), "s"), (7, words(900, "d"), "s")]
    rows += [(8, words(50, "e"), None)] * 3 + [(9, None, "s"), (None, "", None)]
    docs = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], DOCS).withColumn("taken", F.lit("x")).withColumn("_digest", F.lit(1))
    got = corpus_pipeline.mixing(spark, docs, "").collect()
    assert all(r["size"] == len(r["text"].split()) and 0 < r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got} >= {3000, 900} and len([r for r in got if r["doc_id"] == 8]) in (0, 3)
    targets = {r["source"]: r["target"] for r in got}
    for source, target in targets.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == source) - target) <= 0.05 * target + 3


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls everywhere, no labels, no benchmark, clashing columns, no rows: every stage gives a defined result."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    line = "one line of quite a few words that is long enough to be compared with others"
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, f"{line}\n{line}\nshort\nshort", "en", "a", 9), (2, line, "en", "a", 9), (None, line, None, None, 0), (3, "x " * 5000, None, "b", 1)]
    full = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit(1), "target": F.lit("t"), "taken": F.lit(2.5), "kept": F.lit(True), "score": F.lit(0), "h": F.lit(1)})
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stored(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            if name != "mixing":
                assert docs.columns == before.columns
            if name in ("toxicity", "decontamination"):
                assert docs.count() == before.count()
        assert {"size", "source_size", "target", "taken", "score"} <= set(docs.columns)
