"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from vitalframe.llm import (
    classlm,
    covering,
    decontaminate,
    langid,
    linededup,
    minhash,
    mixing,
    mtree,
    periodic,
    substrings,
    toxicity,
    unitdedup,
    whitening,
)


def registry() -> dict:
    """Name -> (callable(spark, table directory), SQL or None)."""
    return {
        "op1_langid": (langid.op1_langid, None),
        "op3_decontaminate": (decontaminate.op3_decontaminate, None),
        "op4_units": (unitdedup.op4_units, unitdedup.OP4_SQL),
        "op5_substrings": (substrings.op5_substrings, None),
        "op6_topk": (mtree.op6_topk, mtree.OP6_SQL),
        "op10_classlm": (classlm.op10_classlm, None),
        "op2_lines": (linededup.op2_lines, linededup.OP2_SQL),
        "op7_minhash": (minhash.op7_minhash, None),
        "op9_toxicity": (toxicity.op9_toxicity, None),
        "op8_mixing": (mixing.op8_mixing, mixing.OP8_SQL),
        "op11_runs": (periodic.op11_runs, None),
        "op12_simhash": (covering.op12_simhash, None),
        "op13_whitening": (whitening.op13_whitening, None),
    }
