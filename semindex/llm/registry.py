"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from semindex.llm import bpe, decontaminate, exact_dedup, langid, near_join, pii, quality, repeats, secrets, toxicity

QUERIES = {
    "op9_quality": quality.op9_quality,
    "op6_langid": langid.op6_langid,
    "op4_repeats": repeats.op4_repeats,
    "op3_near_join": near_join.op3_near_join,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op8_bpe": bpe.op8_bpe,
    "op1_toxicity": toxicity.op1_toxicity,
    "op7_secrets": secrets.op7_secrets,
    "op2_pii": pii.op2_pii,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
}

ORACLE_SQL = {
    "op2_pii": pii.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
}
