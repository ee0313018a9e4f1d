"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from quillon.llm.decontaminate import OP8_SQL, op8_decontamination
from quillon.llm.fingerprint import op2_fingerprints
from quillon.llm.language_id import op9_language_id
from quillon.llm.mixing import op7_mixing
from quillon.llm.near_dedup import op3_near_dedup
from quillon.llm.ngram_lm import op4_ngram_lm
from quillon.llm.quality import op1_quality
from quillon.llm.records import op6_token_records
from quillon.llm.token_count import op10_token_counts
from quillon.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_fingerprints": op2_fingerprints,
    "op3_near_dedup": op3_near_dedup,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_toxicity": op5_toxicity,
    "op6_token_records": op6_token_records,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
}
ORACLES: dict[str, str] = {
    "op8_decontamination": OP8_SQL,
}
