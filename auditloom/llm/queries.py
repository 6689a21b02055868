"""The registered queries of the training-data operators."""

from __future__ import annotations

from auditloom.llm import sql
from auditloom.llm.bpe import op8_bpe
from auditloom.llm.ctw import op1_ctw
from auditloom.llm.decontaminate import op6_decontamination
from auditloom.llm.neardup import op4_neardup
from auditloom.llm.pii import op7_pii
from auditloom.llm.repeats import op9_repeats
from auditloom.llm.secrets import op3_secrets
from auditloom.llm.sharding import op10_sharding
from auditloom.llm.telephony import op5_telephony
from auditloom.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_ctw": op1_ctw,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_neardup": op4_neardup,
    "op5_telephony": op5_telephony,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_repeats": op9_repeats,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL = {"op3_secrets": sql.secrets(), "op4_neardup": sql.near_copies(), "op9_repeats": sql.repeats()}
