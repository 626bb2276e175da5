"""The queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
from lakeloom.llm.chat import OP2_SQL, op2_chat
from lakeloom.llm.licenses import op10_licenses
from lakeloom.llm.mixing import op7_mixing
from lakeloom.llm.packing import op1_packing
from lakeloom.llm.parsing import op8_fingerprints
from lakeloom.llm.pii import op5_pii
from lakeloom.llm.quality import OP3_SQL, op3_quality_rules
from lakeloom.llm.simhash import op6_simhash
from lakeloom.llm.toxicity import op9_toxicity
from lakeloom.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_fingerprints": op8_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_chat": OP2_SQL, "op3_quality_rules": OP3_SQL, "op4_warc": OP4_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
