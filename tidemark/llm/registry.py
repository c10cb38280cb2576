"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm.chat import OP4_SQL, op4_chat_formatting
from tidemark.llm.collocations import OP11_SQL, op11_collocations
from tidemark.llm.decontaminate import OP7_SQL, op7_decontaminate
from tidemark.llm.fingerprint import op5_fingerprints
from tidemark.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from tidemark.llm.html_text import op10_html_text
from tidemark.llm.minhash_dedup import op9_minhash_dedup
from tidemark.llm.mixing import op6_mixing
from tidemark.llm.secrets import OP1_SQL, op1_secret_scan
from tidemark.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from tidemark.llm.token_ids import op13_token_ids
from tidemark.llm.toxicity import op3_toxicity
from tidemark.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_fingerprints": op5_fingerprints,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_ids": op13_token_ids,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op7_decontaminate": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
