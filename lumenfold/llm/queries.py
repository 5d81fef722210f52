"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licenses, minhash, mixing, rabitq, topk
from .minhash import op10_minhash_near_dedup
from .mixing import op4_mix_sources
from .packing import op7_pack_sequences
from .quality import op6_quality_classifier
from .rabitq import op1_embedding_near_dedup
from .substrings import op5_suffix_array_dedup
from .toxicity import op8_toxicity_classifier

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op4_mix_sources": op4_mix_sources,
    "op7_pack_sequences": op7_pack_sequences,
    "op3_license_scan": licenses.op3_license_scan,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op8_toxicity_classifier": op8_toxicity_classifier,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

SQL: dict[str, str] = {
    "op1_embedding_near_dedup": rabitq.SQL,
    "op2_exact_top_k": topk.SQL,
    "op4_mix_sources": mixing.SQL,
    "op3_license_scan": licenses.SQL,
    "op9_chat_formatting": chat.SQL,
    "op10_minhash_near_dedup": minhash.SQL,
}
