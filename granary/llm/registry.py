"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, licenses, mixing, neardup, packing, quality, substring, topk, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_exact_topk": topk.op2_exact_topk,
    "op3_chat_format": chat.op3_chat_format,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_pack": packing.op6_pack,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_warc": warc.op8_warc,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {
    "op1_quality_rules": quality.SQL,
    "op2_exact_topk": topk.SQL,
    "op3_chat_format": chat.SQL,
    "op4_substring_dedup": substring.SQL,
    "op5_source_mix": mixing.SQL,
    "op7_near_duplicates": neardup.SQL,
    "op8_warc": warc.SQL,
    "op9_license_scan": licenses.SQL,
}
