"""The subpackage's queries, and their SQL where it can express them."""

from __future__ import annotations

from . import decontaminate, html_extract, licenses, line_dedup, mixing, near_dedup, secrets, topk, toxicity, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_topk": topk.op3_topk,
    "op4_secrets": secrets.op4_secrets,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_licenses": licenses.op7_licenses,
    "op8_html": html_extract.op8_html,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_url_filter": url_filter.op10_url_filter,
    "benchmark_proximity": decontaminate.benchmark_proximity,
}

ORACLES = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_topk": topk.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}
