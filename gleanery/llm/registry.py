"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import importlib

# operator number: module and function; each is imported when first asked for
_MODULES = {
    "op1_simhash_dedup": "simhash",
    "op2_license_scan": "licenses",
    "op3_warc": "warc",
    "op4_toxicity": "toxicity",
    "op5_quality": "quality",
    "op6_ann_forest": "forest",
    "op7_url_filter": "url_filter",
    "op8_decontaminate": "decontaminate",
    "op9_secret_scan": "secrets",
    "op10_byte_bpe": "bpe",
    "op11_token_counts": "token_counts",
    "op12_spelling": "spelling",
    "op13_whitening": "whitening",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"gleanery.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _MODULES.items():
        sql = getattr(importlib.import_module(f"gleanery.llm.{module}"), f"{name.split('_')[0].upper()}_SQL", None)
        if sql:
            out[name] = sql
    return out
