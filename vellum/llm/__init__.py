"""Training-data operators: tokenising, search, media, dedup, mixing, extraction, screening.

``queries()`` and ``oracle_sql()`` collect what the operator modules register.
"""

from __future__ import annotations

import importlib

MODULES = (
    "op1_pieces",
    "op2_topk",
    "op3_flac",
    "op4_dedup",
    "op5_mix",
    "op6_wavelet",
    "op7_html",
    "op8_pii",
    "op9_toxic",
    "op10_secrets",
    "op11_tries",
    "op12_curve",
    "op13_phrases",
)


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{module}"), name, {})
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE_SQL")
