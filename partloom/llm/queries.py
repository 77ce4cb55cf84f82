"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: name -> module that has a function of this name
_MODULES = {
    "op1_cutting_stock_packing": "packing",
    "op2_license_paragraphs": "licenses",
    "op3_divergence_quality": "quality",
    "op4_png_media": "media",
    "op5_cross_entropy_difference": "scoring",
    "op6_rans_token_files": "rans",
    "op7_pivotal_mixing": "mixing",
    "op8_disclosure_sanitisation": "privacy",
    "op9_digest_cache_counts": "counts",
    "op10_bagminhash_dedup": "near_dups",
    "op11_subword_toxicity": "toxicity",
    "op12_source_divergence": "divergence",
    "op13_clustered_layout": "layout",
}


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f".{_MODULES[name]}", __package__), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f".{_MODULES[name]}", __package__).SQL for name in ("op12_source_divergence", "op13_clustered_layout")}
