"""The registered queries of this subpackage and the SQL that states the same result, where SQL can."""

from __future__ import annotations

from importlib import import_module

#: Query name, module that has it as query().
NAMES = {
    "op1_packing": "packing",
    "op2_simhash": "simhash",
    "op3_toxicity": "toxicity",
    "op4_secret_scans": "secrets",
    "op5_substring_dedup": "substrings",
    "op6_quality": "quality",
    "op7_language_id": "language",
    "op8_nearest": "nearest",
    "op9_decontamination": "decontaminate",
    "op10_html_text": "html",
    "op11_source_divergence": "divergence",
    "op12_prefix_trie": "prefixes",
    "op13_lm_scoring": "likelihood",
}


def queries() -> dict:
    return {name: import_module(f".{module}", __package__).query for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f".{module}", __package__) for name, module in NAMES.items()}
    return {name: m.ORACLE_SQL for name, m in modules.items() if getattr(m, "ORACLE_SQL", None)}
