"""Collects the query and oracle maps of all plan modules."""

from __future__ import annotations

import importlib

_MODULES = [
    ("netvigil.plans.device_queries", "netvigil.plans.device_oracles"),
    ("netvigil.plans.score_queries", "netvigil.plans.score_oracles"),
    ("netvigil.plans.sample_queries", "netvigil.plans.sample_oracles"),
    ("netvigil.plans.feature_queries", "netvigil.plans.feature_oracles"),
    ("netvigil.plans.source_queries", "netvigil.plans.source_oracles"),
    ("netvigil.plans.file_queries", "netvigil.plans.file_oracles"),
    ("netvigil.plans.edge_queries", "netvigil.plans.edge_oracles"),
    ("netvigil.plans.model_queries", "netvigil.plans.model_oracles"),
]


def all_queries() -> dict:
    out = {}
    for qmod, _ in _MODULES:
        out.update(importlib.import_module(qmod).QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for _, omod in _MODULES:
        if omod:
            out.update(importlib.import_module(omod).ORACLES)
    return out
