"""Registered queries: one module per family, each with QUERIES and ORACLES."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("profile_queries", "detect_queries", "retrieve_queries", "encode_queries", "select_queries", "text_queries", "store_queries", "stream_queries", "summary_queries")


def _gather(name: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        for k, v in getattr(import_module(f"sievelake.plans.{family}"), name).items():
            if k in out:
                raise ValueError(f"query {k} is registered twice")
            out[k] = v
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLES")
