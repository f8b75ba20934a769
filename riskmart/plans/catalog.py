"""Imports every query module so the registry is complete."""

from __future__ import annotations

from . import q_analytics, q_core, q_incremental, q_jobs, q_ml, q_stream  # noqa: F401
from .registry import OPERATORS, ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)


def operators():
    return dict(OPERATORS)
