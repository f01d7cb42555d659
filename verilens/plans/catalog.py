"""Imports every module of queries so that the registry is full."""

from verilens.plans import corpus, decisions, matching, nested, protocols, series, speech, vectors  # noqa: F401
from verilens.plans.registry import ORACLES, QUERIES  # noqa: F401
