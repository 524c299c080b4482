"""Operators for training-data pipelines; nothing else in the library needs them."""

from . import (  # noqa: F401
    curriculum,
    decontaminate,
    fill_middle,
    license_scan,
    packing,
    periodic,
    pseudonyms,
    quality_model,
    quality_rules,
    repair,
    sharding,
    simhash,
    url_filter,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
