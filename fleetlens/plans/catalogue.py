"""Imports every plan module, which fills the registry."""

from fleetlens.plans import (
    audit, changes, checks, digests, discovery, files, grants, intake, packages, redaction, sources, telemetry,
)
from fleetlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
