"""The registered queries, each with an equivalent in DuckDB SQL where SQL can express it."""

from sparkloom.plans import comparing, contracting, describing, judging, learning, phenotyping, testing  # noqa: F401
from sparkloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
