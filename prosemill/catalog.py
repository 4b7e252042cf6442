"""All queries by name and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis, building, features, programs, spikes, structure
from .plans.statements import ALL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{name: statement.query() for name, statement in ALL.items()}, **programs.QUERIES, **analysis.QUERIES, **structure.QUERIES, **building.QUERIES, **features.QUERIES, **spikes.QUERIES}
ORACLES: dict[str, str] = {**{name: statement.text("duck") for name, statement in ALL.items()}, **programs.ORACLES, **analysis.ORACLES, **structure.ORACLES, **building.ORACLES, **features.ORACLES}
