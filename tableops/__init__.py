"""Preparing and checking business tables with Spark DataFrames."""

from tableops import functions, operators, sources
from tableops.operators import *  # noqa: F403
from tableops.sources import *  # noqa: F403

__all__ = ["functions", *operators.__all__, *sources.__all__]
