"""The query catalogue: importing it registers every operator's query and oracle."""

from . import analytics, contracts, generators, geo, media, network, numeric, surfaces, tiles  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["A-01_resistance_statistics"](spark, sf_dir)
