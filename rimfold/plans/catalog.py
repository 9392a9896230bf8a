"""Registry of the engine's queries and their SQL."""

from rimfold.plans import analysis, extras, matching, rasters, training

PLANS = [matching, analysis, rasters, extras, training]
QUERIES: dict = {k: v for m in PLANS for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in PLANS for k, v in m.ORACLES.items()}
