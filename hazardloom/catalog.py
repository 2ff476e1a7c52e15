"""Registered queries over the star-schema tables and their SQL."""

from __future__ import annotations

from .plans import estimation, modelling

QUERIES = {**estimation.QUERIES, **modelling.QUERIES}
ORACLE_SQL = {**estimation.ORACLE_SQL, **modelling.ORACLE_SQL}


def flagship(spark, sf_dir: str):
    """Incidence with variance at fixed days, by line status."""
    return estimation.aj_cif_timepoints(spark, sf_dir)
