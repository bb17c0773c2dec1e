"""All registered queries of the latent-structure engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "em_lca_fixed_iters"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its SQL where there is one."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


from latticore.plans import queries_data, queries_extended, queries_fixed, queries_model, queries_passes, queries_steps  # noqa: E402, F401
