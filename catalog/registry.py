"""Query registry: one decorator keeps the Spark side and the SQL side of a query together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(
    name: str, sql: str | None = None, doubles: str | Sequence[str] = (), digits: int = 6, needs: str | Sequence[str] = ()
):
    """Register ``name``; ``doubles`` are rounded alike on both sides, ``needs`` names the SQL views.

    Both sides round by the same arithmetic. The small shift keeps exact decimal ties, whose
    last bit depends on the order of summation, off the rounding boundary.
    """
    scale, shift = float(10**digits), 0.503
    rounded = doubles.split() if isinstance(doubles, str) else list(doubles)
    views = needs.split() if isinstance(needs, str) else list(needs)

    def wrap(run: Callable[[SparkSession, str], DataFrame]):
        def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = run(spark, sf_dir)
            cells = {c: F.floor(F.col(c).cast("double") * scale + shift) / scale for c in rounded}
            return df.withColumns(cells) if cells else df

        QUERIES[name] = registered
        if sql is not None:
            cells = ", ".join(f"floor(cast({c} as double) * {scale:e} + {shift:e}) / {scale:e} + 0.0 AS {c}" for c in rounded)
            star = f"* REPLACE ({cells})" if cells else "*"
            ORACLE[name] = f"{with_clause(views, sql)}\nSELECT {star} FROM result"
        return registered

    return wrap
