"""Registry of the queries: a DataFrame plan and, where SQL can say it, the SQL text it must agree with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import with_ctes

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in floats}) if floats else df


def query(name: str, sql: str | None = None, floats: Sequence[str] = (), digits: int = 8):
    """Register a plan. ``floats`` names the double columns of the SQL, rounded alike on both sides."""

    def register(fn: Plan) -> Plan:
        def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _rounded(fn(spark, sf_dir), digits)

        plan.__name__, plan.__doc__ = name, fn.__doc__
        QUERIES[name] = plan
        if sql is not None:
            body = sql.strip().rstrip(";")
            if floats:
                swaps = ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in floats)
                body = f"SELECT * REPLACE ({swaps}) FROM ({body}) AS result_rows"
            ORACLES[name] = with_ctes(body)
        return fn

    return register
