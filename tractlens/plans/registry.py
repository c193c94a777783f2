"""The registered queries: one Spark callable and, where SQL can say it, one SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = (
    "labels",
    "ranks",
    "decisions",
    "tokens",
    "pixels",
    "spatial",
    "texture",
    "expressions",
    "stores",
    "learning",
)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Registers a query; `floats` names the columns rounded alike on the SQL side."""

    def wrap(fn):
        from tractlens.plans.data import Data

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Data(spark, sf_dir)), digits)

        text = sql
        if sql is not None and floats:
            swaps = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in floats.split())
            text = f"SELECT * REPLACE ({swaps}) FROM ({sql.strip()}) AS answer"
        assert name not in _QUERIES, name
        _QUERIES[name] = Query(run, text)
        return fn

    return wrap


def all_queries() -> dict[str, Query]:
    for group in GROUPS:
        importlib.import_module(f"tractlens.plans.{group}")
    return dict(_QUERIES)
