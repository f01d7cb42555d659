"""Registry of queries. One column list drives both the Spark projection and the SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilens.sources.held import let_go

Build = Callable[["SparkSession", str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"s": "string", "l": "bigint", "d": "double", "b": "boolean"}
_SQL = {"s": "VARCHAR", "l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}


def _columns(spec: str) -> list[tuple[str, str]]:
    out = []
    for part in spec.replace(",", " ").split():
        name, _, kind = part.partition(":")
        out.append((name, kind or "s"))
    return out


def query(name: str, cols: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``name``. ``cols`` is ``"speaker n:l p:d ok:b"``; doubles are rounded to 6 places."""
    columns = _columns(cols)

    def wrap(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_go(spark)
            df = build(spark, sf_dir)
            shaped = []
            for c, kind in columns:
                col = F.col(c).cast(_SPARK[kind])
                if kind == "d":
                    col = F.round(col, 6) + F.lit(0.0)
                shaped.append(col.alias(c))
            return df.select(*shaped)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            shaped = []
            for c, kind in columns:
                e = f"{c}::{_SQL[kind]}"
                if kind == "d":
                    e = f"round({e}, 6) + 0.0::DOUBLE"
                shaped.append(f"{e} AS {c}")
            ORACLES[name] = f"SELECT {', '.join(shaped)} FROM ({sql.strip()}) AS checked"
        return build

    return wrap
