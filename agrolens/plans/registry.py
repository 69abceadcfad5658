"""Name -> (Spark plan builder, DuckDB oracle SQL) registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from agrolens.functions.rules_sql import RuleText
from agrolens.plans import sqltext as Q
from agrolens.session import compiled

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

PRES = 9  # decimals used to present floats that a rule itself leaves unrounded

_SPARK = RuleText("spark")


def bigint_counts(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; wrap each call so it is BIGINT like
    Spark's.  (Parenthesis matching on the generated text.)"""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(count_if(" + bigint_counts(sql[j + len(key):k]) + " AS BIGINT)")
        i = k


def register(name: str, sql: str | None = None):
    """Register a builder; ``sql`` = its DuckDB twin (None -> rows-only check)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def build(spark: SparkSession, sf: str) -> DataFrame:
            return fn(compiled(spark), sf)
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = bigint_counts(sql)
        return fn
    return deco


def sp_round(x: str, n: int = PRES) -> str:
    """Spark SQL text: numpy-style rounding."""
    return _SPARK.rnd(x, n)


def dk_round(x: str, n: int = PRES) -> str:
    """DuckDB text: numpy-style rounding."""
    return Q.rnd(x, n)
