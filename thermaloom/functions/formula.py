"""Formulas as chains of named SQL expressions.

A chain is a list of (column, expression) in which later expressions may use the
columns before them. It is a projection for Catalyst (code-generated, no UDF) and,
where a check against another engine is wanted, plain SQL text for that engine.
Decimal literals are written as doubles, so both engines compute alike.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = tuple[str, str]
_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d*)(?![\w.])")


def real(sql: str) -> str:
    """Decimal literals as doubles."""
    return _DECIMAL.sub(lambda m: m[1] + "e0", sql)


def apply(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for name, expression in steps:
        df = df.withColumn(name, F.expr(real(expression)))
    return df


def chain_sql(base: str, steps: Sequence[Step]) -> str:
    """The same chain over a SQL relation."""
    sql = f"select * from ({base}) b"
    for i, (name, expression) in enumerate(steps):
        sql = f"select *, {real(expression)} as {name} from ({sql}) s{i}"
    return sql


def by_itself(expression: str) -> str:
    """The same value, written twice: Spark evaluates what is repeated once, in a method of its own.

    The JVM does not compile methods beyond 8,000 bytes of code; a long polynomial in one piece
    runs ten times slower.
    """
    return f"greatest({expression}, {expression})"


def over(a: str, b: str) -> str:
    """The quotient as floating point has it, for Spark, where ``a / b`` fails if b is 0: infinite, or NaN of 0 by 0; null of null."""
    return f"coalesce(try_divide({a}, {b}), case when ({b}) = 0 then ({a}) * cast('Infinity' as double) end)"


def horner(x: str, coefficients: Sequence[str | float]) -> str:
    """Polynomial with the lowest power first."""
    out = str(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({c} + {x} * {out})"
    return out


def wrap360(x: str) -> str:
    return f"(({x}) - 360.0 * floor(({x}) / 360.0))"
