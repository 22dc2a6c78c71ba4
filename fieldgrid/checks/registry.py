"""Named queries with, where SQL can say it, an equivalent statement over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_BODIES: dict[str, tuple[str, list[str]]] = {}
CTES: dict[str, str] = {}

# Both engines round with the same arithmetic, in doubles throughout, so NaN, infinities and large values stay what they
# are.  The offset keeps averages of prices with two decimals, which often lie exactly between two results, from being
# decided by the last bit of a sum.
_SCALE = "1e6"
_OFFSET = "1e-4"


def rounded(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.expr(f"rint(`{f.name}` * {_SCALE}D + {_OFFSET}D) / {_SCALE}D").alias(f.name)
        out.append(c)
    return df.select(*out)


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needed(sql: str, seen: list[str]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)


def statement(body: str, doubles: Sequence[str] = ()) -> str:
    """The body with the views it uses, its double columns rounded as on the Spark side."""
    names: list[str] = []
    _needed(body, names)
    views = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    head = f"WITH {views}\n" if views else ""
    if doubles:
        cols = ", ".join(f'round_even("{c}" * {_SCALE} + {_OFFSET}, 0) / {_SCALE} AS "{c}"' for c in doubles)
        return f"{head}SELECT * REPLACE ({cols}) FROM (\n{body.strip()}\n)"
    return f"{head}{body.strip()}"


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(spark, sf_dir)``; ``doubles`` lists the double columns of ``sql``, separated by blanks."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            _BODIES[name] = (sql, doubles.split())
        return fn

    return add


def oracles() -> dict[str, str]:
    """SQL texts, built once every view is known."""
    return {name: statement(sql, doubles) for name, (sql, doubles) in _BODIES.items()}
