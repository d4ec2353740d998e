"""Registry of named queries and the SQL that checks each of them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestline.session import configure
from harvestline.sources import bindings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
# the same queries without the rounding that only comparisons need
PLAIN: dict[str, Query] = {}
SQL: dict[str, str] = {}
# the statements as written, and the digits they round to
CHECKS: dict[str, str | None] = {}
ROUNDED: dict[str, int] = {}
# named SQL fragments other checks build on; bindings are added on demand
VIEWS: dict[str, str] = {}


class Tables:
    """Lazy access to the bound tables of one data folder: `t.inventory_events`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.views: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in bindings.BINDINGS:
            raise AttributeError(name)
        table = bindings.load(self.spark, self.folder, name)
        setattr(self, name, table)
        return table


def shared(view: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Build a view once per query, however many parts of the query use it."""
    @wraps(view)
    def once(t: Tables) -> DataFrame:
        if view.__name__ not in t.views:
            t.views[view.__name__] = view(t)
        return t.views[view.__name__]

    return once


def query(key: str, sql: str | None = None, round_to: int = 6):
    """Register `fn(tables) -> DataFrame` under `key`.

    Computed doubles are rounded on both sides, so that summation order and the last bit
    of a library function do not count as differences.
    """

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")

        @wraps(fn)
        def plain(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return comparable(plain(spark, folder), round_to)

        PLAIN[key], QUERIES[key] = plain, run
        CHECKS[key], ROUNDED[key] = sql, round_to
        if sql is not None:
            SQL[key] = _complete(sql, round_to)
        return fn

    return register


def sql_id(prefix: str, *parts: str) -> str:
    """SQL of `functions.text.stable_id` over SQL expressions."""
    marked = " || ".join(
        f"coalesce(length(cast({p} AS varchar)) || ':' || cast({p} AS varchar), '-')" for p in parts)
    return f"'{prefix}-' || upper(substr(sha256({marked}), 1, 32))"


def comparable(df: DataFrame, digits: int) -> DataFrame:
    """Round doubles, drop negative zeros, give timestamps without a zone."""

    def column(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c, digits)
            return F.when(c == 0, F.lit(0.0)).otherwise(c).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(field.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def _complete(sql: str, digits: int) -> str:
    """Prefix the fragments a statement uses and round its doubles."""
    needed: dict[str, str] = {}
    active: set[str] = set()  # a recursive fragment names itself

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in needed or word in active:
                continue
            body = VIEWS.get(word) or (
                bindings.duck_sql(word) if word in bindings.BINDINGS else None)
            if body is None or body == text:
                continue
            active.add(word)
            visit(body)
            needed[word] = body

    visit(sql)
    parts = [f"{name} AS ({body})" for name, body in needed.items()]
    parts.append(f"answer AS ({sql})")
    return _expand_round(
        f"WITH RECURSIVE {', '.join(parts)} SELECT * FROM answer", digits)


def _expand_round(sql: str, digits: int) -> str:
    """Write `R(x)` out as `x` rounded, with zero unsigned."""
    while (found := re.search(r"\bR\(", sql)) is not None:
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        value = sql[found.end():end - 1]
        rounded = f"round(cast({value} as double), {digits})"
        sql = (f"{sql[:found.start()]}(case when {rounded} = 0 then cast(0 as double) "
               f"else {rounded} end){sql[end:]}")
    return sql
