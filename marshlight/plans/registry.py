"""Query registry: a Spark callable and, where SQL can say it, an equal ANSI text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .roles import ROLE_SQL, Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    out: str
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(self.build(Tables(spark, sf_dir)), self.out)

    def oracle(self) -> str | None:
        return None if self.sql is None else shape_sql(self.sql, self.out)


QUERIES: dict[str, Query] = {}


def query(name: str, out: str, sql: str | None = None):
    """Register a query. ``out`` lists result columns as ``name:kind``.

    Kinds: s text, i integer, f double rounded to 6 places, d date, t timestamp (both as text),
    b boolean. The same list shapes both sides, so names and types cannot drift apart.
    """

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, out, sql)
        return fn

    return add


def _fields(out: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in out.split()]


def shape(df: DataFrame, out: str) -> DataFrame:
    cols = []
    for name, kind in _fields(out):
        c = F.col(name)
        if kind == "s":
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "f":
            number = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
            c = F.round(number, 6) + 0.0  # no negative zero
        elif kind == "d":
            c = F.date_format(c.cast("date"), "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        elif kind == "b":
            c = c.cast("boolean")
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(sql: str, out: str) -> str:
    cols = []
    for name, kind in _fields(out):
        c = f'"{name}"'
        c = {
            "s": f"CAST({c} AS VARCHAR)",
            "i": f"CAST({c} AS BIGINT)",
            "f": f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE round(CAST({c} AS DOUBLE), 6) + 0e0 END",
            "d": f"strftime(CAST({c} AS DATE), '%Y-%m-%d')",
            "t": f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')",
            "b": f"CAST({c} AS BOOLEAN)",
        }[kind]
        cols.append(f'{c} AS "{name}"')
    return f"WITH RECURSIVE {role_ctes(sql)}_q AS (\n{sql.strip()}\n)\nSELECT {', '.join(cols)} FROM _q"


def role_ctes(sql: str) -> str:
    """The role definitions a text refers to, with those they build on, in order."""
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for role, body in ROLE_SQL.items():
            if role not in need and re.search(rf"\b{role}\b", text):
                need.add(role)
                todo.append(body)
    return "".join(f"{r} AS (\n{ROLE_SQL[r].strip()}\n),\n" for r in ROLE_SQL if r in need)
