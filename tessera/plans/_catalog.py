"""What the query modules share: the register, and literal tables and rule chains in both dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


class Register:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(fn):
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return add


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(quoted, value)) + "]"
    if isinstance(value, bool) or not isinstance(value, str):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


class Literal:
    """A small fixed table of cases that none of the driver's tables holds, followed by rows of a given table.

    ``given`` is a table's name and an expression for each column, in words that both dialects read; an array is written ``[a, b]``.
    """

    def __init__(self, name: str, schema: str, rows: list[tuple], given: tuple[str, list[str]] | None = None) -> None:
        self.name, self.schema, self.rows, self.given = name, schema, rows, given

    def frame(self, spark: SparkSession, sf: str | None = None) -> DataFrame:
        cases = spark.createDataFrame(self.rows, self.schema)
        if self.given is None:
            return cases
        columns = [f"array({c[1:-1]})" if c.startswith("[") else c for c in self.given[1]]
        return cases.union(table(spark, sf, self.given[0]).selectExpr(*columns))

    @property
    def sql(self) -> str:
        """The table as a common table expression."""
        columns = ", ".join(c.split()[0] for c in self.schema.split(", "))
        more = f" UNION ALL SELECT {', '.join(self.given[1])} FROM {self.given[0]}" if self.given else ""
        return f"{self.name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in self.rows)}{more})"


def chain(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Replace each pattern in turn; groups are written ``\\1``."""
    for pattern, new in rules:
        col = F.regexp_replace(col, F.lit(pattern), F.lit(new.replace("$", "\\$").replace("\\1", "$1").replace("\\2", "$2")))
    return col


def chain_sql(expr: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return expr


def case_sql(cases: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"
