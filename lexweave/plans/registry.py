"""Registry of bound queries and the derived views they read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans.views import VIEWS

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def view_sql(name: str, engine: int) -> str:
    """Text of a view; a pair holds the Spark form and the DuckDB form."""
    text = VIEWS[name]
    return text if isinstance(text, str) else text[engine]


class Inputs:
    """Attribute access to the driver's tables and to the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        names = sorted(set(re.findall(r"\{(\w+)\}", text)))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self.sql(view_sql(name, 0))
        raise AttributeError(name)


@dataclass(frozen=True)
class Bound:
    name: str
    covers: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None


REGISTRY: dict[str, Bound] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``build(inputs)`` under ``name``; ``sql`` is its DuckDB twin."""

    def add(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Bound(name, covers, build, sql)
        return build

    return add


def _needed(text: str, found: dict[str, None]) -> None:
    for name in re.findall(r"\bv_\w+", text):
        if name in VIEWS and name not in found:
            _needed(view_sql(name, 1), found)
            found[name] = None


def with_views(sql: str) -> str:
    """Prefix a check query with the derived views it names, in order."""
    found: dict[str, None] = {}
    _needed(sql, found)
    if not found:
        return sql
    ctes = ",\n".join(
        f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', view_sql(n, 1))})" for n in found
    )
    body = sql.strip()
    recursive = ""
    if body[:15].upper() == "WITH RECURSIVE ":
        recursive, body = "RECURSIVE ", "WITH " + body[15:]
    if body[:5].upper() == "WITH ":
        return f"WITH {recursive}{ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
