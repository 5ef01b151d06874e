"""Registered queries: a Spark plan over the given tables, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from recut.session import ship

Plan = Callable[["Tables"], DataFrame]


class Tables:
    """The given tables and the domain views derived from them, read lazily."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        from recut.queries import domain

        view = getattr(domain, name, None)
        if callable(view):
            return view(self)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


@dataclass
class Registry:
    plans: dict[str, Plan] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)
    covers: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def register(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"duplicate query {name}")
            self.plans[name] = plan
            self.covers[name] = covers
            if sql is not None:
                self.sql[name] = sql
            return plan

        return register


REGISTRY = Registry()
query = REGISTRY.query


def ctes(*parts: str) -> str:
    """WITH clause from the SQL twins of the domain views; recursive views are allowed."""
    return "WITH RECURSIVE " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"
