"""Queries given as a pair of SQL texts: the dialect's, run through the front end, and the oracle's."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tesseral.plans.planner import plan
from tesseral.session import DEFAULT_AS_OF
from tesseral.sources.readers import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings customers concerts ticket_orders order_items payments refunds dim_customer_city seat_inventory late_orders city_changes pack_sizes"
).split()


def used_tables(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def run_sql(spark: SparkSession, folder: str, sql: str, as_of: datetime | None = DEFAULT_AS_OF) -> DataFrame:
    """Run one query of the dialect over the Parquet tables of a folder; only the tables it names are registered."""
    for t in used_tables(sql):
        table(spark, folder, t).createOrReplaceTempView(t)
    return plan(spark, sql, as_of)


class Book:
    """A collection of queries with their oracle SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, dialect: str, oracle: str | None = "") -> None:
        """``oracle`` is the same text unless given; None: SQL has no equal."""
        self.queries[name] = lambda spark, d: run_sql(spark, d, dialect)
        if oracle is not None:
            self.oracle[name] = oracle or dialect

    def df(self, name: str, oracle: str | None = None):
        """A decorator for a query in the DataFrame API."""

        def add(f):
            self.queries[name] = f
            if oracle is not None:
                self.oracle[name] = oracle
            return f

        return add
