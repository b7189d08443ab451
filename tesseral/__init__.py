"""Spark-first analytics engine: a SQL dialect front end, DataFrame operators and corpus tools."""

from tesseral.session import Engine, get_session

__all__ = ["Engine", "get_session"]
