"""A module's queries: name -> function, and SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import oracle, relation


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, reads: str, sql: str | None = None, relations: str | None = None):
        """Registers f(tables...) under its name; reads: the relations it is given; relations: those that sql reads, if others."""

        def add(f):
            names = reads.split()

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(*[relation(spark, sf_dir, n) for n in names])

            self.queries[f.__name__] = run
            if sql is not None:
                from .fixtures import RELATIONS

                needs = [n for n in (relations.split() if relations is not None else names) if n in RELATIONS]
                self.sql[f.__name__] = oracle(sql, *needs) if needs else sql.strip()
            return f

        return add
