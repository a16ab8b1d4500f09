"""Queries by name, with the SQL they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is taken")
        self.queries[name] = query
        if oracle:
            # a tile's row is called by, which SQL wants quoted; keywords are in capitals
            self.oracles[name] = re.sub(r'(?<!")\bby\b(?!")', '"by"', oracle)

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.add(name, f, oracle)
            return f

        return keep
