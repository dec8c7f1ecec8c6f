"""The engine's tables on the driver's, as DataFrames and as the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Common table expressions by name; each may use those before it.
CTES = {
    "counts": "SELECT o_custkey AS cell_id, l_partkey AS feature_id, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "cells": "SELECT c_custkey AS cell_id, c_name AS name, c_nationkey AS batch, c_mktsegment AS stratum FROM customer",
    "features": "SELECT p_partkey AS feature_id, p_name AS name, p_brand AS brand, p_type AS type FROM part",
    "latent": "SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS vec, label FROM embeddings",
    "dims": "SELECT id, label, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM latent",
    "composition": "SELECT feature_id, CAST(sum(value) AS DOUBLE) / (SELECT sum(value) FROM counts) AS share FROM counts GROUP BY 1",
    "co": "SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS lhs, greatest(a.l_partkey, b.l_partkey) AS rhs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey",
}


def sql(body: str, *names: str, **more: str) -> str:
    """``body`` under the named expressions, then ``more`` of its own."""
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def drawn_sql(*keys: str, seed: int = 0) -> str:
    """The number that ``functions.numeric.drawn`` gives for these keys."""
    return f"((CAST(('0x' || substr(md5(concat_ws('/', {seed}, {', '.join(keys)})), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


class Registry:
    """Queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = f
            if oracle is not None:
                self.oracles[name] = oracle
            return f

        return keep
