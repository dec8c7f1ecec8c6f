"""Parts with the number of their supplier, which larger tables have: loops as in SQL."""

from __future__ import annotations

import duckdb
import pytest

from brindle import plans
from tests.compare import assert_same

_LINES = [(1000003, 3, 5.0, "N", "O"), (1000003, 4, 2.0, "R", "F"), (100007, 7, 9.0, "A", "F"), (100007, 7, 1.0, "A", "F"), (8, 7, 4.0, "N", "O")]


@pytest.mark.parametrize("name", ["a16_neighbour_counts", "g2_named_relations"])
def test_loops_stay(spark, tmp_path, name):
    spark.createDataFrame(_LINES, "l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert_same(plans.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(plans.oracle_sql()[name]).df())
