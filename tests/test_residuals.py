"""Residual counts whose fourth place is a tie, which sums of shares miss."""

from __future__ import annotations

from brindle import plans
from brindle.operators import score


def test_ties_of_the_fourth_place_are_exact(spark, tmp_path):
    # customer 1's 31 of part 1, whose total is 32: 31 * (32 + 65 + 13) / (32 * 50) = 2.13125
    held = [(1, 1, 31), (1, 2, 15), (1, 3, 4), (2, 1, 1), (2, 2, 50), (2, 3, 9), (3, 4, 44)]
    spark.createDataFrame([(c, p, float(q)) for c, p, q in held], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(c, c) for c in (1, 2, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in plans.queries()["h10_residuals"](spark, str(tmp_path)).collect()]
    assert got == [(1, 1, 2.1313)]


def test_cells_without_rates_pass_through(spark):
    counts = spark.createDataFrame([(1, 1, 4), (2, 1, 3), (3, 2, 5)], "cell_id long, feature_id long, value long")
    rates = spark.createDataFrame([(1, 1, 2.0), (2, 1, 0.0)], "cell_id long, feature_id long, rate double")
    assert sorted(tuple(r) for r in score.residual_counts(counts, rates).collect()) == [(1, 1, 1.0), (2, 1, 3.0), (3, 2, 5.0)]
