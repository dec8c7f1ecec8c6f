"""Functions of ARRAY<DOUBLE> columns, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def total(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def sq_dist(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 where either is (nearly) zero."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-12, dot(a, b) / n).otherwise(0.0)


def unit(v: Column | str, floor: float = 1e-12) -> Column:
    """The vector over its length; unchanged where that is (nearly) zero."""
    n = norm(v)
    return F.when(n > floor, F.transform(_c(v), lambda x: x / n)).otherwise(_c(v))


def softmax(v: Column | str) -> Column:
    """Softmax less the maximum; all zeros where no maximum is finite or a value is NaN."""
    top = F.array_max(_c(v))
    e = F.transform(_c(v), lambda x: F.exp(x - top))
    s = total(e)
    bad = top.isNull() | F.isnan(top) | (F.abs(top) == F.lit(float("inf"))) | F.isnan(s)
    return F.when(bad, F.transform(_c(v), lambda x: F.lit(0.0))).otherwise(F.transform(e, lambda x: x / s))


def log_sum_exp(v: Column | str) -> Column:
    top = F.array_max(_c(v))
    return top + F.log(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def log_softmax(v: Column | str) -> Column:
    z = log_sum_exp(v)
    return F.transform(_c(v), lambda x: x - z)


def hellinger(v: Column | str) -> Column:
    return F.transform(_c(v), lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Shared mass of two compositions."""
    return total(F.zip_with(_c(a), _c(b), lambda x, y: F.least(x, y)))


def quadratic(v: Column | str, m: Column | str) -> Column:
    """``v' M v`` with M as an array of rows."""
    return total(F.zip_with(_c(v), _c(m), lambda x, row: x * F.aggregate(F.zip_with(row, _c(v), lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)))


def entropy(p: Column | str) -> Column:
    return F.aggregate(_c(p), F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))


def argmax(v: Column | str) -> Column:
    """Place of the largest value, the first of equals, from 0."""
    return F.array_position(_c(v), F.array_max(_c(v))).cast("int") - 1


def sparsemax(v: Column | str) -> Column:
    """The nearest point of the simplex: the vector less a threshold, floored at 0, so that small entries are exactly 0. Null for an empty vector."""
    v = _c(v)
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("over"), F.lit(1).alias("k"))

    def step(s: Column, x: Column) -> Column:
        total, n = s["sum"] + x, s["n"] + 1
        more = 1 + n * x > total
        return F.struct(total.alias("sum"), n.alias("n"), F.when(more, total).otherwise(s["over"]).alias("over"), F.when(more, n).otherwise(s["k"]).alias("k"))

    cut = F.aggregate(F.reverse(F.array_sort(v)), none, step, lambda s: (s["over"] - 1) / s["k"])
    return F.when(F.size(v) > 0, F.transform(v, lambda x: F.greatest(x - cut, F.lit(0.0))))
