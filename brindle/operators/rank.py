"""Ranks, quantiles, order, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numeric import drawn


def top_k(rows: DataFrame, by: list[str], value: str, k: int, tie: str) -> DataFrame:
    """The k largest of each group (of all rows without ``by``), ties to the lower ``tie``."""
    if not by:
        return rows.orderBy(F.desc(value), tie).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def placed(rows: DataFrame, value: str, *ties: str, parts: int = 64) -> DataFrame:
    """The rows with ``__place``, from 0, in order of a number and ``ties``; rows without the number are left out.

    No task sorts all rows: they are dealt to ranges between approximate quantiles, numbered within each, and each range starts where those
    before it end. A range's rows sort in one task, equal numbers in one range.
    """
    live = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    found = live.agg(F.percentile_approx(F.col(value), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = sorted(set(found))
    part = F.lit(0)
    for b in bounds:
        part = part + (F.col(value) > F.lit(b)).cast("int")
    dealt = live.withColumn("__part", part)
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # ``parts`` rows at most
    before, starts = 0, []
    for i in range(len(bounds) + 1):
        starts.append(F.lit(before).cast("long"))
        before += sizes.get(i, 0)
    own = F.row_number().over(Window.partitionBy("__part").orderBy(value, *ties)) - 1
    return dealt.withColumn("__place", own + F.element_at(F.array(*starts), F.col("__part") + 1)).withColumn("__n", F.lit(before).cast("long")).drop("__part")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    order, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return rows.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def agreement(pairs: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """Spearman (average ranks) and Pearson on ln(1 + value) of each group; null where a side is constant."""
    r = average_ranks(average_ranks(pairs, [by], x, "__rx"), [by], y, "__ry")
    return r.groupBy(by).agg(corr("__rx", "__ry").alias("spearman"), corr(F.log1p(x), F.log1p(y)).alias("pearson_log1p"))


def corr(x, y):  # noqa: ANN001, ANN201
    """Pearson from sums; null instead of NaN."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    n, sx, sy = F.count(x).cast("double"), F.sum(x.cast("double")), F.sum(y.cast("double"))
    vx, vy = F.sum(x * x) - sx * sx / n, F.sum(y * y) - sy * sy / n
    return F.when((vx > 1e-9) & (vy > 1e-9), (F.sum(x * y) - sx * sy / n) / F.sqrt(vx * vy))


def nearest_rank(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The element at place ``round(q * (n - 1))`` of each group's sorted values."""
    if not by:
        r = placed(rows, value)
        return r.where(F.col("__place") == F.floor(F.lit(q) * (F.col("__n") - 1) + 0.5)).select(F.col(value).alias("quantile"))
    order, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    r = rows.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(order) - 1).withColumn("__n", F.count(F.lit(1)).over(whole))
    return r.where(F.col("__r") == F.floor(F.lit(q) * (F.col("__n") - 1) + 0.5)).select(*by, F.col(value).alias("quantile"))


def ramp_bounds(rows: DataFrame, by: list[str], value: str, counts: bool, low: float = 0.02, high: float = 0.99) -> DataFrame:
    """(by, lo, hi): the elements at places ``floor((n - 1) p)``; lo is 0 for counts."""
    order, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    r = rows.withColumn("__r", F.row_number().over(order) - 1).withColumn("__n", F.count(F.lit(1)).over(whole))
    at = lambda p: F.max(F.when(F.col("__r") == F.floor((F.col("__n") - 1) * F.lit(p)), F.col(value)))
    return r.groupBy(*by).agg((F.lit(0.0) if counts else at(low)).alias("lo"), at(high).alias("hi"))


def grid_quantile(mass: DataFrame, by: list[str], position: str, weight: str, q: float) -> DataFrame:
    """First position at which the cumulative share of mass reaches q."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    c = mass.withColumn("__c", F.sum(weight).over(w) / F.sum(weight).over(Window.partitionBy(*by)))
    return c.where(F.col("__c") >= q - 1e-12).groupBy(*by).agg(F.min(position).alias("position"))


def deal_folds(cells: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """Cells of a batch dealt to folds round by round, each round from its own place, by hash."""
    r = F.row_number().over(Window.partitionBy("batch").orderBy("cell_id")) - 1
    shift = F.pmod(F.xxhash64(F.col("batch"), F.floor(F.col("__r") / folds), F.lit(seed)), F.lit(folds))
    return cells.withColumn("__r", r).withColumn("fold", F.pmod(F.col("__r") + shift, F.lit(folds)).cast("int")).drop("__r")


def landmarks(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by least number drawn for their key: alike on every run."""
    return rows.orderBy(drawn(key, seed=seed), key).limit(n)


def roles(rows: DataFrame, key: str, parts: int, seed: int = 0) -> DataFrame:
    """Disjoint parts of about equal size, by hash of the key."""
    return rows.withColumn("role", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(parts)).cast("int"))


def hold_out(rows: DataFrame, keys: list[str], share: float, seed: int = 0) -> DataFrame:
    """``held``: whether the number drawn for a row's keys lies under ``share``."""
    return rows.withColumn("held", drawn(*keys, seed=seed) < share)


def natural_order(rows: DataFrame, name: str) -> DataFrame:
    """``place`` of each distinct name in natural order."""
    from brindle.functions.names import natural_key

    return rows.select(name).distinct().withColumn("place", F.row_number().over(Window.orderBy(natural_key(name))))
