"""Dense named tables: readers that find the name column, writers that refuse non-finite values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.numeric import is_finite
from brindle.sources.manifest import scale


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table whose first string column, wherever it is, is ``name``; the others are doubles."""
    df = spark.read.parquet(path)
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        raise ValueError(f"{path} has no column of names")
    return df.select(F.col(f"`{names[0]}`").alias("name"), *[F.col(f"`{f.name}`").cast("double").alias(f.name) for f in df.schema if f.name != names[0] and not isinstance(f.dataType, T.StringType)])


def read_text(spark: SparkSession, path: str, sep: str = "\t", header: bool | None = None) -> DataFrame:
    """A delimited table: the first column is ``name``; the first row is a header if any field after its first is no number."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    fields = first[0].rstrip("\r").split(sep)

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    header = header if header is not None else not all(number(x) for x in fields[1:])
    columns = fields[1:] if header else [f"c{i}" for i in range(len(fields) - 1)]
    schema = T.StructType([T.StructField("name", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in columns]])
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names, one a line, without blanks and repeats."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name != ''").distinct()


def read_labels(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(cell, label): empty, NA and NaN are null."""
    f = spark.read.text(path).select(F.split("value", sep).alias("f")).where("size(f) >= 2")
    label = F.trim(F.col("f")[1])
    return f.select(F.trim(F.col("f")[0]).alias("cell"), F.when(~label.isin("", "NA", "NaN"), label).alias("label"))


def read_clones(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """``cells`` (name) with ``donor`` and ``stratum`` of a clone table (cell, donor, stratum, ...); unlisted cells have stratum 0."""
    clones = spark.read.option("header", True).option("sep", "\t").csv(path)
    return cells.join(clones.select(F.col("cell").alias("name"), "donor", F.col("stratum").cast("int").alias("s")), "name", "left").withColumn("stratum", F.coalesce("s", F.lit(0))).drop("s")


def write(df: DataFrame, path: str, keep: DataFrame | None = None) -> None:
    """Parquet of a named matrix, of the rows of ``keep`` (name) alone if given; a non-finite value fails the write."""
    if keep is not None:
        df = df.join(keep.select("name"), "name", "left_semi")
    checked = [F.when(F.col(f"`{f.name}`").isNull() | is_finite(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).otherwise(F.raise_error(F.lit(f"{f.name} isn't finite"))).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*checked).write.mode("overwrite").parquet(path)


def melt(df: DataFrame, column: str = "column", value: str = "value") -> DataFrame:
    return df.unpivot(["name"], [c for c in df.columns if c != "name"], column, value)


def detect_scale(df: DataFrame) -> str:
    """What a named matrix holds: log-simplex columns, simplex columns, or signed scores."""
    columns = [c for c in df.columns if c != "name"]
    if not columns:
        return "signed"
    row = df.agg(*[F.sum(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)], *[F.sum(F.exp(f"`{c}`")).alias(f"e{i}") for i, c in enumerate(columns)], *[F.min(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n = range(len(columns))
    if any(row[f"s{i}"] is None for i in n):
        return "signed"
    return scale([row[f"s{i}"] for i in n], [row[f"e{i}"] for i in n], min(row[f"m{i}"] for i in n))
