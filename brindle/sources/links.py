"""Published link formats as edges (relation, lhs, rhs, w): seven presets, told by header or shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import names as N

#: Header columns by which a preset is told (fixed names of the published formats).
HEADERS = {
    "gwas_catalog": {"CHR_ID", "CHR_POS", "MAPPED_GENE", "P-VALUE", "MAPPED_TRAIT"},
    "gtex": {"gene_id", "variant_id"},
    "eqtl_catalogue": {"variant", "gene_id", "pip"},
    "abc": {"chr", "start", "end", "TargetGene", "CellType"},
    "e2g": {"enhancer_id", "gene", "cell_type_id", "model"},
    "positions": {"chrom", "pos", "trait"},
}
#: Least LP (-log10 p) of a GWAS-VCF row that counts.
LP_LEAST = 7.30103


def detect(columns: list[str], first_line: str = "") -> str | None:
    """The preset of a table's columns, or of a file's first line; None if none fits."""
    if first_line.startswith("##fileformat=VCF"):
        return "gwas_vcf"
    have = set(columns)
    fits = [k for k, need in HEADERS.items() if need <= have]
    return max(fits, key=lambda k: len(HEADERS[k])) if fits else None


def _variant(chrom: F.Column, pos: F.Column) -> F.Column:
    """A variant as a region of one base."""
    p = pos.try_cast("long")
    return F.when(p.isNotNull(), F.concat_ws("", N.bare_chromosome(chrom), F.lit(":"), p, F.lit("-"), p + 1))


def gwas_catalog(rows: DataFrame, p_limit: float | None = 5e-8) -> DataFrame:
    """Variant to trait and variant to gene; several loci (``1;1``) and traits (``a, b``) are rows of their own."""
    ok = rows.where(N.p_passes("P-VALUE", p_limit) & F.col("CHR_POS").isNotNull() & (F.col("CHR_POS") != ""))
    at = F.arrays_zip(F.split("CHR_ID", r"\s*;\s*").alias("c"), F.split("CHR_POS", r"\s*;\s*").alias("p"))
    loci = ok.withColumn("l", F.explode(at)).withColumn("lhs", _variant(F.col("l.c"), F.col("l.p"))).where("lhs is not null")
    traits = loci.select(F.lit("variant:trait").alias("relation"), "lhs", F.explode(F.split("MAPPED_TRAIT", r"\s*,\s*")).alias("rhs"))
    genes = loci.select(F.lit("variant:gene").alias("relation"), "lhs", F.explode(N.gene_list("MAPPED_GENE")).alias("rhs")).withColumn("rhs", N.match_key("rhs"))
    return traits.unionByName(genes).where("rhs != ''").distinct().withColumn("w", F.lit(1.0))


def gtex(rows: DataFrame, tissue: str, build: str = "b38", any_build: bool = False) -> DataFrame:
    """Variant to gene in a tissue; variant ids ``chr1_100_A_G_b38`` of another build fail unless allowed."""
    v = F.split("variant_id", "_")
    checked = F.when(F.lit(any_build) | (F.element_at(v, -1) == build), F.col("variant_id")).otherwise(F.raise_error(F.concat(F.lit("another genome build: "), "variant_id")))
    return rows.withColumn("variant_id", checked).select(F.lit(f"variant:gene/{tissue}").alias("relation"), _variant(v[0], v[1]).alias("lhs"), N.match_key(N.strip_version("gene_id")).alias("rhs"), F.lit(1.0).alias("w")).where("lhs is not null").distinct()


def eqtl_catalogue(rows: DataFrame, least: float = 0.0) -> DataFrame:
    """Variant to gene, the posterior inclusion probability as weight; the largest of repeats."""
    v = F.split("variant", "_")
    e = rows.select(_variant(v[0], v[1]).alias("lhs"), N.match_key("gene_id").alias("rhs"), N.parse_weight(F.col("pip").cast("string")).alias("w"))
    return e.where(f"lhs is not null and w is not null and w >= {least}").groupBy("lhs", "rhs").agg(F.max("w").alias("w")).select(F.lit("variant:gene").alias("relation"), "lhs", "rhs", "w")


def abc(rows: DataFrame, least: float = 0.02) -> DataFrame:
    """Enhancer to gene by cell type; BED starts move up by one."""
    score = N.parse_weight(F.col("score").cast("string"))
    region = F.concat_ws("", N.bare_chromosome("chr"), F.lit(":"), F.col("start").try_cast("long") + 1, F.lit("-"), F.col("end").try_cast("long") + 1)
    e = rows.select(F.concat(F.lit("region:gene/"), N.group_token("CellType")).alias("relation"), region.alias("lhs"), N.match_key("TargetGene").alias("rhs"), score.alias("w"))
    return e.where(F.col("w") >= least).groupBy("relation", "lhs", "rhs").agg(F.max("w").alias("w"))


def gwas_vcf(lines: DataFrame, sample: str, least: float = LP_LEAST) -> DataFrame:
    """Variant to trait of text lines ``value``: FORMAT names the place of LP among the sample's values."""
    f = lines.where("value not like '#%'").select(F.split("value", "\t").alias("f")).where("size(f) >= 10")
    lp = F.get(F.split(F.col("f")[9], ":"), F.array_position(F.split(F.col("f")[8], ":"), "LP").cast("int") - 1).try_cast("double")
    return f.select(F.lit("variant:trait").alias("relation"), _variant(F.col("f")[0], F.col("f")[1]).alias("lhs"), F.lit(sample).alias("rhs"), lp.alias("w")).where(f"lhs is not null and w >= {least}").distinct()


def positions(rows: DataFrame) -> DataFrame:
    """``chrom, pos, trait[, weight]``: rows whose position is no number are dropped."""
    w = N.parse_weight(F.col("weight").cast("string")) if "weight" in rows.columns else F.lit(1.0)
    e = rows.select(F.lit("variant:trait").alias("relation"), _variant(F.col("chrom"), F.col("pos").cast("string")).alias("lhs"), F.col("trait").alias("rhs"), w.alias("w"))
    return e.where("lhs is not null and w is not null").groupBy("relation", "lhs", "rhs").agg(F.max("w").alias("w"))


def e2g(predictions: DataFrame, enhancers: DataFrame, cell_types: DataFrame) -> DataFrame:
    """Enhancer to gene of a release's three tables: a relation for each model and cell type."""
    j = predictions.join(enhancers, "enhancer_id").join(cell_types, "cell_type_id")
    region = F.concat_ws("", N.bare_chromosome("chr"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    e = j.select(F.concat_ws("", F.lit("region:gene/"), "model", F.lit("/"), N.group_token("name")).alias("relation"), region.alias("lhs"), N.match_key("gene").alias("rhs"), F.col("score").cast("double").alias("w"))
    return e.groupBy("relation", "lhs", "rhs").agg(F.max("w").alias("w"))


def check_build(found: str | None, wanted: str, allow: bool = False) -> None:
    if found is not None and found != wanted and not allow:
        raise ValueError(f"links are of genome build {found}, not {wanted}")


def membership(spark: SparkSession, path: str) -> DataFrame:
    """``feature label`` rows of a text file, as (set, feature); a first row ``gene label`` is a header."""
    f = spark.read.text(path).where("value not like '#%'").select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) >= 2")
    m = f.select(F.col("f")[1].alias("set"), N.match_key(F.col("f")[0]).alias("feature"))
    return m.where("feature not in ('gene', 'feature')").distinct()


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """``set description feature ...`` rows as (set, feature)."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) >= 3")
    return f.select(F.col("f")[0].alias("set"), F.explode(F.slice("f", 3, F.size("f") - 2)).alias("feature")).where("feature != ''").select("set", N.match_key("feature").alias("feature")).distinct()


def gaf(spark: SparkSession, path: str, without: tuple[str, ...] = ("IEA",)) -> DataFrame:
    """17-column annotation rows as (set, feature), without negated ones and those of the named evidence codes."""
    f = spark.read.text(path).where("value not like '!%'").select(F.split("value", "\t").alias("f")).where("size(f) >= 15")
    ok = f.where(~F.col("f")[6].isin(*without) & ~F.col("f")[3].contains("NOT"))
    return ok.select(N.curie(F.col("f")[4]).alias("set"), N.match_key(F.col("f")[2]).alias("feature")).distinct()
