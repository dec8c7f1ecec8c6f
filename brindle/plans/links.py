"""Queries: published link formats, on the driver's tables in their shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.base import Registry
from brindle.sources import counts as S
from brindle.sources import links as L

R = Registry()


@R.add(
    "g11_gwas_catalog",
    "WITH p AS (SELECT concat(p_size, ':', p_partkey * 100, '-', p_partkey * 100 + 1) AS lhs, p_brand, p_type, p_retailprice AS x FROM part WHERE p_retailprice < 1500) SELECT 'variant:trait' AS relation, lhs, p_type AS rhs FROM p UNION SELECT 'variant:gene', lhs, unnest([lower(p_brand), 'gene2']) FROM p",
)
def gwas_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part")
    rows = p.select(F.concat_ws("", F.lit("chr"), "p_size").alias("CHR_ID"), (F.col("p_partkey") * 100).cast("string").alias("CHR_POS"), F.concat(F.col("p_brand"), F.lit(" - GENE2")).alias("MAPPED_GENE"), F.col("p_retailprice").cast("string").alias("P-VALUE"), F.col("p_type").alias("MAPPED_TRAIT"))
    return L.gwas_catalog(rows.where(F.col("P-VALUE").cast("double") != 1500), 1500.0).select("relation", "lhs", "rhs")


@R.add("g11_gtex", "SELECT DISTINCT 'variant:gene/liver' AS relation, concat(s_nationkey, ':', s_suppkey, '-', s_suppkey + 1) AS lhs, concat('ensg', s_nationkey) AS rhs FROM supplier")
def gtex(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "supplier")
    return L.gtex(s.select(F.concat_ws("_", F.concat(F.lit("chr"), "s_nationkey"), "s_suppkey", F.lit("A"), F.lit("G"), F.lit("b38")).alias("variant_id"), F.concat(F.lit("ENSG"), "s_nationkey", F.lit(".3")).alias("gene_id")), "liver").select("relation", "lhs", "rhs")


@R.add("g11_eqtl", "SELECT concat(l_suppkey % 22 + 1, ':', l_partkey, '-', l_partkey + 1) AS lhs, concat('ensg', l_linenumber) AS rhs, max(l_discount) AS w FROM lineitem WHERE l_discount >= 0.03 GROUP BY 1, 2")
def eqtl(spark: SparkSession, d: str) -> DataFrame:
    l = S.table(spark, d, "lineitem")
    return L.eqtl_catalogue(l.select(F.concat_ws("_", F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1), "l_partkey", F.lit("A"), F.lit("G")).alias("variant"), F.concat(F.lit("ENSG"), "l_linenumber").alias("gene_id"), F.col("l_discount").alias("pip")), 0.03).select("lhs", "rhs", "w")


@R.add("g11_abc", "SELECT concat('region:gene/', replace(c_mktsegment, ' ', '_')) AS relation, concat(c_nationkey, ':', c_custkey + 1, '-', c_custkey + 501) AS lhs, concat('g', c_nationkey) AS rhs, max(c_acctbal / 10000) AS w FROM customer WHERE c_acctbal / 10000 >= 0.02 GROUP BY 1, 2, 3")
def abc(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer")
    return L.abc(c.select(F.concat(F.lit("chr"), "c_nationkey").alias("chr"), F.col("c_custkey").cast("string").alias("start"), (F.col("c_custkey") + 500).cast("string").alias("end"), F.concat(F.lit("G"), "c_nationkey").alias("TargetGene"), F.col("c_mktsegment").alias("CellType"), (F.col("c_acctbal") / 10000).alias("score")))


@R.add("g11_vcf", "SELECT concat(s_nationkey, ':', s_suppkey, '-', s_suppkey + 1) AS lhs, 'height' AS rhs, CAST(s_suppkey AS DOUBLE) AS w FROM supplier WHERE s_suppkey >= 7.30103")
def vcf(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "supplier")
    lines = s.select(F.concat_ws("\t", "s_nationkey", "s_suppkey", F.lit("rs1"), F.lit("A"), F.lit("G"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("ES:SE:LP"), F.concat(F.lit("0.1:0.01:"), "s_suppkey")).alias("value"))
    return L.gwas_vcf(lines, "height").select("lhs", "rhs", "w")


@R.add("g11_positions", "SELECT concat(c_nationkey, ':', c_custkey, '-', c_custkey + 1) AS lhs, c_mktsegment AS rhs, max(c_acctbal) AS w FROM customer WHERE c_acctbal >= 0 GROUP BY 1, 2")
def positions(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer")
    return L.positions(c.select(F.concat(F.lit("chr"), "c_nationkey").alias("chrom"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("trait"), F.col("c_acctbal").alias("weight"))).select("lhs", "rhs", "w")


@R.add("g11_e2g", "SELECT concat('region:gene/', l_returnflag, '/', n_name) AS relation, concat(s_nationkey, ':', s_suppkey, '-', s_suppkey + 200) AS lhs, concat('p', l_linenumber) AS rhs, max(l_tax) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3".replace("n_name)", "replace(n_name, ' ', '_'))"))
def e2g(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "supplier")
    enh = s.select(F.col("s_suppkey").alias("enhancer_id"), F.concat(F.lit("chr"), "s_nationkey").alias("chr"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 200).alias("end"), F.col("s_nationkey").alias("n"))
    pred = S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("enhancer_id"), F.concat(F.lit("P"), "l_linenumber").alias("gene"), F.col("l_returnflag").alias("model"), F.col("l_tax").alias("score")).join(enh.select("enhancer_id", F.col("n").alias("cell_type_id")), "enhancer_id")
    types = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("cell_type_id"), F.col("n_name").alias("name"))
    return L.e2g(pred, enh.drop("n"), types)
