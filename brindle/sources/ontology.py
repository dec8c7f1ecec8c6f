"""Ontologies in OBO text, cut into stanzas by Spark; their hierarchy among the terms of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import names as N
from brindle.operators.align import present_hierarchy


def _canonical(term: Column) -> Column:
    """``efo:EFO_1``, ``EFO_1`` and a URI that ends so as ``EFO:1``."""
    return N.curie(F.regexp_replace(term, r"^\w+:(?=[A-Za-z]+_\w+$)", ""))


def _tags(name: str) -> Column:
    """Values of a tag's lines in ``lines``, trailing comments and modifiers off."""
    own = F.filter("lines", lambda x: x.startswith(f"{name}:"))
    return F.transform(own, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.substring(x, len(name) + 2, 1 << 30), r"\s+!.*$", ""), r"\s*\{[^}]*\}\s*$", "")))


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(kind, lines): the file cut at blank lines; the header and stanzas that aren't in brackets have no row."""
    # an ontology's file is some tens of megabytes, and is a row
    raw = spark.read.text(path, wholetext=True)
    parts = raw.select(F.explode(F.split(F.regexp_replace("value", "\r", ""), r"\n\s*\n")).alias("s"))
    lines = F.filter(F.transform(F.split("s", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("!"))
    return parts.select(lines.alias("lines")).where("size(lines) > 1").select(F.regexp_extract(F.get("lines", F.lit(0)), r"^\[(\w+)\]$", 1).alias("kind"), "lines").where("kind != ''")


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, name, definition, obsolete) of an OBO file's terms, ids in canonical spelling; of a repeated id the first by name."""
    t = stanzas(spark, path).where("kind = 'Term'")
    rows = t.select(
        _canonical(F.get(_tags("id"), F.lit(0))).alias("term"), F.get(_tags("name"), F.lit(0)).alias("name"), F.regexp_extract(F.get(_tags("def"), F.lit(0)), r'^"((?:[^"\\]|\\.)*)"', 1).alias("definition"),
        F.coalesce(F.get(_tags("is_obsolete"), F.lit(0)) == "true", F.lit(False)).alias("obsolete"),
    ).where("term IS NOT NULL AND term != ''")
    return rows.withColumn("definition", F.when(F.col("definition") != "", F.col("definition"))).groupBy("term").agg(F.min_by(F.struct("name", "definition", "obsolete"), F.coalesce("name", F.lit(""))).alias("t")).select("term", "t.*")


def hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent, relation): is_a and part_of edges of terms that aren't obsolete, each once."""
    t = stanzas(spark, path).where("kind = 'Term'").select(_canonical(F.get(_tags("id"), F.lit(0))).alias("child"), _tags("is_a").alias("is_a"), _tags("relationship").alias("other"), F.get(_tags("is_obsolete"), F.lit(0)).alias("gone")).where("gone IS NULL OR gone != 'true'")
    is_a = t.select("child", F.explode("is_a").alias("parent"), F.lit("is_a").alias("relation"))
    part_of = t.select("child", F.explode(F.filter("other", lambda x: x.startswith("part_of "))).alias("p")).select("child", F.regexp_replace("p", r"^part_of\s+", "").alias("parent"), F.lit("part_of").alias("relation"))
    # an id ends at the first blank
    return is_a.union(part_of).select("child", _canonical(F.get(F.split("parent", r"\s+"), F.lit(0))).alias("parent"), "relation").where("child != parent").distinct()


def term_edges(edges: DataFrame, present: DataFrame) -> DataFrame:
    """(child, parent, relation) among the terms that a graph holds (term)."""
    return edges.join(present_hierarchy(edges.select("child", "parent"), present), ["child", "parent"], "left_semi")


def filled_texts(known: DataFrame, ontology: DataFrame) -> DataFrame:
    """(term, name, definition): what is known of a term, and only where that is missing the ontology's."""
    o = ontology.select("term", F.col("name").alias("n"), F.col("definition").alias("d"))
    return known.join(o, "term", "left").select("term", F.coalesce("name", "n").alias("name"), F.coalesce("definition", "d").alias("definition"))
