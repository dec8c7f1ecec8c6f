"""Names: canonical keys, loci, suffixes, and the forms in which names are spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCUS = r"^(?:chr)?([0-9]{1,2}|[XYM]|MT)[:_-]([0-9]+)[-_:]([0-9]+)$"
#: An accession with its symbol: the symbol is the key.
ACCESSION = r"^ENS[A-Z]*[0-9]+(?:\.[0-9]+)?_(.+)$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_locus(name: Column | str) -> Column:
    return _c(name).rlike(LOCUS)


def strip_version(name: Column | str) -> Column:
    """``ENSG0001.12`` without its version; other names unchanged."""
    return F.regexp_replace(_c(name), r"^(ENS[A-Z]*[0-9]+)\.[0-9]+", "$1")


def match_key(name: Column | str) -> Column:
    """The key that spellings of a feature share: symbol of an accession pair, lower case; a locus keeps its case."""
    n = F.trim(_c(name))
    symbol = F.regexp_extract(n, ACCESSION, 1)
    return F.when(is_locus(n), n).otherwise(F.lower(F.when(symbol != "", symbol).otherwise(strip_version(n))))


def flexible_key(name: Column | str) -> Column:
    """The fall-back key: letters and digits of the match key."""
    return F.when(is_locus(name), _c(name)).otherwise(F.regexp_replace(match_key(name), "[^a-z0-9]", ""))


def barcode(name: Column | str) -> Column:
    """The text before ``@``."""
    return F.substring_index(_c(name), "@", 1)


def tagged(name: Column | str, tag: Column | str) -> Column:
    return F.concat(_c(name).cast("string"), F.lit("@"), _c(tag).cast("string"))


def curie(term: Column | str) -> Column:
    """``EFO_1`` and a URI that ends so as ``EFO:1``."""
    last = F.regexp_extract(_c(term), r"([^/#]+)$", 1)
    return F.regexp_replace(last, r"^([A-Za-z]+)_([0-9A-Za-z]+)$", "$1:$2")


def gene_list(text: Column | str) -> Column:
    """Genes of ``A - B``, ``A x B``, ``A, B`` and ``A; B``, without blanks."""
    return F.filter(F.split(_c(text), r"\s+-\s+|\s+x\s+|\s*[,;]\s*"), lambda x: F.length(F.trim(x)) > 0)


def group_token(text: Column | str) -> Column:
    """Blanks and slashes as underscores."""
    return F.regexp_replace(F.trim(_c(text)), r"[\s/]+", "_")


def parse_weight(text: Column | str) -> Column:
    """A finite number of at least 0, else null."""
    x = _c(text).try_cast("double")
    return F.when((x >= 0) & (x < F.lit(float("inf"))) & ~F.isnan(x), x)


def p_passes(text: Column | str, limit: float | None) -> Column:
    """Whether a p-value passes; what can't be parsed fails where there is a limit."""
    if limit is None:
        return F.lit(True)
    return F.coalesce(_c(text).try_cast("double") <= limit, F.lit(False))


def bare_chromosome(chrom: Column | str) -> Column:
    return F.regexp_replace(_c(chrom), "^(?i)chr", "")


def natural_key(name: Column | str) -> Column:
    """Sort key under which T2 comes before T10; names without digits last."""
    digits = F.regexp_extract(_c(name), r"([0-9]+)", 1)
    return F.struct((digits == "").alias("none"), digits.try_cast("long").alias("n"), _c(name).alias("s"))
