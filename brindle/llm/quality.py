"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, runs of blanks one space, trimmed) and hashed. For each host
(``source``) the operator counts the distinct documents that hold a line; exact copies of a
text count once. A line that stands in more than ``most`` documents of a host is removed, whatever its length and
however large the host. A document that loses more than ``max_removed`` of its
words is depleted and rejected, as is one that fails the base rules (under 50 words, or over
half of its words in 3-word windows found twice or more).

Defined results: null text counts as empty (no words, base_failed); a null source is a host of
its own; repeated rows have a row each, with equal verdicts; rows that differ in text but not in id
are judged apart; an empty table gives an empty result; further columns are ignored by
``verdicts`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import materialize, packed, table

MOST, MAX_REMOVED = 10, 0.5
#: Bits that hold a word position beside a window's hash while windows are sorted.
_POS = 28

_BLANK = r"[\\x20\\x09-\\x0D]+"
_NORMAL = f"lower(trim(regexp_replace(x, '{_BLANK}', ' ')))"


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest, the counts of the base rules, and ``lines``: hash and words of each line."""
    d = docs.select("doc_id", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", "source", "text", F.expr(f"filter(split(text, '{_BLANK}'), x -> x != '')").alias("w"), F.expr("filter(split(text, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("l"))
    d = d.select(
        "doc_id",
        "source",
        F.md5("text").alias("digest"),
        F.size("w").cast("long").alias("n_words"),
        F.expr(f"cast(length(regexp_replace(text, '{_BLANK}', '')) as long)").alias("word_chars"),
        F.expr("cast(length(regexp_replace(text, '[^#*$%&|<>]+', '')) as long)").alias("n_symbols"),
        F.expr("cast(size(l) - size(array_distinct(l)) as long)").alias("n_dup_lines"),
        F.expr(f"transform(transform(l, x -> {_NORMAL}), x -> struct(xxhash64(x) as h, cast(size(split(x, ' ')) as long) as n))").alias("lines"),
        "w",
        # window hash above, position of its first word below, sorted: equal windows stand together
        F.expr(f"case when size(w) > 3 then sort_array(transform(sequence(0, size(w) - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & {-(1 << _POS)}L) | i)) else cast(array() as array<bigint>) end").alias("g"),
    )
    # windows whose truncated hash another has; few, so these are compared by full hash and words
    d = d.withColumn("c", F.expr(f"case when size(g) > 1 then filter(sequence(1, size(g) - 1), i -> shiftright(g[i], {_POS}) = shiftright(g[i - 1], {_POS})) else cast(array() as array<int>) end"))
    at = f"cast(x & {(1 << _POS) - 1}L as int)"
    d = d.withColumn("c", F.expr(f"case when size(c) > 0 then transform(array_distinct(flatten(transform(c, i -> array(g[i - 1], g[i])))), x -> {at}) else cast(array() as array<int>) end"))
    d = d.withColumn("c", F.expr("case when size(c) > 0 then array_sort(transform(c, i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i))) else cast(array() as array<struct<h: bigint, i: int>>) end"))
    same = "({a}.h = {b}.h and w[{a}.i] = w[{b}.i] and w[{a}.i + 1] = w[{b}.i + 1] and w[{a}.i + 2] = w[{b}.i + 2])"
    near = f"(k > 0 and {same.format(a='x', b='c[greatest(k - 1, 0)]')}) or (k < size(c) - 1 and {same.format(a='x', b='c[least(k + 1, size(c) - 1)]')})"
    d = d.withColumn("c", F.expr(f"filter(c, (x, k) -> {near})"))
    d = d.withColumn("n_repeat_words", F.expr("cast(size(array_distinct(flatten(transform(c, x -> array(x.i, x.i + 1, x.i + 2))))) as long)"))
    return d.select("doc_id", "source", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines")


def _failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def frequent_lines(features: DataFrame, most: int = MOST) -> DataFrame:
    """(source, h, n_docs) of the lines that stand in more than ``most`` distinct documents of their host."""
    once = features.select("source", "digest", "lines").dropDuplicates(["source", "digest"])
    held = once.select("source", F.explode(F.expr("array_distinct(transform(lines, x -> x.h))")).alias("h"))
    return held.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > most)


def verdicts(docs: DataFrame, most: int = MOST, max_removed: float = MAX_REMOVED) -> DataFrame:
    """A row for each document: the base counts, removed_words, removed (line hashes), base_failed and kept."""
    t = materialize(base_features(docs).withColumn("rid", F.monotonically_increasing_id()), "quality")
    bad = frequent_lines(t, most).select(F.col("source").alias("host"), F.col("h").alias("bad"))
    lines = t.select("rid", "source", F.explode("lines").alias("x")).select("rid", "source", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    gone = (
        lines.groupBy("rid", "source", "h").agg(F.sum("n").alias("n"))
        .join(bad, F.col("source").eqNullSafe(F.col("host")) & (F.col("h") == F.col("bad")))
        .groupBy("rid").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("removed"))
    )
    judged = t.drop("lines").join(gone, "rid", "left")
    judged = judged.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("base_failed", _failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words"))).drop("rid")


def clean(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that are kept, without their frequent lines; ``n_chars`` follows the text."""
    v = verdicts(docs, **limits)
    changed = v.where(~F.col("kept") | (F.col("removed_words") > 0)).select("doc_id", "source", "digest", "kept", "removed").dropDuplicates(["doc_id", "source", "digest"])
    digest = F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    joined = packed(docs).join(changed, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (digest == F.col("digest")), "left").where(F.coalesce("kept", F.lit(True)))
    rest = F.expr(f"array_join(filter(split(row.text, '\\n', -1), x -> not array_contains(removed, xxhash64({_NORMAL}))), '\\n')")
    text = F.when(F.size("removed") > 0, rest).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.size("removed") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars")))
    return joined.select(row.alias("row")).select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), tokens AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)
), grams AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS n FROM grams WHERE w2 IS NOT NULL
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, text, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
         CAST(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM lines GROUP BY doc_id
), frequent AS (
  SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT text) > {MOST}
), gone AS (
  SELECT l.doc_id, CAST(sum(l.n) AS BIGINT) AS removed_words
  FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY l.doc_id
), b AS (
  SELECT d.doc_id, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= {MAX_REMOVED} * n_words AS kept
FROM b
"""
