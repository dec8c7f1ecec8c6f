"""Queries: model fits and what is read out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import aggregate, bilinear, collapse, decoders, encoders, factored, flow, inference, kinetics, laplace, models, typed
from brindle.plans.base import Registry, drawn_sql, sql
from brindle.sources import counts as S

R = Registry()


def _pb(spark: SparkSession, d: str) -> DataFrame:
    s, _ = collapse.pseudobulk(S.customer_counts(spark, d), S.customer_cells(spark, d).select("cell_id", F.col("batch").alias("pb")))
    return s


@R.add("m3_topics")
def topics(spark: SparkSession, d: str) -> DataFrame:
    return models.topic_model(S.customer_counts(spark, d), 5, 5)[0]


def _encoder(spark: SparkSession, d: str, **options) -> DataFrame:  # noqa: ANN003
    return encoders.transform(*encoders.fit(_pb(spark, d), 5, 32, epochs=40, **options), S.customer_counts(spark, d))


@R.add("m4_masked_topic")
def masked_topic(spark: SparkSession, d: str) -> DataFrame:
    return _encoder(spark, d, head="softmax", mask=0.3)


@R.add("m4_masked_sbp")
def masked_sbp(spark: SparkSession, d: str) -> DataFrame:
    return _encoder(spark, d, head="stick", mask=0.3)


@R.add("m4_masked_vae")
def masked_vae(spark: SparkSession, d: str) -> DataFrame:
    return _encoder(spark, d, head="raw", mask=0.3)


@R.add("m5_raw_encoder")
def raw_encoder(spark: SparkSession, d: str) -> DataFrame:
    return _encoder(spark, d, head="raw")


@R.add("m5_vae")
def vae(spark: SparkSession, d: str) -> DataFrame:
    return _encoder(spark, d, head="gaussian")


@R.add("m11_kinetic_rates")
def kinetic_rates(spark: SparkSession, d: str) -> DataFrame:
    return kinetics.fit(kinetics.split_tracks(_two_tracks(spark, d)), positions=10)[0]


_LV = "SELECT *, ln(1 + 10000.0 * value / sum(value) OVER (PARTITION BY cell_id)) AS x FROM counts"


@R.add("m8_expression_levels", sql("SELECT level, round(min(x), 6) AS lower, round(max(x), 6) AS upper, count(*) AS n_edges FROM (SELECT x, CAST(least(floor((x - lo) / greatest((hi - lo) / 5, 1e-12)), 4) AS INTEGER) AS level FROM l, (SELECT min(x) AS lo, max(x) AS hi FROM l)) GROUP BY 1", "counts", l=_LV))
def expression_levels(spark: SparkSession, d: str) -> DataFrame:
    t = models.expression_levels(S.customer_counts(spark, d))[1]
    return t.select("level", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n_edges")


@R.add("m8_edge_embedding")
def edge_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Customers and parts by the level of their counts, each level a relation."""
    return typed.train(*typed.leveled_graph(S.customer_counts(spark, d)), dim=16, epochs=2).nodes


#: Relation, left type, right type, weight, and its edges (lhs, rhs, w) on the tables.
_RELATIONS = (
    ("customer:part", "customer", "part", 1.0, "SELECT CAST(cell_id AS VARCHAR) AS lhs, CAST(feature_id AS VARCHAR) AS rhs, CAST(value AS DOUBLE) AS w FROM counts"),
    ("part:brand", "part", "brand", 2.0, "SELECT CAST(feature_id AS VARCHAR) AS lhs, brand AS rhs, 1.0 AS w FROM features"),
    ("customer:nation", "customer", "nation", 1.0, "SELECT CAST(cell_id AS VARCHAR) AS lhs, CAST(batch AS VARCHAR) AS rhs, 1.0 AS w FROM cells"),
)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, f, n = S.customer_counts(spark, d), S.part_features(spark, d), S.customer_cells(spark, d)
    parts = (c.select("cell_id", "feature_id", "value"), f.select("feature_id", "brand", F.lit(1.0)), n.select("cell_id", "batch", F.lit(1.0)))
    edges = None
    for (name, *_), p in zip(_RELATIONS, parts, strict=True):
        one = p.toDF("lhs", "rhs", "w").select(F.lit(name).alias("relation"), F.col("lhs").cast("string").alias("lhs"), F.col("rhs").cast("string").alias("rhs"), F.col("w").cast("double").alias("w"))
        edges = one if edges is None else edges.union(one)
    return edges, spark.createDataFrame([(n, a, b, w, 1, "friend") for n, a, b, w, _ in _RELATIONS], "relation string, lhs_type string, rhs_type string, weight double, repeat int, polarity string")


@R.add("m9_typed_graph")
def typed_graph(spark: SparkSession, d: str) -> DataFrame:
    return typed.train(*_graph(spark, d), dim=16, epochs=2).nodes


_HELD = drawn_sql("relation", "lhs", "rhs") + " < 0.05"


@R.add("m9_relations", sql(f"SELECT relation, lhs_type, rhs_type, weight, polarity, count(*) AS n_edges, count(*) FILTER (NOT {_HELD}) AS n_train, count(*) FILTER ({_HELD}) AS n_eval FROM g GROUP BY ALL", "counts", "cells", "features", g=" UNION ALL ".join(f"SELECT '{n}' AS relation, '{a}' AS lhs_type, '{b}' AS rhs_type, CAST({w} AS DOUBLE) AS weight, 'friend' AS polarity, lhs, rhs FROM ({q})" for n, a, b, w, q in _RELATIONS)))
def relations(spark: SparkSession, d: str) -> DataFrame:
    return typed.train(*_graph(spark, d), dim=8, epochs=1).relations.select("relation", "lhs_type", "rhs_type", "weight", "polarity", "n_edges", "n_train", "n_eval")


@R.add("m7_frozen_projection")
def frozen_projection(spark: SparkSession, d: str) -> DataFrame:
    u = collapse.loadings(collapse.log_rates(*collapse.pseudobulk(S.customer_counts(spark, d), S.customer_cells(spark, d).select("cell_id", F.col("batch").alias("pb")))), 5)
    f = u.groupBy("feature_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "u"))), lambda s: s["u"]).alias("rho")).withColumn("b", F.lit(0.0))
    return models.frozen_projection(S.customer_counts(spark, d), f)


_W = "SELECT p_partkey AS feature_id, r_regionkey AS unit, ((p_partkey * (r_regionkey + 2)) % 11 - 5) / 100.0 AS w FROM part, region"
_ACT = "SELECT cell_id, unit, sum(value * w) + unit / 10.0 - 0.2 AS x FROM counts JOIN w USING (feature_id) GROUP BY 1, 2"


def _machine(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = S.table(spark, d, "region").select(F.col("r_regionkey").alias("unit"))
    w = S.part_features(spark, d).select("feature_id").crossJoin(k).withColumn("w", ((F.col("feature_id") * (F.col("unit") + 2)) % 11 - 5) / 100.0)
    return w, k.withColumn("c", F.col("unit") / 10.0 - 0.2)


@R.add("x17_hidden_means", sql("SELECT cell_id, unit, round(1 / (1 + exp(-x)), 6) AS mean FROM a", "counts", w=_W, a=_ACT))
def hidden_means(spark: SparkSession, d: str) -> DataFrame:
    return models.hidden_means(S.customer_counts(spark, d), *_machine(spark, d)).withColumn("mean", F.round("mean", 6))


@R.add("x18_free_energy", sql("SELECT cell_id, round(-v - h, 4) AS energy FROM (SELECT cell_id, sum(greatest(x, 0) + ln(1 + exp(-abs(x)))) AS h FROM a GROUP BY 1) JOIN (SELECT cell_id, sum(value) * 0.01 AS v FROM counts GROUP BY 1) USING (cell_id)", "counts", w=_W, a=_ACT))
def free_energy(spark: SparkSession, d: str) -> DataFrame:
    a = S.part_features(spark, d).select("feature_id", F.lit(0.01).alias("a"))
    return models.free_energy(S.customer_counts(spark, d), *_machine(spark, d), a).withColumn("energy", F.round("energy", 4))


@R.add("m10_boltzmann")
def boltzmann(spark: SparkSession, d: str) -> DataFrame:
    x, _, columns = models.dense(_pb(spark, d), "pb", "feature_id", "total")
    w, _, _ = models.boltzmann(x.astype(float), 4, 20)
    return spark.createDataFrame([(int(f), u, float(w[i, u])) for i, f in enumerate(columns) for u in range(w.shape[1])], "feature_id long, unit int, w double")


def _two_tracks(spark: SparkSession, d: str) -> DataFrame:
    l = S.table(spark, d, "lineitem")
    name = F.concat_ws("/", F.concat(F.lit("g"), F.col("l_partkey") % 50), F.lit("count"), F.when(F.col("l_returnflag") == "N", "unspliced").otherwise("spliced"))
    return l.groupBy(F.col("l_suppkey").alias("cell_id"), name.alias("feature")).agg(F.sum("l_quantity").cast("long").alias("value"))


_TR = "SELECT l_suppkey AS cell_id, concat('g', l_partkey % 50) AS gene, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS u, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2"


@R.add("x1_two_tracks", sql("SELECT * FROM t", t=_TR))
def two_tracks(spark: SparkSession, d: str) -> DataFrame:
    return kinetics.split_tracks(_two_tracks(spark, d))


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    genes = spark.range(50).select(F.concat(F.lit("g"), "id").alias("gene"), (1.0 + F.col("id") % 7).alias("alpha"), (0.5 + (F.col("id") % 5) / 5.0).alias("beta"), (0.3 + (F.col("id") % 3) / 10.0).alias("gamma"))
    pos = spark.range(1, 21).select(F.col("id").cast("int").alias("pos"), (F.col("id") / 4.0).alias("t"))
    return kinetics.levels(genes, pos), pos


_GRID = dict(
    ge="SELECT concat('g', id) AS gene, 1.0 + id % 7 AS a, 0.5 + (id % 5) / 5.0 AS b, 0.3 + (id % 3) / 10.0 AS g FROM (SELECT unnest(range(50)) AS id)",
    po="SELECT CAST(id AS INTEGER) AS pos, id / 4.0 AS t FROM (SELECT unnest(range(1, 21)) AS id)",
    lv="SELECT gene, pos, a / b * (1 - exp(-b * t)) AS u, a / g * (1 - exp(-g * t)) - a * CASE WHEN abs((g - b) * t) < 1e-6 THEN t * exp(-b * t) ELSE (exp(-b * t) - exp(-g * t)) / (g - b) END AS s FROM ge, po",
    lp="SELECT gene, pos, ln((u + 1e-9) / sum(u + s + 2e-9) OVER (PARTITION BY pos)) AS lu, ln((s + 1e-9) / sum(u + s + 2e-9) OVER (PARTITION BY pos)) AS ls FROM lv",
    ll="SELECT cell_id, pos, sum(t.u * lu + t.s * ls) AS ll FROM t JOIN lp USING (gene) GROUP BY 1, 2",
)


@R.add("x9_levels", sql("SELECT gene, pos, round(u, 6) AS u, round(s, 6) AS s FROM lv", **{k: _GRID[k] for k in ("ge", "po", "lv")}))
def levels(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)[0].select("gene", "pos", F.round("u", 6).alias("u"), F.round("s", 6).alias("s"))


@R.add("x10_grid_likelihood", sql("SELECT cell_id, pos, round(ll, 3) AS ll FROM ll", t=_TR, **_GRID))
def grid_likelihood(spark: SparkSession, d: str) -> DataFrame:
    g, _ = _grid(spark, d)
    return kinetics.grid_likelihood(kinetics.split_tracks(_two_tracks(spark, d)), g).withColumn("ll", F.round("ll", 3))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers at positions by their nation."""
    return S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").cast("int").alias("pos"), F.lit(1.0).alias("q"))


@R.add("x15_mass_table", sql("SELECT cell_id, pos, round(q, 6) AS q FROM (SELECT o_custkey AS cell_id, CAST(o_orderpriority[1] AS INTEGER) AS pos, count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_custkey) AS DOUBLE) AS q FROM orders GROUP BY 1, 2) WHERE q >= 0.15"))
def mass_table(spark: SparkSession, d: str) -> DataFrame:
    """Shares of each customer's orders by priority, those of some weight."""
    n = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("pos")).count()
    q = n.join(n.groupBy("cell_id").agg(F.sum("count").alias("t")), "cell_id").select("cell_id", "pos", (F.col("count") / F.col("t")).alias("q"))
    return kinetics.mass_table(q, 0.15).withColumn("q", F.round("q", 6))


@R.add("x2_rescaled_tracks", sql("SELECT cell_id, gene, round(u / d * k, 6) AS u, round(s / d * k, 6) AS s FROM (SELECT *, sum(u + s) OVER (PARTITION BY cell_id) / sum((u + s) / d) OVER (PARTITION BY cell_id) AS k FROM (SELECT t.*, 1 + (s_nationkey + CAST(substr(gene, 2) AS INTEGER)) % 5 / 10.0 AS d FROM t JOIN supplier ON s_suppkey = cell_id))", t=_TR))
def rescaled_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks over a ratio of nation and gene, each supplier at its own total."""
    tracks = kinetics.split_tracks(_two_tracks(spark, d))
    cells = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").alias("batch"))
    delta = cells.select("batch").distinct().crossJoin(tracks.select("gene").distinct()).withColumn("delta", 1 + (F.col("batch") + F.substring("gene", 2, 10).cast("int")) % 5 / 10.0)
    r = kinetics.rescaled(tracks, cells, delta)
    return r.select("cell_id", "gene", F.round("u", 6).alias("u"), F.round("s", 6).alias("s"))


@R.add("x12_feature_rates")
def feature_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of every gene on a path that rises evenly and one that turns."""
    at = _positions(spark, d)
    reads, exposure = laplace.position_reads(kinetics.split_tracks(_two_tracks(spark, d)), at)
    paths = at.select("pos").distinct().select("pos", (F.col("pos") / 5.0).alias("t"), F.array(F.col("pos") / 24.0 - 0.5, F.sin(F.col("pos") / 4.0)).alias("z"))
    return laplace.feature_rates(reads, exposure, paths)


@R.add("x12_position_reads", sql("SELECT gene, CAST(s_nationkey AS INTEGER) AS pos, CAST(sum(u) AS DOUBLE) AS u, CAST(sum(s) AS DOUBLE) AS s FROM t JOIN supplier ON s_suppkey = cell_id GROUP BY 1, 2", t=_TR))
def position_reads(spark: SparkSession, d: str) -> DataFrame:
    return laplace.position_reads(kinetics.split_tracks(_two_tracks(spark, d)), _positions(spark, d))[0]


@R.add("x13_time_readout", sql("SELECT cell_id, round(sum(e * t) / sum(e), 5) AS tau FROM (SELECT cell_id, pos, exp(ll - max(ll) OVER (PARTITION BY cell_id)) AS e FROM ll) JOIN po USING (pos) GROUP BY 1", t=_TR, **_GRID))
def time_readout(spark: SparkSession, d: str) -> DataFrame:
    g, pos = _grid(spark, d)
    p = kinetics.posterior(kinetics.grid_likelihood(kinetics.split_tracks(_two_tracks(spark, d)), g))
    return kinetics.time_readout(p, pos).select("cell_id", F.round("tau", 5).alias("tau"))


@R.add("m6_joint_topic")
def joint_topic(spark: SparkSession, d: str) -> DataFrame:
    """One latent for two modalities, their dictionaries one above the other."""
    c = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = c.groupBy(F.col("o_custkey").alias("cell_id"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "R", "returned").otherwise("kept")).alias("feature_id")).agg(F.sum("l_quantity").alias("value"))
    pb = both.join(S.customer_cells(spark, d).select("cell_id", F.col("batch").alias("pb")), "cell_id").groupBy("pb", "feature_id").agg(F.sum("value").alias("total"))
    return encoders.transform(*encoders.fit(pb, 5, 32, epochs=30), both)


@R.add("m12_resolved_space")
def resolved_space(spark: SparkSession, d: str) -> DataFrame:
    x, _, columns = models.dense(_pb(spark, d), "pb", "feature_id", "total")
    m = models.TopicEncoder(len(columns), 5, 32)
    m.fit(x, 30)
    _, rho, b, _ = inference.resolve_space(m.encode(x), x, 8, 50)
    return spark.createDataFrame([(int(f), [float(v) for v in rho[i]], float(b[i])) for i, f in enumerate(columns)], "feature_id long, rho array<double>, b double")


@R.add(
    "h15_influence",
    sql(
        "SELECT stratum AS role, round(avg(e), 4) AS effect, round(stddev_samp(e) / sqrt(count(*)), 4) AS se FROM (SELECT stratum, cell_id, sum(value * g) - sum(value) * any_value(pg) AS e FROM counts JOIN cells USING (cell_id) JOIN st USING (feature_id), (SELECT sum(share * g) AS pg FROM st) GROUP BY 1, 2) GROUP BY 1",
        "counts",
        "cells",
        "composition",
        ad="SELECT feature_id, value, cell_id FROM counts JOIN cells USING (cell_id) WHERE batch = 3",
        st="SELECT c.feature_id, share, (coalesce(x, 0) - (SELECT sum(value) FROM ad) * share) / (SELECT count(DISTINCT cell_id) FROM ad) AS g FROM composition c LEFT JOIN (SELECT feature_id, sum(value) AS x FROM ad GROUP BY 1) USING (feature_id)",
    ),
)
def influence(spark: SparkSession, d: str) -> DataFrame:
    """What adding the customers of one nation does to each segment's likelihood."""
    c, cells = S.customer_counts(spark, d), S.customer_cells(spark, d)
    i = inference.influence(c, aggregate.composition(c), cells.where("batch = 3"), cells.select("cell_id", F.col("stratum").alias("role")))
    return i.select("role", F.round("effect", 4).alias("effect"), F.round("se", 4).alias("se"))


@R.add(
    "h16_hidden_likelihood",
    sql(
        "SELECT cell_id, CAST(sum(value) AS BIGINT) AS hidden, round(sum(value * ln(greatest(rate / all_, 1e-12))), 5) AS llik FROM (SELECT *, sum(rate) OVER (PARTITION BY cell_id) AS all_ FROM k JOIN r USING (feature_id) WHERE held) GROUP BY 1",
        "counts",
        k=f"SELECT *, {drawn_sql('cell_id', 'feature_id')} < 0.2 AS held FROM counts WHERE value > 0",
        r="SELECT feature_id, CAST(sum(value) AS DOUBLE) / (SELECT sum(value) FROM k WHERE NOT held) AS rate FROM k WHERE NOT held GROUP BY 1",
    ),
)
def hidden_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Hidden counts under the composition of those that stay."""
    h = inference.hidden_likelihood(S.customer_counts(spark, d), lambda c: aggregate.composition(c).withColumnRenamed("share", "rate"))
    return h.select("cell_id", "hidden", F.round("llik", 5).alias("llik"))


@R.add("d1_archetypes")
def archetypes(spark: SparkSession, d: str) -> DataFrame:
    return inference.archetypes(S.latent(spark, d).withColumnRenamed("cell_id", "id"), S.customer_counts(spark, d), (4, 8))


@R.add("m3_count_topics")
def count_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic shares of customers under a negative-binomial decoder."""
    c = S.customer_counts(spark, d)
    return decoders.transform(decoders.fit(c, k=3, hidden=8, epochs=2, steps=2)[0], c)


@R.add("m3_mixture_dispersions")
def mixture_dispersions(spark: SparkSession, d: str) -> DataFrame:
    return decoders.dispersions(decoders.fit(S.customer_counts(spark, d), k=3, hidden=8, decoder="nbmixture", epochs=1, steps=2)[0], spark)


@R.add("m7_bilinear")
def bilinear_fit(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and biases of parts, with their modules."""
    sums, sizes = collapse.pseudobulk(S.customer_counts(spark, d), S.customer_cells(spark, d).select("cell_id", F.col("batch").alias("pb")))
    return bilinear.fit(sums, bilinear.modules_of(sums, sizes), dim=8, rounds=2).features


#: A table of two dimensions for parts, for their brands as modules, and a latent for each region.
_DOT = "a.x * b.x + a.y * b.y"
_TABLES = dict(
    f="SELECT p_partkey AS feature_id, CAST(substr(p_brand, 7) AS INTEGER) AS module, (p_partkey % 7 - 3) / 5.0 AS x, (p_partkey % 5 - 2) / 5.0 AS y, (p_partkey % 3) / 10.0 AS b FROM part",
    m="SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS module FROM part", l="SELECT r_regionkey AS id, r_regionkey / 4.0 AS x, 0.5 - r_regionkey / 8.0 AS y FROM region",
    e="SELECT a.id, module, feature_id, exp(a.x * f.x + a.y * f.y + f.b) AS e FROM l a, f", t="SELECT a.id, module, exp(a.x * (module % 4 - 1) / 3.0 + a.y * (module % 3 - 1) / 3.0) AS e FROM l a, m",
)


@R.add("m7_probabilities", sql("SELECT e.id, e.feature_id, e.module, round(t.p, 9) AS p_module, round(e.e / sum(e.e) OVER (PARTITION BY e.id, e.module), 9) AS p_member FROM e JOIN (SELECT id, module, e / sum(e) OVER (PARTITION BY id) AS p FROM t) t USING (id, module)", **_TABLES))
def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Both levels of the softmax for every part, under a latent a region."""
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.substring("p_brand", 7, 10).cast("int").alias("module"))
    key, m, r = F.col("feature_id"), F.col("module"), F.col("r_regionkey")
    features = p.select("feature_id", "module", F.array((key % 7 - 3) / 5.0, (key % 5 - 2) / 5.0).alias("rho"), ((key % 3) / 10.0).alias("b"))
    modules = p.select("module").distinct().select("module", F.array((m % 4 - 1) / 3.0, (m % 3 - 1) / 3.0).alias("rho"), F.lit(0.0).alias("b"))
    latents = S.table(spark, d, "region").select(r.alias("id"), F.array(r / 4.0, 0.5 - r / 8.0).alias("vec"))
    return bilinear.probabilities(latents, features, modules).withColumn("p_module", F.round("p_module", 9)).withColumn("p_member", F.round("p_member", 9))


#: Parts whose number is a multiple of ten are new to a model that has all but those of a remainder of one.
_OLD = "SELECT p_partkey AS feature_id FROM part WHERE p_partkey % 10 <> 0"
_NEW = "SELECT DISTINCT feature_id FROM counts WHERE feature_id % 10 <> 1"
_STATUS = "SELECT coalesce(o.feature_id, n.feature_id) AS feature_id, CASE WHEN o.feature_id IS NULL THEN 'unseen' WHEN n.feature_id IS NULL THEN 'missing' ELSE 'matched' END AS status FROM o FULL JOIN n ON o.feature_id = n.feature_id"


def _unseen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new data's counts, its alignment with the model, and its profiles over segments."""
    counts = S.customer_counts(spark, d).where("feature_id % 10 != 1")
    aligned = bilinear.alignment(S.part_features(spark, d).where("feature_id % 10 != 0"), counts)
    return counts, aligned, bilinear.profiles(counts, S.customer_cells(spark, d).select("cell_id", F.col("stratum").alias("label")))


@R.add("x38_alignment", sql("SELECT * FROM s", "counts", o=_OLD, n=_NEW, s=_STATUS))
def feature_alignment(spark: SparkSession, d: str) -> DataFrame:
    return _unseen(spark, d)[1]


@R.add(
    "h12_borrowed_weights",
    sql(
        "SELECT a AS feature_id, b AS lender, round(e / sum(e) OVER (PARTITION BY a), 6) AS w FROM (SELECT *, exp(-(d2 - min(d2) OVER (PARTITION BY a)) / (2 * 0.1 * 0.1)) AS e FROM k)",
        "counts", "cells", o=_OLD, n=_NEW, s=_STATUS,
        g="SELECT feature_id, stratum, sum(value) AS x FROM counts JOIN cells USING (cell_id) WHERE feature_id % 10 <> 1 GROUP BY 1, 2",
        z="SELECT f.feature_id, t.stratum, sqrt(coalesce(x, 0) / total) AS x FROM (SELECT feature_id, CAST(sum(x) AS DOUBLE) AS total FROM g GROUP BY 1) f CROSS JOIN (SELECT DISTINCT stratum FROM cells) t LEFT JOIN g ON g.feature_id = f.feature_id AND g.stratum = t.stratum",
        v="SELECT feature_id, list(x ORDER BY stratum) AS vec FROM z GROUP BY 1",
        q="SELECT a.feature_id AS a, b.feature_id AS b, round(list_sum([(y[1] - y[2]) * (y[1] - y[2]) FOR y IN list_zip(a.vec, b.vec)]), 9) AS d2 FROM v a JOIN s sa ON sa.feature_id = a.feature_id AND sa.status = 'unseen' JOIN s sb ON sb.status = 'matched' JOIN v b ON b.feature_id = sb.feature_id",
        k="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM q) WHERE r <= 10",
    ),
)
def borrowed_weights(spark: SparkSession, d: str) -> DataFrame:
    _, aligned, profile = _unseen(spark, d)
    return bilinear.borrowed_weights(profile, aligned).withColumn("w", F.round("w", 6))


_VELOCITY = "SELECT cell_id, gene, (0.8 * u - 0.5 * s) / (1.0 + s) AS v, CAST(substr(gene, 2) AS INTEGER) AS g FROM t"


@R.add("x14_map_velocity", sql("SELECT cell_id, round(sum(v * (g % 7 - 3) / 10.0), 6) AS vx, round(sum(v * (g % 5 - 2) / 10.0), 6) AS vy FROM v GROUP BY 1", t=_TR, v=_VELOCITY))
def map_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' velocities on a linear map of the genes, by the chain rule."""
    t = kinetics.split_tracks(_two_tracks(spark, d)).select("cell_id", "gene", F.col("u").cast("double").alias("u"), F.col("s").cast("double").alias("s"), F.lit(0.8).alias("beta"), F.lit(0.5).alias("gamma"))
    g = F.substring("gene", 2, 10).cast("int")
    v = flow.through_map(flow.log_velocity(t), t.select("gene").distinct().select("gene", ((g % 7 - 3) / 10.0).alias("x"), ((g % 5 - 2) / 10.0).alias("y")))
    return v.select("cell_id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


@R.add("x21_memberships", sql("SELECT id, dim, round(greatest(x - (c - 1) / k, 0), 6) AS p FROM s JOIN (SELECT id, max(j) AS k, arg_max(c, j) AS c FROM (SELECT id, row_number() OVER w AS j, sum(x) OVER (w ROWS UNBOUNDED PRECEDING) AS c, x FROM s WINDOW w AS (PARTITION BY id ORDER BY x DESC, dim)) WHERE 1 + j * x > c GROUP BY 1) USING (id)", "latent", "dims", s="SELECT id, dim, 3 * x AS x FROM dims"))
def memberships(spark: SparkSession, d: str) -> DataFrame:
    """Points of the simplex nearest to three times each vector: most entries are exactly 0."""
    p = S.latent(spark, d).select(F.col("cell_id").alias("id"), V.sparsemax(F.transform("vec", lambda x: 3 * x)).alias("p"))
    return p.select("id", F.posexplode("p").alias("dim", "p")).select("id", F.col("dim").cast("long").alias("dim"), F.round("p", 6).alias("p"))


@R.add("x21_factored_weights")
def factored_weights(spark: SparkSession, d: str) -> DataFrame:
    """Machine weights of parts over brands as modules."""
    import numpy as np

    x, _, columns = models.dense(_pb(spark, d), "pb", "feature_id", "total")
    brand = {r["feature_id"]: r["brand"] for r in S.part_features(spark, d).select("feature_id", "brand").collect()}
    _, module = np.unique([brand[c] for c in columns], return_inverse=True)
    f = factored.Factored(np.zeros(len(columns), int), 4, 6, modules=module)
    factored.fit(x.astype(float), f, epochs=20)
    return spark.createDataFrame([(int(c), u, float(v)) for c, row in zip(columns, f.weights(), strict=True) for u, v in enumerate(row)], "feature_id long, unit int, w double")


@R.add("x16_modality_blocks", "SELECT p_partkey AS feature_id, p_name AS base, p_brand AS modality, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS block FROM part")
def modality_blocks(spark: SparkSession, d: str) -> DataFrame:
    return factored.modality_blocks(S.part_features(spark, d).select("feature_id", F.concat_ws("/", "name", "brand").alias("name")))
