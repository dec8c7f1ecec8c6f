"""Operators on small tables with results worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import names as N
from brindle.functions import numeric as X
from brindle.functions import vectors as V
from brindle.operators import aggregate as A
from brindle.operators import align, cluster, collapse, filters, graph, incremental, kinetics, mixtures, models, neighbours, rank, score
from brindle.sources import counts as S
from brindle.sources import dense, links, manifest
from brindle.streaming import sums as streaming


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_pair_ranks_on_a_line(spark):
    v = spark.createDataFrame([("m", i, [x]) for i, x in enumerate((0.0, 1.0, 2.0, 10.0))], "model string, pb int, vec array<double>")
    got = {(r.pb_a, r.pb_b): r["rank"] for r in neighbours.pair_ranks(v).collect()}
    assert got[0, 1] == 1 and got[2, 3] == 1 and got[0, 3] == 3


def test_softmax_of_degenerate_rows(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [])], "i int, v array<double>")
    got = {r.i: r.s for r in df.select("i", V.softmax("v").alias("s")).collect()}
    assert got[0] == [0.5, 0.5] and got[1] == [0.0, 0.0] and got[2] == [0.0, 0.0] and got[3] == []


def test_unit_of_zero_stays(spark):
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(V.unit("v")).first()[0] == [0.0, 0.0]


def test_grouped_sums_skip_unassigned(spark):
    c = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 5)], "cell_id int, feature_id int, value long")
    l = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "cell_id int, label int")
    assert rows(A.grouped_sums(c, l), "label") == [(0, 1, 5)]


def test_composition_of_nothing(spark):
    assert A.composition(spark.createDataFrame([], "cell_id int, feature_id int, value long")).count() == 0


def test_tolerant_align_refuses_repeats(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, name string")
    right = spark.createDataFrame([(0, "a"), (1, "a"), (2, "c"), (3, "c")], "pos int, name string")
    with pytest.raises(Exception, match="stands twice"):
        align.tolerant_align(left, right).collect()
    assert rows(align.tolerant_align(left.where("name = 'b'"), right), "pos") == [(1, "b", None)]


def test_cell_match_by_barcode(spark):
    a = spark.createDataFrame([(i, f"c{i}@x") for i in range(10)], "id int, name string")
    b = spark.createDataFrame([(i, f"c{i}@y") for i in range(9)] + [(9, "c0@z")], "id int, name string")
    assert {r.a_id for r in align.cell_match(a, b).collect()} == set(range(1, 9))


def test_negative_bulk_is_refused(spark):
    f = spark.createDataFrame([(1, "a")], "feature_id int, name string")
    with pytest.raises(Exception, match="negative"):
        align.align_bulk(spark.createDataFrame([("a", "s", -1.0)], "name string, sample string, value double"), f).collect()


def test_windows_of_zero_width_keep_the_region(spark):
    r = spark.createDataFrame([("1", 5, 9)], "chr string, start long, end long")
    assert align.windows(r, 0).first().window == "1:5-9"
    assert [x.window for x in align.windows(r, 5).collect()] == ["1:5-10"]


def test_names(spark):
    df = spark.createDataFrame([("ENSG01.3_TP53",), ("ENSG01.7",), ("chr1:10-20",), (" Abc ",)], "name string")
    assert [r[0] for r in df.select(N.match_key("name")).collect()] == ["tp53", "ensg01", "chr1:10-20", "abc"]
    assert df.limit(1).select(N.parse_weight(F.lit("NaN")), N.parse_weight(F.lit("-1")), N.parse_weight(F.lit("2.5")), N.p_passes(F.lit("x"), 0.1), N.p_passes(F.lit("x"), None)).first()[:] == (None, None, 2.5, False, True)
    assert spark.range(1).select(N.gene_list(F.lit("A - B, C x D"))).first()[0] == ["A", "B", "C", "D"]


def test_normal_tail(spark):
    got = spark.createDataFrame([(z,) for z in (-1.6449, 0.0, 1.6449)], "z double").select(X.normal_upper_tail("z")).collect()
    assert np.allclose([r[0] for r in got], [0.95, 0.5, 0.05], atol=1e-5)


def test_nb_weight(spark):
    assert [round(x, 6) for x in spark.range(1).select(X.nb_weight(F.lit(2.0), F.lit(2.0)), X.nb_weight(F.lit(None).cast("double"), F.lit(3.0))).first()] == [0.5, 1.0]


def test_winsorize_leaves_short_dimensions(spark):
    p = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate((1, 2, 3, 100))] + [(i, 1, float(v)) for i, v in enumerate((1, 2, 3, 4, 5, 6, 7, 100))], "id int, dim int, value double")
    got = filters.winsorize(p, 1.0)
    assert got.where("dim = 0").agg(F.max("value")).first()[0] == 100.0
    assert got.where("dim = 1").agg(F.max("value")).first()[0] < 100.0


def test_drop_and_fold_small(spark):
    l = spark.createDataFrame([(i, 0) for i in range(5)] + [(5, 7), (6, 9), (7, 9), (8, 9)], "cell_id int, label int")
    assert {r.label for r in filters.drop_small(l, 3).collect()} == {0, 1, None}
    p = spark.createDataFrame([(i, [0.0]) for i in range(5)] + [(5, [9.0]), (6, [10.0]), (7, [10.0]), (8, [10.0])], "cell_id int, vec array<double>")
    assert dict(rows(filters.fold_small(l, p, 3), "cell_id"))[5] == 9


def test_nearest_rank_and_quantiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)], "g string, x double")
    assert rank.nearest_rank(df, ["g"], "x", 0.05).first().quantile == 1.0


def test_folds_are_even(spark):
    f = rank.deal_folds(spark.range(103).select(F.col("id").alias("cell_id"), (F.col("id") % 2).alias("batch")), 5)
    n = f.groupBy("batch", "fold").count().collect()
    assert max(r["count"] for r in n) - min(r["count"] for r in n) <= 1


def test_probe_with_no_counts(spark):
    c = spark.createDataFrame([(i, -float(i), 1.0) for i in range(1, 101)], "cell_id int, llik double, total double")
    q = spark.createDataFrame([(1, -1000.0, 1.0), (2, 0.0, 0.0)], "cell_id int, llik double, total double")
    r = neighbours.probe(c, q).first()
    assert (r.cells, r.flagged) == (2, 1)


def test_impute_zero_query_gets_nothing(spark):
    ref = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, vec array<double>")
    q = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 0.0])], "id int, vec array<double>")
    c = spark.createDataFrame([(1, 1, 4.0), (2, 1, 100.0)], "cell_id int, feature_id int, value double")
    assert rows(neighbours.impute(q, ref, c), "cell_id") == [(7, 1, 4.0)]


def test_delta_of_one_rate(spark):
    c = spark.createDataFrame([(1, 1, 8), (1, 2, 2), (2, 1, 5), (2, 2, 5)], "cell_id int, feature_id int, value long")
    cells = spark.createDataFrame([(1, "a"), (2, "b")], "cell_id int, batch string")
    d = score.fitted_delta(score.delta_sums(c, cells, spark.createDataFrame([(1, 0.5), (2, 0.5)], "feature_id int, rate double")))
    assert {(r.batch, r.feature_id): round(r.delta, 6) for r in d.collect()} == {("a", 1): 1.6, ("a", 2): 0.4, ("b", 1): 1.0, ("b", 2): 1.0}


def test_pair_edges_and_tally(spark):
    p = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0), ("c", "c", 1.0), ("a", "c", None)], "lhs string, rhs string, w double")
    assert rows(graph.pair_edges(p), "lhs", "rhs") == [("a", "b", 3.0), ("a", "c", 1.0)]
    r = graph.edge_tally(p).first()
    assert (r.edges, r.self_loops, r.kept, r.repeats) == (4, 1, 2, 1)


def test_k_core_and_rank(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0)], "lhs string, rhs string, w double")
    assert {r.rhs for r in graph.k_core(e, 2, str(tmp_path)).collect()} == {"b", "c"}
    r = graph.page_rank(e, spark.createDataFrame([("d",)], "node string"), str(tmp_path / "r"), passes=10)
    assert r.orderBy(F.desc("weight")).first().node == "c"


def test_carried_merge_is_one_round(spark):
    c = spark.createDataFrame([(1, 1, 2), (2, 1, 4), (3, 2, 6)], "cell_id int, feature_id int, value long")
    cells = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "cell_id int, pb int")
    whole = incremental.evidence(*collapse.pseudobulk(c, cells), 0)
    parts = incremental.merge(incremental.evidence(*collapse.pseudobulk(c, cells.where("cell_id = 1")), 0), incremental.evidence(*collapse.pseudobulk(c, cells.where("cell_id > 1")), 1))
    assert rows(whole.select("pb", "feature_id", F.round("rate", 9), "n_cells"), "feature_id") == rows(parts.select("pb", "feature_id", F.round("rate", 9), "n_cells"), "feature_id")


def test_planted_clusters(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(c, 0.05, (50, 3)) for c in ((0, 0, 0), (10, 0, 0), (0, 10, 0))])
    p = spark.createDataFrame([(i, v.tolist(), i // 50) for i, v in enumerate(x)], "id long, vec array<double>, label int")
    got = {r.id: r.cluster for r in cluster.k_means(p, 3).collect()}
    assert all(len({got[i] for i in range(k * 50, k * 50 + 50)}) == 1 for k in range(3)) and len(set(got.values())) == 3
    com = {r.node: r.community for r in cluster.communities(neighbours.fuzzy_graph(p, 15)).collect()}
    assert all({com[i] for i in range(50)}.isdisjoint({com[i] for i in range(k * 50, k * 50 + 50)}) for k in (1, 2))
    with pytest.raises(ValueError):
        cluster.k_means(p.limit(2), 3)


def test_gibbs_recovers_a_mixture(spark):
    rng = np.random.default_rng(0)
    prof = rng.gamma(0.5, 1.0, (2, 60))
    prof /= prof.sum(1, keepdims=True)
    profiles = spark.createDataFrame([(f"t{k}", g, float(prof[k, g])) for k in range(2) for g in range(60)], "label string, feature_id int, rate double")
    y = 20000 * (0.3 * prof[0] + 0.7 * prof[1])
    bulk = spark.createDataFrame([("s", g, float(round(y[g]))) for g in range(60)], "sample string, feature_id int, value double")
    d = mixtures.fractions(mixtures.gibbs(bulk, profiles, 50, 50))
    got = {r.type: r["mean"] for r in mixtures.posterior(d).collect()}
    assert abs(got["t0"] - 0.3) < 0.03
    assert mixtures.convergence(d).first().rhat is not None


@pytest.mark.parametrize("head", ["softmax", "stick", "raw", "gaussian"])
def test_encoder_learns_two_blocks(head):
    x = np.array([[3 + (c + g) % 4 if (g < 20) == (c < 20) else 0 for g in range(40)] for c in range(40)], float)
    m = models.TopicEncoder(40, 3, 16, head)
    losses = m.fit(x, 150)
    assert losses[-1] < losses[0] - 0.3


def test_manifest_round_trip(tmp_path):
    p = tmp_path / "run.json"
    p.write_text('{"latent": "x.parquet", "own": {"deep": [1]}}')
    doc = manifest.save(p, {"cluster": {"k": 3}})
    assert doc["outputs"]["latent"] == "x.parquet" and manifest.load(p)["own"] == {"deep": [1]} and doc["cluster"] == {"k": 3}
    assert manifest.differences({"a": 1, "b": {"c": 2}}, {"a": 1, "b": {"c": 3}}) == [("b.c", 2, 3)]
    with pytest.raises(ValueError):
        manifest.add_round({"history": [{"data": ["a"]}]}, "p", {"data": ["./a"]})
    assert len(manifest.KINDS) == 13


def test_dense_tables(spark, tmp_path):
    df = spark.createDataFrame([(0.5, "a", 0.5), (0.5, "b", 0.5)], "x double, n string, y double")
    df.write.parquet(str(tmp_path / "t"))
    got = dense.read_parquet(spark, str(tmp_path / "t"))
    assert got.columns == ["name", "x", "y"] and dense.detect_scale(got) == "simplex"
    (tmp_path / "t.tsv").write_text("gene\ts1\ts2\na\t1\t2\n")
    assert dense.read_text(spark, str(tmp_path / "t.tsv")).first()[:] == ("a", 1.0, 2.0)
    with pytest.raises(Exception, match="finite"):
        dense.write(spark.createDataFrame([("a", float("nan"))], "name string, x double"), str(tmp_path / "bad"))


def test_links(spark, tmp_path):
    assert links.detect(["CHR_ID", "CHR_POS", "MAPPED_GENE", "P-VALUE", "MAPPED_TRAIT"]) == "gwas_catalog" and links.detect([], "##fileformat=VCFv4.2") == "gwas_vcf" and links.detect(["x"]) is None
    g = spark.createDataFrame([("1;2", "10;20", "A - B", "1e-9", "t1, t2"), ("1", None, "A", "1e-9", "t"), ("1", "5", "A", "bad", "t")], "CHR_ID string, CHR_POS string, MAPPED_GENE string, `P-VALUE` string, MAPPED_TRAIT string")
    assert links.gwas_catalog(g).where("relation = 'variant:trait'").count() == 4
    with pytest.raises(Exception, match="build"):
        links.gtex(spark.createDataFrame([("chr1_5_A_G_b37", "G1")], "variant_id string, gene_id string"), "x").collect()
    (tmp_path / "p").write_text("# c\na b 2\nb a 3\nshort\nx y bad\n")
    assert rows(graph.pair_edges(graph.read_pairs(spark, str(tmp_path / "p"))), "lhs") == [("a", "b", 3.0)]


def test_stack_and_values(spark):
    c = spark.createDataFrame([("c1", 1, 2)], "cell_name string, feature_id int, value long")
    assert {r.cell_name for r in S.stack({"a": c, "b": c}).collect()} == {"c1@a", "c1@b"}
    with pytest.raises(Exception, match="negative"):
        S.check_values(c.withColumn("value", F.lit(-1))).collect()
    with pytest.raises(ValueError):
        S.stack_modalities([c, c, c], ["x", "y"])


def test_streamed_sums_equal_batch(spark, tmp_path):
    c = spark.createDataFrame([(i % 7, i % 3, i) for i in range(60)], "cell_id long, feature_id long, value long")
    l = spark.createDataFrame([(i, i % 2) for i in range(7)], "cell_id long, label int")
    c.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.carry(stream, l, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = streaming.totals(spark.read.parquet(str(tmp_path / "out")))
    assert rows(got, "label", "feature_id") == rows(A.grouped_sums(c, l), "label", "feature_id")


def test_splicing_series_meets_closed_form(spark):
    f = lambda g: spark.range(1).select(X.spliced_level(F.lit(0.5), F.lit(1.0), F.lit(2.0), F.lit(0.7), F.lit(g), F.lit(1.5))).first()[0]
    assert math.isclose(f(0.7), f(0.7 + 1e-5), rel_tol=1e-4)


def test_simulated_times_are_recovered():
    rng = np.random.default_rng(4)
    t = np.linspace(0.25, 5, 20)
    rates = np.stack([rng.normal(1, 0.5, 60), rng.normal(0, 0.3, 60), rng.normal(-0.5, 0.5, 60)], 1)
    true = rng.integers(0, 20, 150)
    u, s = (x[:, true].T for x in kinetics._paths(rates, t))
    scale = 3000 / (u + s).sum(1, keepdims=True)
    x, q, _ = kinetics.fit_rates(rng.poisson(u * scale).astype(float), rng.poisson(s * scale).astype(float), t)
    tau = q @ np.arange(20)
    assert np.corrcoef(np.argsort(np.argsort(tau)), np.argsort(np.argsort(true)))[0, 1] > 0.9


def test_resolved_space_and_kept_preparation(spark, tmp_path):
    from brindle.operators import inference

    rng = np.random.default_rng(0)
    theta = rng.dirichlet(np.ones(3), 30)
    x = rng.poisson(theta @ rng.gamma(0.5, 10, (3, 40))).astype(float)
    losses = inference.resolve_space(theta, x, 4, 150)[3]
    assert losses[-1] < losses[0]
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert inference.prepared(spark, str(tmp_path), {"b": 1, "a": 2}, build).count() == 3
    assert len(calls) == 1


def test_relation_overrides_refuse_unknown_names(spark, tmp_path):
    r = spark.createDataFrame([("a", 1.0)], "relation string, weight double")
    assert graph.override_relations(r, {"a": {"weight": 2}}).first().weight == 2.0
    with pytest.raises(ValueError, match="b"):
        graph.override_relations(r, {"b": {"weight": 2}})
    graph.export_text(spark.createDataFrame([("g", "x", "t", "y", 1.5)], "lhs_type string, lhs string, rhs_type string, rhs string, w double"), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first()[0] == "g\tx\tt\ty\t1.5"
