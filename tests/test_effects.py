import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from evenhand.operators import diagnostics as D
from evenhand.operators import effects as E
from evenhand.operators import learners as M
from evenhand.operators import linear as L
from evenhand.operators import matching as N
from evenhand.sources import tables as T


def test_planted_truth(spark, sf):
    """The naive interval misses the planted difference; the doubly robust one covers it within a few standard errors."""
    units = T.planted(spark, "/root/testdata/sf0.01").persist()
    truth = units.agg(F.avg(F.col("mu_true_A") - F.col("mu_true_B"))).first()[0]
    st = E.cell_stats(E.add_folds(units))
    nu = E.cell_nuisance(st)
    naive = E.naive(st).where("target = 'A-B'").first()
    dr = E.aipw(st, nu).where("target = 'A-B'").first()
    assert not naive["ci_low"] <= truth <= naive["ci_high"]
    assert abs(dr["value"] - truth) < 2 * dr["se"]


def test_sums_equal_unit_level_scores(spark, sf):
    units = E.add_folds(T.planted(spark, sf)).persist()
    st = E.cell_stats(units)
    nu = E.cell_nuisance(st)
    fast = {r["target"]: r for r in E.aipw(st, nu).collect()}
    slow = {r["target"]: r for r in E.influence_estimates(E.unit_scores(units, E.widen(nu)), E.target_values("phi")).collect()}
    for t in slow:
        assert abs(fast[t]["value"] - slow[t]["value"]) < 1e-9 and abs(fast[t]["se"] - slow[t]["se"]) < 1e-9


def test_second_stage_equals_numpy(spark, sf):
    sc = E.scored_cohort(T.cohort(spark, sf)).persist()
    cov = ["x1", "x2", "b1", "b2"]
    m = L.fit_effect(sc, cov, E.target_values("phi"))
    pdf = sc.select(*cov, "phi_A", "phi_B").toPandas()
    x = pdf[cov].to_numpy(float)
    b = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    y = (pdf["phi_A"] - pdf["phi_B"]).to_numpy()
    bread = np.linalg.pinv(b.T @ b)
    beta = bread @ b.T @ y
    adj = (y - b @ beta) / (1 - np.clip(np.einsum("ij,jk,ik->i", b, bread, b), 0, 0.99))
    cov_m = bread @ (b.T * adj ** 2) @ b @ bread
    k = m.targets.index("A-B")
    assert np.allclose(m.beta[:, k], beta) and np.allclose(m.cov[k], cov_m)


def test_wide_basis_goes_through_arrow_batches(spark, sf):
    rows = T.cohort(spark, sf).select("y", *[(F.col("x1") * i + F.col("x2")).alias(f"c{i}") for i in range(20)])
    names = [f"c{i}" for i in range(20)]
    g, by = L.gram(rows, names, ["y"])[()]
    pdf = rows.toPandas()
    assert np.allclose(g, pdf[names].T @ pdf[names]) and np.allclose(by[:, 0], pdf[names].T @ pdf["y"])


def test_matching_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 300
    e = rng.dirichlet([2, 2, 2], n).round(2) + 0.01
    arm, y = np.array(list("ABC"))[rng.integers(0, 3, n)], rng.normal(size=n)
    df = spark.createDataFrame([(i, a, float(v), *map(float, p)) for i, (a, v, p) in enumerate(zip(arm, y, e))],
                               "unit_id bigint, arm string, y double, e_A double, e_B double, e_C double")
    lv, means = np.log(e), {}
    for a in "ABC":
        d = np.flatnonzero(arm == a)
        near = [d[((lv[d] - q) ** 2).sum(1).argmin()] for q in lv]
        means[a] = np.where(arm == a, y, y[near]).mean()
    got = {r["arm"]: r["value"] for r in N.matched_means(df).collect()}
    for a in "ABC":
        assert abs(got[a] - means[a]) < 1e-9


def test_boxes_reach_all_near_points(spark):
    rng = np.random.default_rng(4)
    pts = np.round(rng.normal(size=(500, 3)), 1)
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double, c double")
    boxes = N.Boxes.over(df, ["a", "b", "c"], 20)
    home, radius = boxes.home(pts), rng.uniform(0, 1, 500)
    assert 10 < len(set(home)) and home.max() < boxes.offset[-1]
    reached = set(zip(*boxes.within(pts, radius)))
    for i in range(500):
        near = np.flatnonzero(((pts - pts[i]) ** 2).sum(1) <= radius[i] ** 2)
        assert {(i, home[j]) for j in near} <= reached


@pytest.mark.parametrize("first,leaf", [(1, 10), (16, 512)])
def test_matching_replicates_equal_brute_force(spark, monkeypatch, first, leaf):
    """Every replicate matched anew among the units that it counts; vectors shared by many units, ties, parts of boxes."""
    monkeypatch.setattr(N, "UNITS", 40)
    monkeypatch.setattr(N, "NEAR", 2)
    rng = np.random.default_rng(8)
    n, reps = 400, 6
    e = rng.dirichlet([2, 2, 2], n).round(1) + 0.05
    arm, y = np.array(list("ABC"))[rng.choice(3, n, p=[0.6, 0.3, 0.1])], rng.normal(size=n)
    df = spark.createDataFrame([(i, a, float(v), *map(float, p)) for i, (a, v, p) in enumerate(zip(arm, y, e))], "unit_id bigint, arm string, y double, e_A double, e_B double, e_C double")
    w = np.array([r["w"] for r in df.select("unit_id", N.counts(reps).alias("w")).orderBy("unit_id").collect()])
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.1 and w.max() > 2
    got = {(r["rep"], r["arm"]): r["value"] for r in N.matched_means(df, replicates=reps, leaf=leaf, first=first).collect()}
    lv = np.array([[np.log(x) for x in p] for p in e])
    for b in range(reps + 1):
        for a in "ABC":
            d = np.flatnonzero((arm == a) & (w[:, b] > 0))
            near = []
            for q in lv:
                dist = np.zeros(len(d))
                for k in range(3):
                    dist += (q[k] - lv[d, k]) ** 2
                near.append(d[dist.argmin()])
            want = np.average(np.where(arm == a, y, y[near]), weights=w[:, b])
            assert abs(got[b, a] - want) < 1e-9


def test_bootstrap_interval_holds_the_planted_truth(spark, sf):
    units = T.planted(spark, sf)
    for a in "ABC":
        units = units.withColumn(f"e_{a}", F.col(f"e_true_{a}"))
    truth = units.agg(*[F.avg(f"mu_true_{a}").alias(a) for a in "ABC"]).first()
    for r in N.matching(units, replicates=40).collect():
        a, _, b = r["target"].partition("-")
        want = truth[a] - (truth[b] if b else 0)
        assert 0 < r["se"] < 0.2 and abs(r["value"] - want) < 2.5 * r["se"] + 0.02, r


def test_placebo_keeps_arm_counts(spark, sf):
    units = T.cohort(spark, sf).persist()
    want = {r["arm"]: r["count"] for r in units.groupBy("arm").count().collect()}
    for r in D.placebo_arms(units, 3).groupBy("rep").pivot("arm").count().collect():
        assert {a: r[a] for a in want} == want


def test_hand_worked_weights(spark):
    """Weights 1.25 and 5: four of five units in the first cell received A, one of five in the second."""
    rows = [(i, "c1", "A" if i < 4 else "B", 1.0) for i in range(5)] + [(5 + i, "c2", "A" if i < 1 else "B", 2.0) for i in range(5)]
    st = E.cell_stats(spark.createDataFrame(rows, "unit_id int, cell string, arm string, y double"))
    nu = E.cell_nuisance(st, ("A", "B"), cross_fit=False)
    w = E.ipw_two_arms(st, nu, "A", "B").first()
    assert abs(w["max_weight"] - 5) < 1e-9
    assert abs(E.ipw(st, nu, ("A", "B")).where("target = 'A'").first()["value"] - 1.5) < 1e-9


def test_trees_read_a_row_for_each_set_of_bins(spark):
    d = spark.range(4_000).select(F.col("id").alias("unit_id"), (F.col("id") % 17 / 5.0).alias("x1"), (F.col("id") % 3).alias("b1"), F.lit(0.0).alias("phi_B"))
    d = d.withColumn("phi_A", F.sin("x1") * 2 + F.col("b1") * F.col("x1") + F.pmod(F.xxhash64("unit_id"), F.lit(100)) / 100.0)
    rows = VectorAssembler(inputCols=["x1", "b1"], outputCol="__raw").transform(d)
    want = {r.unit_id: r.t for r in M._gbt("phi_A", 5).fit(rows).transform(rows).select("unit_id", F.col("__pred").alias("t")).collect()}
    got = M.tree_effect(d, ["x1", "b1"], "phi_A", "phi_B", 5).select("unit_id", "tau").collect()
    assert len(got) == 4_000 and max(abs(r.tau - want[r.unit_id]) for r in got) < 1e-9
    many = d.withColumn("x1", F.col("unit_id") / 7.0)
    edges = M.bin_edges(many, ["x1", "b1"])
    assert len(edges["x1"]) == 31 and edges["b1"] == [0.5, 1.5] and M.tree_groups(M.binned(many, edges), ["x1", "b1"], F.col("phi_A")).count() == 96
    with pytest.raises(Exception, match="null"):
        M.tree_effect(d.withColumn("x1", F.expr("nullif(x1, 0.2)")), ["x1"], "phi_A", "phi_B", 1).agg(F.sum("tau")).collect()
