"""Exact attribution of a linear effect to covariates, and its quality against true modifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenhand.functions.stats import fsum
from evenhand.operators.linear import LinearEffect


def contribution_array(model: LinearEffect, k: int):
    """ARRAY<STRUCT> of the target's contributions: phi = slope · (x − mean), its interval and whether it is clear."""
    rows, z, v = [], model.z, model.cov[k]
    for j, (c, b) in enumerate(zip(model.covariates, model.basis()[1:])):
        beta, sd = float(model.beta[j + 1, k]), float(max(v[j + 1, j + 1], 0.0)) ** 0.5
        phi, se = F.lit(beta) * b, F.abs(b) * F.lit(sd)
        rows.append(F.struct(F.lit(j).alias("pos"), F.lit(c).alias("covariate"), F.col(c).cast("double").alias("value"), phi.alias("phi"), se.alias("se"),
                             (phi - z * se).alias("ci_low"), (phi + z * se).alias("ci_high"), F.lit(abs(beta) > z * sd).alias("clear")))
    return F.array(*rows)


def explain(model: LinearEffect, df: DataFrame, targets, keys=("unit_id",)) -> DataFrame:
    """(keys, target, base, estimate, contributions): base + Σ phi = estimate. Everything stays in the unit's row."""
    rows = [F.struct(F.lit(t).alias("target"), F.lit(float(model.beta[0, model.targets.index(t)])).alias("base"),
                     model.value(model.targets.index(t)).alias("estimate"), contribution_array(model, model.targets.index(t)).alias("contributions")) for t in targets]
    return df.select(*keys, F.inline(F.array(*rows)))


def contributions_long(explained: DataFrame, keys=("unit_id",)) -> DataFrame:
    return explained.select(*keys, "target", "base", "estimate", F.inline("contributions"))


def top_drivers(explained: DataFrame, limit: int = 3) -> DataFrame:
    """Adds drivers: clear, non-zero contributions, largest first, ties by covariate order, never padded."""
    clear = F.filter("contributions", lambda c: c["clear"] & (c["phi"] != 0))
    keyed = F.transform(clear, lambda c: F.struct((-F.abs(c["phi"])).alias("o"), c["pos"].alias("pos"), c.alias("c")))
    return explained.withColumn("drivers", F.slice(F.transform(F.array_sort(keyed), lambda x: x["c"]), 1, limit))


def other_details(model: LinearEffect, df: DataFrame, targets, limit: int, keys=("unit_id",)) -> DataFrame:
    """(keys, target, n_others, phi, se, ci_low, ci_high) of all covariates not shown, with their joint covariance."""
    parts = []
    top = top_drivers(explain(model, df, targets, [*keys, *[c for c in model.covariates if c not in keys]]), limit)
    shown = F.transform("drivers", lambda d: d["pos"])
    p = len(model.covariates)
    b = model.basis()[1:]
    hide = [(~F.array_contains("__shown", F.lit(j))).cast("double") for j in range(p)]
    out = top.withColumn("__shown", shown)
    for t in targets:
        k = model.targets.index(t)
        phi = fsum(hide[j] * F.lit(float(model.beta[j + 1, k])) * b[j] for j in range(p))
        var = fsum(hide[i] * hide[j] * F.lit(float(model.cov[k][i + 1, j + 1] * (1 if i == j else 2))) * b[i] * b[j] for i in range(p) for j in range(i, p))
        parts.append(F.when(F.col("target") == t, F.struct(phi.alias("phi"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"))))
    out = out.withColumn("__o", F.coalesce(*parts)).withColumn("n_others", fsum(hide).cast("int"))
    return out.select(*keys, "target", "n_others", "__o.phi", "__o.se", (F.col("__o.phi") - model.z * F.col("__o.se")).alias("ci_low"),
                      (F.col("__o.phi") + model.z * F.col("__o.se")).alias("ci_high"))


def driver_maps(top: DataFrame) -> DataFrame:
    """Rows (unit_id, target, drivers) → one row per unit: MAP<target, ARRAY<STRUCT>> (few targets per unit)."""
    return top.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "drivers"))).alias("drivers"))


def global_importance(long: DataFrame) -> DataFrame:
    """(target, covariate, mean_abs, rank) over all units."""
    g = long.groupBy("target", "pos", "covariate").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy(F.desc("mean_abs"), "pos"))).drop("pos")


def true_importance(coefs: DataFrame, sds: DataFrame, pairs) -> DataFrame:
    """(target, covariate, slope, importance) from per-arm true slopes (arm, covariate, slope) and sds (covariate, sd)."""
    a, b = coefs.alias("a"), coefs.alias("b")
    j = a.join(b, (F.col("a.covariate") == F.col("b.covariate")) & (F.col("a.arm") < F.col("b.arm")))
    d = F.col("a.slope") - F.col("b.slope")
    out = j.select(F.concat_ws("-", "a.arm", "b.arm").alias("target"), F.col("a.covariate").alias("covariate"), d.alias("slope"))
    return out.join(sds, "covariate").select("target", "covariate", "slope", (F.abs("slope") * F.col("sd")).alias("importance"))


def explanation_quality(top: DataFrame, importance: DataFrame, truth: DataFrame, coefs: DataFrame, z: float, k_top: int = 3) -> DataFrame:
    """(target, metric columns): precision at k, top overlap, false drivers, recall, no-driver share, slope coverage.

    ``truth`` has (target, covariate, slope), zero for a covariate that is no modifier.
    """
    true_sets = truth.groupBy("target").agg(F.array_compact(F.collect_list(F.when(F.abs("slope") > 1e-12, F.col("covariate")))).alias("modifiers"))
    imp = importance.join(F.broadcast(true_sets), "target")
    m = F.size("modifiers")
    inside = F.array_contains("modifiers", F.col("covariate")).cast("double")
    ranked = imp.groupBy("target").agg(
        (F.sum(F.when(F.col("rank") <= m, inside)) / F.first(m)).alias("precision_at_k"),
        (F.sum(F.when(F.col("rank") <= k_top, inside)) / F.least(F.lit(k_top), F.first(m))).alias("top_overlap"))
    names = F.transform("drivers", lambda d: d["covariate"])
    hits = F.size(F.array_intersect(names, "modifiers"))
    cards = top.join(F.broadcast(true_sets), "target").groupBy("target").agg(
        (1 - F.sum(hits) / F.nullif(F.sum(F.size("drivers")), F.lit(0))).alias("false_driver_rate"), F.avg(hits / m).alias("driver_recall"),
        F.avg((F.size("drivers") == 0).cast("double")).alias("no_driver_share"),
        F.max(F.abs(F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["phi"]) - F.col("estimate"))).alias("additivity_error"))
    slope, se = F.col("beta") / F.col("scale"), F.sqrt("var") / F.col("scale")
    fit = coefs.where("pos > 0").join(truth.withColumnRenamed("slope", "true_slope"), ["target", "covariate"])
    clear = F.abs("beta") > z * F.sqrt("var")
    cover = fit.groupBy("target").agg(F.avg((F.abs(slope - F.col("true_slope")) <= z * se).cast("double")).alias("slope_coverage"),
                                      F.bool_and(clear == (F.abs("true_slope") > 1e-12)).alias("clear_set_equal"))
    return ranked.join(cards, "target").join(cover, "target")


def ranking_stability(scores: DataFrame, k: int = 2) -> DataFrame:
    """From (run, item, score): mean pairwise Jaccard of top-k sets, and the variation of the leading item's score."""
    w = W.partitionBy("run").orderBy(F.desc("score"), "item")
    tops = scores.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).groupBy("run").agg(F.collect_set("item").alias("items"))
    a, b = tops.alias("a"), tops.alias("b")
    j = a.join(b, F.col("a.run") < F.col("b.run"))
    union = F.size(F.array_union("a.items", "b.items"))
    jac = j.agg(F.avg(F.when(union > 0, F.size(F.array_intersect("a.items", "b.items")) / union).otherwise(1.0)).alias("mean_jaccard"))
    per = scores.groupBy("item").agg(F.avg(F.abs("score")).alias("__m"), (F.stddev_samp("score") / F.abs(F.avg("score"))).alias("cv"))
    lead = per.agg(F.max_by(F.struct("item", "cv"), F.struct("__m", "item")).alias("__l")).select(F.col("__l.item").alias("lead_item"), F.col("__l.cv").alias("lead_cv"))
    return jac.crossJoin(lead)
