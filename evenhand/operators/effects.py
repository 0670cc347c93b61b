"""Average and unit-level effects of several arms.

In the ``cells`` mode everything an average-effect estimator needs is a handful of sums per (cell, fold, arm). One scan
with map-side combine builds that table; propensities, outcome means, weights, scores and standard errors are then
column arithmetic on a few hundred rows, whatever the size of the cohort. Only unit-level results go back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenhand import config as cfg
from evenhand.functions.hashing import hash_key
from evenhand.functions.ranking import exact_quantiles, hash_rank
from evenhand.functions.stats import fsum, small, union_all
from evenhand.session import materialise


def pick(prefix: str, arm: Column, arms) -> Column:
    """The wide column ``prefix_<arm>`` that belongs to the arm named in a column."""
    return F.coalesce(*[F.when(arm == a, F.col(f"{prefix}_{a}")) for a in arms])


# Folds and sufficient statistics


def dealt(units: DataFrame, about: int, salt: str = "fold", rows: int = 50_000) -> DataFrame:
    """Units dealt by a prefix of their fold key (__h, __b), before they are copied for replicates: about ``rows`` to a task.

    ``about`` is their number or somewhat more. Copies then stay with their unit, so that ``add_folds`` moves none of them."""
    keyed = units.withColumn("__h", hash_key("unit_id", salt)).withColumn("__b", F.substring("__h", 1, 3))
    return keyed.repartition(about // rows + units.sparkSession.sparkContext.defaultParallelism, "__b")


def add_folds(units: DataFrame, k: int = cfg.FOLDS, salt: str = "fold", by=()) -> DataFrame:
    """Stratified folds: position in the arm's hash order modulo k, so every arm is split evenly."""
    if "__b" in units.columns:
        return _folds_in_place(units, k, [*by, "arm"])
    keyed = units.withColumn("__h", hash_key("unit_id", salt))
    ranked = hash_rank(keyed, "__h", "__rk", by=(*by, "arm"), keep=False)
    return ranked.withColumn("fold", ((F.col("__rk") - 1) % k).cast("int")).drop("__h", "__rk")


def _folds_in_place(units: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Folds of dealt units: only the sizes of their 4,096 buckets in each group are moved."""
    sizes = units.groupBy("__b", *by).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__b", *by, (F.coalesce(F.sum("__n").over(before), F.lit(0)) % k).alias("__off"))
    place = F.row_number().over(W.partitionBy("__b", *by).orderBy("__h"))
    ranked = units.withColumn("__rk", place).join(F.broadcast(offsets), ["__b", *by])  # at most 4,096 rows a group, whatever the number of units
    return ranked.withColumn("fold", ((F.col("__off") + F.col("__rk") - 1) % k).cast("int")).drop("__h", "__b", "__rk", "__off")


def cell_stats(units: DataFrame, outcomes=("y",), by=(), weight: Column | None = None) -> DataFrame:
    """n, sum and sum of squares per (by, outcome, cell, fold, arm): one pass, map-side combined."""
    by = list(by)
    if "fold" not in units.columns:
        units = units.withColumn("fold", F.lit(0))
    w = F.lit(1.0) if weight is None else weight.cast("double")
    aggs = [F.sum(w).alias("n")]
    for o in outcomes:
        aggs += [F.sum(w * F.col(o)).alias(f"__s_{o}"), F.sum(w * F.col(o) * F.col(o)).alias(f"__q_{o}")]
    wide = units.groupBy(*by, "cell", "fold", "arm").agg(*aggs)
    parts = F.explode(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(f"__s_{o}").alias("sy"), F.col(f"__q_{o}").alias("syy"))
        for o in outcomes
    ]))
    return wide.select(*by, "cell", "fold", "arm", "n", parts.alias("__o")).select(
        *by, F.col("__o.outcome").alias("outcome"), "cell", "fold", "arm", "n",
        F.col("__o.sy").alias("sy"), F.col("__o.syy").alias("syy"),
    )


def cell_nuisance(stats: DataFrame, arms=cfg.ARMS, by=("outcome",), cross_fit: bool = True,
                  floor: float = cfg.PROPENSITY_CLIP) -> DataFrame:
    """Propensity and outcome mean per (by, cell, fold, arm), leaving the own fold out if ``cross_fit``.

    An arm with nobody left in a cell takes the floor as propensity and the arm's own mean over the other folds.
    """
    by = list(by)
    grid = stats.select(*by, "cell", "fold").distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    full = grid.join(stats, [*by, "cell", "fold", "arm"], "left").na.fill(0.0, ["n", "sy"])

    def over(col, *keys):
        return F.sum(col).over(W.partitionBy(*by, *keys))

    keep = 1.0 if cross_fit else 0.0
    n_arm = over("n", "cell", "arm") - keep * F.col("n")
    n_all = over("n", "cell") - keep * over("n", "cell", "fold")
    s_arm = over("sy", "cell", "arm") - keep * F.col("sy")
    arm_n = over("n", "arm") - keep * over("n", "arm", "fold")
    arm_s = over("sy", "arm") - keep * over("sy", "arm", "fold")
    out = full.select(
        *by, "cell", "fold", "arm", n_arm.alias("n_out"),
        F.when(n_arm > 0.5, n_arm / F.nullif(n_all, F.lit(0.0))).otherwise(F.lit(floor)).alias("e_raw"),
        F.when(n_arm > 0.5, s_arm / F.nullif(n_arm, F.lit(0.0))).otherwise(arm_s / F.nullif(arm_n, F.lit(0.0))).alias("mu"),
    )
    return clip_propensity(out, [*by, "cell", "fold"], floor)


def clip_propensity(long: DataFrame, keys, floor: float = cfg.PROPENSITY_CLIP) -> DataFrame:
    """No probability below the floor, then back to a sum of one within ``keys``; ``e_raw`` becomes ``e``."""
    q = F.least(F.greatest(F.col("e_raw"), F.lit(floor)), F.lit(1.0))
    return long.withColumn("__q", q).withColumn("e", F.col("__q") / F.sum("__q").over(W.partitionBy(*keys))).drop("__q")


def widen(nuis: DataFrame, arms=cfg.ARMS, keys=("outcome", "cell", "fold")) -> DataFrame:
    """One row per (keys) with columns e_<arm>, mu_<arm>."""
    aggs = []
    for a in arms:
        aggs += [F.max(F.when(F.col("arm") == a, F.col("e"))).alias(f"e_{a}"),
                 F.max(F.when(F.col("arm") == a, F.col("mu"))).alias(f"mu_{a}")]
    return nuis.groupBy(*keys).agg(*aggs)


# Average effects from sufficient statistics


def arms_to_targets(per_arm: DataFrame, arms=cfg.ARMS, by=("outcome",), z: float = cfg.CI_Z) -> DataFrame:
    """(by, arm, value, var, n) with independent arms → every arm and contrast with its interval."""
    by = list(by)
    aggs = []
    for a in arms:
        aggs += [F.max(F.when(F.col("arm") == a, F.col("value"))).alias(f"v_{a}"),
                 F.max(F.when(F.col("arm") == a, F.col("var"))).alias(f"q_{a}"),
                 F.max(F.when(F.col("arm") == a, F.col("n"))).alias(f"n_{a}")]
    wide = per_arm.groupBy(*by).agg(*aggs)
    rows = []
    for name, a, b in cfg.targets(arms):
        value, var, n = F.col(f"v_{a}"), F.col(f"q_{a}"), F.col(f"n_{a}")
        if b is not None:
            value, var, n = value - F.col(f"v_{b}"), var + F.col(f"q_{b}"), n + F.col(f"n_{b}")
        rows.append(F.struct(F.lit(name).alias("target"), value.alias("value"), F.sqrt(var).alias("se"), n.alias("n")))
    return with_interval(
        wide.select(*by, F.explode(F.array(*rows)).alias("__t")).select(*by, "__t.target", "__t.value", "__t.se", "__t.n"), z)


def with_interval(df: DataFrame, z: float = cfg.CI_Z) -> DataFrame:
    return df.withColumn("ci_low", F.col("value") - z * F.col("se")).withColumn("ci_high", F.col("value") + z * F.col("se"))


def naive(stats: DataFrame, arms=cfg.ARMS, by=("outcome",), z: float = cfg.CI_Z) -> DataFrame:
    """Plain arm means with Welch standard errors."""
    s = stats.groupBy(*by, "arm").agg(F.sum("n").alias("n"), F.sum("sy").alias("s"), F.sum("syy").alias("q"))
    per_arm = s.select(*by, "arm", "n", (F.col("s") / F.col("n")).alias("value"),
                       ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1) / F.col("n")).alias("var"))
    return arms_to_targets(per_arm, arms, by, z).withColumn("method", F.lit("naive"))


def _weighted_sums(stats: DataFrame, wide: DataFrame, arms, by) -> DataFrame:
    """Per (by, arm): sums of w, wY, w², w²Y, w²Y² for w = 1/e of the arm received, and the total n."""
    keys = [*by, "cell", "fold"]
    j = stats.join(wide, keys).withColumn("__w", 1 / pick("e", F.col("arm"), arms))
    w = F.col("__w")
    per = j.groupBy(*by, "arm").agg(
        F.sum("n").alias("n_arm"), F.sum(w * F.col("n")).alias("w1"), F.sum(w * F.col("sy")).alias("wy"),
        F.sum(w * w * F.col("n")).alias("w2"), F.sum(w * w * F.col("sy")).alias("w2y"),
        F.sum(w * w * F.col("syy")).alias("w2yy"), F.max(F.when(F.col("n") > 0, w)).alias("w_max"),
    )
    return per.withColumn("n", F.sum("n_arm").over(W.partitionBy(*by)))


def ipw(stats: DataFrame, nuis: DataFrame, arms=cfg.ARMS, by=("outcome",), z: float = cfg.CI_Z) -> DataFrame:
    """Hájek weighted means; the standard error comes from the influence values w(Y−m)/mean(w)."""
    s = _weighted_sums(stats, widen(nuis, arms, [*by, "cell", "fold"]), arms, by)
    m = F.col("wy") / F.col("w1")
    spread = F.col("w2yy") - 2 * m * F.col("w2y") + m * m * F.col("w2")
    wbar = F.col("w1") / F.col("n")
    per_arm = s.select(*by, "arm", m.alias("value"), (spread / (wbar * wbar) / (F.col("n") - 1) / F.col("n")).alias("var"),
                       (F.col("n") / F.lit(1.0)).alias("n"))
    out = arms_to_targets(per_arm, arms, by, z).withColumn("method", F.lit("IPW"))
    # every influence value is defined on the whole cohort, so n is the cohort's
    return out.join(s.groupBy(*by).agg(F.max("n").alias("__n")), list(by)).withColumn("n", F.col("__n")).drop("__n")


def ipw_two_arms(stats: DataFrame, nuis: DataFrame, first: str, second: str, by=("outcome",),
                 z: float = cfg.CI_Z) -> DataFrame:
    """First against second arm in the Hájek and the divide-by-n form, with largest weight and effective sample size."""
    arms = (first, second)
    s = _weighted_sums(stats, widen(nuis, arms, [*by, "cell", "fold"]), arms, by)
    wide = s.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("w_max").alias("max_weight"),
        (F.sum("w1") * F.sum("w1") / F.sum("w2")).alias("ess"),
        *[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}_{a}") for a in arms for c in ("w1", "wy", "w2", "w2y", "w2yy")],
    )

    def form(name, mean):
        m = {a: mean(a) for a in arms}
        sq = {a: F.col(f"w2yy_{a}") - 2 * m[a] * F.col(f"w2y_{a}") + m[a] * m[a] * F.col(f"w2_{a}") for a in arms}
        lin = (F.col(f"wy_{first}") - m[first] * F.col(f"w1_{first}")) - (F.col(f"wy_{second}") - m[second] * F.col(f"w1_{second}"))
        var = (sq[first] + sq[second] - lin * lin / F.col("n")) / (F.col("n") - 1)
        return F.struct(F.lit(name).alias("method"), (m[first] - m[second]).alias("value"), F.sqrt(var / F.col("n")).alias("se"))

    forms = F.explode(F.array(
        form("hajek", lambda a: F.col(f"wy_{a}") / F.col(f"w1_{a}")),
        form("horvitz_thompson", lambda a: F.col(f"wy_{a}") / F.col("n")),
    ))
    out = wide.select(*by, "n", "max_weight", "ess", forms.alias("__f"))
    return with_interval(out.select(*by, "__f.method", F.lit(f"{first}-{second}").alias("target"), "__f.value", "__f.se",
                                    "n", "max_weight", "ess"), z)


def aipw(stats: DataFrame, nuis: DataFrame, arms=cfg.ARMS, by=("outcome",), z: float = cfg.CI_Z) -> DataFrame:
    """Doubly robust averages and contrasts.

    The score of a unit is linear in its outcome given (cell, fold, arm), so the mean and the variance of scores and
    score differences follow from n, sum and sum of squares alone.
    """
    by = list(by)
    wide = widen(nuis, arms, [*by, "cell", "fold"])
    j = stats.join(wide, [*by, "cell", "fold"])
    j = j.withColumn("__mu", pick("mu", F.col("arm"), arms)).withColumn("__e", pick("e", F.col("arm"), arms))
    rows = []
    for name, a, b in cfg.targets(arms):
        m = F.col(f"mu_{a}") - (F.col(f"mu_{b}") if b else F.lit(0.0))
        s = F.when(F.col("arm") == a, F.lit(1.0))
        s = (s.when(F.col("arm") == b, F.lit(-1.0)) if b else s).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("target"), m.alias("m"), s.alias("s")))
    t = j.withColumn("__t", F.explode(F.array(*rows)))
    n, mu, e, m, s = F.col("n"), F.col("__mu"), F.col("__e"), F.col("__t.m"), F.col("__t.s")
    resid = F.col("sy") - n * mu
    resid2 = F.col("syy") - 2 * mu * F.col("sy") + n * mu * mu
    agg = t.groupBy(*by, F.col("__t.target").alias("target")).agg(
        F.sum("n").alias("n"), F.sum(n * m + s * resid / e).alias("__s"),
        F.sum(n * m * m + 2 * m * s * resid / e + s * s * resid2 / (e * e)).alias("__q"),
    )
    var = (F.col("__q") - F.col("__s") * F.col("__s") / F.col("n")) / (F.col("n") - 1)
    out = agg.select(*by, "target", (F.col("__s") / F.col("n")).alias("value"),
                     F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n")).alias("se"), "n")
    return with_interval(out, z).withColumn("method", F.lit("AIPW"))


def crossfit_aipw(units: DataFrame, arms=cfg.ARMS, outcomes=("y",), by=(), folds: int = cfg.FOLDS) -> DataFrame:
    """Folds, sums, nuisances and AIPW in one call."""
    st = cell_stats(add_folds(units, folds, by=by) if folds > 1 else units, outcomes, by)
    keys = [*by, "outcome"]
    return aipw(st, cell_nuisance(st, arms, keys, cross_fit=folds > 1), arms, keys)


# Stratification


def stratified_effect(scored: DataFrame, first: str, second: str, strata=(5,), z: float = cfg.CI_Z) -> DataFrame:
    """Equal-frequency strata of a propensity column ``e``; several stratum counts in one pass.

    Strata lacking an arm are skipped and counted.
    """
    probs = sorted({i / k for k in strata for i in range(1, k)})
    q = exact_quantiles(scored, "e", probs).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("p"), F.col("value")))).alias("__q"))
    per_k = F.array(*[
        F.struct(F.lit(k).alias("k"), F.transform(F.array(*[F.lit(i / k) for i in range(1, k)]),
                                                  lambda p: F.element_at("__q", p)).alias("edges"))
        for k in strata
    ])
    edges = q.select(per_k.alias("__e"))
    rows = scored.crossJoin(F.broadcast(edges)).select("arm", "y", "e", F.explode("__e").alias("__k"))  # one-row side
    bucket = F.size(F.filter(F.col("__k.edges"), lambda x: x <= F.col("e")))
    got = rows.groupBy(F.col("__k.k").alias("n_strata"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        *[f for a, t in ((first, "1"), (second, "0")) for f in (
            F.count(F.when(F.col("arm") == a, 1)).alias(f"n{t}"),
            F.avg(F.when(F.col("arm") == a, F.col("y"))).alias(f"m{t}"),
            F.var_samp(F.when(F.col("arm") == a, F.col("y"))).alias(f"v{t}"))],
    )
    ok = (F.col("n1") > 0) & (F.col("n0") > 0)
    size = F.sum(F.when(ok, F.col("n")))
    out = got.groupBy("n_strata").agg(
        (F.sum(F.when(ok, F.col("n") * (F.col("m1") - F.col("m0")))) / size).alias("value"),
        (F.sqrt(F.sum(F.when(ok, F.col("n") * F.col("n") * (F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))))) / size).alias("se"),
        F.count(F.when(ok, 1)).alias("__used"), F.sum("n").alias("n"),
    )
    return with_interval(out, z).withColumn("skipped", F.col("n_strata") - F.col("__used")).drop("__used")


# Unit-level scores


def unit_scores(units: DataFrame, wide: DataFrame, arms=cfg.ARMS) -> DataFrame:
    """Adds e_<arm>, mu_<arm> and the doubly robust score phi_<arm> to every unit (joined on cell and fold)."""
    j = units.join(small(wide.drop("outcome")), ["cell", "fold"])  # a row per cell and fold
    phi = [
        (F.col(f"mu_{a}") + F.when(F.col("arm") == a, (F.col("y") - F.col(f"mu_{a}")) / F.col(f"e_{a}")).otherwise(0.0)).alias(f"phi_{a}")
        for a in arms
    ]
    return j.select("*", *phi)


def scored_cohort(units: DataFrame, arms=cfg.ARMS, folds: int = cfg.FOLDS, outcome: str = "y") -> DataFrame:
    """Units with folds, cross-fitted cell nuisances and scores.

    The tables of cells are written: a kept table would carry the plan it was made by into every later plan that reads it, once for each time it is read."""
    folded = add_folds(units, folds) if folds > 1 else units.withColumn("fold", F.lit(0))
    st = materialise(cell_stats(folded, (outcome,)), "cell_stats")  # a row per cell, fold and arm
    wide = materialise(widen(cell_nuisance(st, arms, cross_fit=folds > 1), arms), "nuisances")
    return unit_scores(folded if outcome == "y" else folded.withColumn("y", F.col(outcome)), wide, arms)


def long_scores(scored: DataFrame, arms=cfg.ARMS, extra=()) -> DataFrame:
    """(unit_id, arm_received, y, arm, e, mu, phi): one row per unit and arm."""
    rows = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"e_{a}").alias("e"), F.col(f"mu_{a}").alias("mu"),
                              F.col(f"phi_{a}").alias("phi")) for a in arms])
    return scored.select("unit_id", F.col("arm").alias("arm_received"), "y", *extra, F.explode(rows).alias("__a")).select(
        "unit_id", "arm_received", "y", *extra, "__a.arm", "__a.e", "__a.mu", "__a.phi")


def target_values(prefix: str, arms=cfg.ARMS) -> list[tuple[str, Column]]:
    """(target, column) for every arm and contrast of wide columns ``prefix_<arm>``."""
    return [(n, F.col(f"{prefix}_{a}") - F.col(f"{prefix}_{b}") if b else F.col(f"{prefix}_{a}")) for n, a, b in cfg.targets(arms)]


def influence_estimates(df: DataFrame, psi: list[tuple[str, Column]], by=(), z: float = cfg.CI_Z,
                        method: str = "influence") -> DataFrame:
    """Mean and sd/√n of influence columns, one aggregate for all targets, rows (by, target, value, se, …)."""
    aggs = []
    for i, (_, c) in enumerate(psi):
        aggs += [F.avg(c).alias(f"__m{i}"), F.stddev_samp(c).alias(f"__d{i}")]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("target"), F.col(f"__m{i}").alias("value"),
                              (F.col(f"__d{i}") / F.sqrt("n")).alias("se")) for i, (name, _) in enumerate(psi)])
    out = wide.select(*by, "n", F.explode(rows).alias("__t")).select(*by, "n", "__t.target", "__t.value", "__t.se")
    return with_interval(out, z).withColumn("method", F.lit(method))


# Learners in cells mode


def cell_means(units: DataFrame, arms=cfg.ARMS) -> DataFrame:
    """T-learner in cells mode: mean outcome per (cell, arm), wide columns t_<arm>; missing arms take the arm mean."""
    st = materialise(cell_stats(units.drop("fold")), "cell_stats")  # a row per cell and arm
    wide = materialise(widen(cell_nuisance(st, arms, cross_fit=False), arms, ("cell",)), "cell_means")
    return wide.select("cell", *[F.col(f"mu_{a}").alias(f"t_{a}") for a in arms], *[F.col(f"e_{a}") for a in arms])


def additive_model(units: DataFrame, x: str, arms=cfg.ARMS) -> DataFrame:
    """S-learner in its linear form: one slope of ``x`` shared by the arms and one level per arm (a single row)."""
    s = units.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg("y").alias("my"),
        F.covar_pop(x, "y").alias("cxy"), F.var_pop(x).alias("vx"))
    slope = F.sum(F.col("n") * F.col("cxy")) / F.sum(F.col("n") * F.col("vx"))
    one = s.agg(slope.alias("slope"), *[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}_{a}") for a in arms for c in ("mx", "my")])
    return one.select("slope", *[(F.col(f"my_{a}") - F.col("slope") * F.col(f"mx_{a}")).alias(f"level_{a}") for a in arms])


def s_learner(units: DataFrame, new_units: DataFrame, x: str, arms=cfg.ARMS) -> DataFrame:
    """Predictions s_<arm> of the additive model for new units."""
    model = materialise(additive_model(units, x, arms), "additive")  # one row
    return new_units.crossJoin(F.broadcast(model)).select(  # one-row side
        "*", *[(F.col(f"level_{a}") + F.col("slope") * F.col(x)).alias(f"s_{a}") for a in arms]
    ).drop("slope", *[f"level_{a}" for a in arms])


def x_learner(units: DataFrame, x: str, first: str, second: str) -> DataFrame:
    """X-learner: cell means impute the other arm, a line in ``x`` smooths each arm's effects, propensity blends them."""
    two = units.where(F.col("arm").isin(first, second))
    base = cell_means(two, (first, second))
    j = two.join(small(base), "cell")
    effect = F.when(F.col("arm") == first, F.col("y") - F.col(f"t_{second}")).otherwise(F.col(f"t_{first}") - F.col("y"))
    j = j.withColumn("__d", effect)
    fits = j.groupBy("arm").agg(F.regr_slope("__d", x).alias("b"), F.regr_intercept("__d", x).alias("a"))
    one = fits.agg(*[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}{t}") for a, t in ((first, 1), (second, 0)) for c in ("a", "b")])
    tau1 = F.col("a1") + F.col("b1_") * F.col(x)
    one = one.withColumnRenamed("b1", "b1_").withColumnRenamed("b0", "b0_")
    tau0 = F.col("a0") + F.col("b0_") * F.col(x)
    e = F.col(f"e_{first}")
    return j.crossJoin(F.broadcast(one)).withColumn("tau", e * tau0 + (1 - e) * tau1).drop("a0", "a1", "b0_", "b1_", "__d")


def saturated_effect(stats: DataFrame, first: str, second: str, by=()) -> DataFrame:
    """G-computation with a saturated cell model: cell differences weighted by cell size; one-arm cells are left out."""
    g = stats.groupBy(*by, "cell").agg(
        F.sum("n").alias("n"),
        *[f for a, t in ((first, 1), (second, 0)) for f in (
            F.sum(F.when(F.col("arm") == a, F.col("n"))).alias(f"n{t}"), F.sum(F.when(F.col("arm") == a, F.col("sy"))).alias(f"s{t}"))])
    ok = (F.col("n1") > 0) & (F.col("n0") > 0)
    d = F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")
    return g.where(ok).groupBy(*by).agg((F.sum(F.col("n") * d) / F.sum("n")).alias("value"), F.sum("n").alias("n"))


def structural_mistakes(units: DataFrame, first: str, second: str, variants: dict[str, list[str]],
                        right: str) -> DataFrame:
    """The same estimate under several adjustment lists, with the distortion against the right one.

    One scan groups by every column used; each variant is a roll-up of that small table.
    """
    columns = sorted({c for v in variants.values() for c in v})
    base = units.where(F.col("arm").isin(first, second)).groupBy(*columns, "arm").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"))
    key = [F.struct(F.lit(v).alias("variant"),
                    F.concat_ws("|", F.lit("c"), *[F.col(c).cast("string") for c in cols]).alias("cell"))
           for v, cols in variants.items()]
    tagged = base.withColumn("__v", F.explode(F.array(*key))).select(
        "__v.variant", "__v.cell", "arm", "n", "sy")
    est = saturated_effect(tagged, first, second, ("variant",))
    ref = est.where(F.col("variant") == right).select(F.col("value").alias("__r"))
    return est.crossJoin(F.broadcast(ref)).withColumn("distortion", F.col("value") - F.col("__r")).drop("__r")


def subgroup_split(units: DataFrame, column: str, first: str, second: str) -> DataFrame:
    """The naive difference overall and inside each value of a column (grouping sets)."""
    g = units.where(F.col("arm").isin(first, second)).groupingSets(
        [[], [F.col(column)]], F.col(column)
    ).agg(
        F.grouping(column).alias("__all"),
        (F.avg(F.when(F.col("arm") == first, F.col("y"))) - F.avg(F.when(F.col("arm") == second, F.col("y")))).alias("value"),
        F.count(F.lit(1)).alias("n"),
    )
    overall = F.max(F.when(F.col("__all") == 1, F.col("value"))).over(W.partitionBy())
    label = F.when(F.col("__all") == 1, "all").otherwise(F.concat(F.lit(f"{column}="), F.col(column).cast("string")))
    return g.select(label.alias("subgroup"), "value", "n", (F.col("value") - overall).alias("distortion"))


def all_average_effects(units: DataFrame, arms=cfg.ARMS, outcomes=("y",)) -> DataFrame:
    """Naive, IPW and AIPW from one table of sums."""
    st = cell_stats(add_folds(units), outcomes)
    nu = cell_nuisance(st, arms)
    return union_all([naive(st, arms), ipw(st, nu, arms), aipw(st, nu, arms)]).select(
        "outcome", "method", "target", "value", "se", "ci_low", "ci_high", "n")
