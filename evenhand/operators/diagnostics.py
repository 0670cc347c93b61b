"""Overlap, balance, refutation and sensitivity of an effect estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand import config as cfg
from evenhand.functions.hashing import hash_key, noise, uniform
from evenhand.functions.ranking import exact_quantiles, hash_threshold
from evenhand.functions.stats import fsum, small, union_all
from evenhand.operators import effects as E
from evenhand.session import materialise


def overlap_report(scored: DataFrame, first: str, second: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: range of e per arm, extreme count, largest weight, effective sample size, shared width, verdict."""
    e, t = F.col("e"), F.col("arm") == first
    w = F.when(t, 1 / F.greatest(e, F.lit(1e-12))).otherwise(1 / F.greatest(1 - e, F.lit(1e-12)))
    one = scored.where(F.col("arm").isin(first, second)).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(t, e)).alias("min_first"), F.max(F.when(t, e)).alias("max_first"),
        F.min(F.when(~t, e)).alias("min_second"), F.max(F.when(~t, e)).alias("max_second"),
        F.sum(((e < low) | (e > high)).cast("bigint")).alias("n_extreme"), F.max(w).alias("max_weight"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))
    width = F.least("max_first", "max_second") - F.greatest("min_first", "min_second")
    verdict = (F.when(F.col("shared_width") <= 0, "VIOLATED")
               .when((F.col("ess") < 0.4 * F.col("n")) | (F.col("max_weight") > 50), "FRAGILE")
               .when(F.col("n_extreme") > 0.05 * F.col("n"), "ACCEPTABLE").otherwise("SATISFIED"))
    return one.withColumn("shared_width", width).withColumn("verdict", verdict)


def propensity_histogram(long: DataFrame, bins: int = 40) -> DataFrame:
    """(arm, arm_received, bin, n): bins on [0, 1], the last one closed."""
    b = F.least(F.floor(F.col("e") * bins), F.lit(bins - 1)).cast("int")
    return long.groupBy("arm", "arm_received", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def trim(scored: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Only units with a propensity inside the bounds."""
    return scored.where((F.col("e") >= low) & (F.col("e") <= high))


def trim_audit(scored: DataFrame, covariates, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(covariate, kept, dropped, kept_mean, dropped_mean): what trimming removes."""
    keep = (F.col("e") >= low) & (F.col("e") <= high)
    one = scored.agg(F.sum(keep.cast("bigint")).alias("kept"), F.sum((~keep).cast("bigint")).alias("dropped"),
                     *[f for c in covariates for f in (F.avg(F.when(keep, F.col(c))).alias(f"k_{c}"), F.avg(F.when(~keep, F.col(c))).alias(f"d_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(f"k_{c}").alias("kept_mean"), F.col(f"d_{c}").alias("dropped_mean")) for c in covariates])
    return one.select("kept", "dropped", F.inline(rows))


def _arm_moments(df: DataFrame, covariates, weight: Column | None) -> DataFrame:
    """(covariate, arm, m, v, wm): plain and weighted mean and sample variance; one aggregate over the rows."""
    w = F.lit(1.0) if weight is None else weight
    aggs = [F.sum(w).alias("__w")]
    for i, c in enumerate(covariates):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}"), F.sum(w * x).alias(f"s{i}")]
    per = df.groupBy("arm").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"),
                              (F.col(f"s{i}") / F.col("__w")).alias("wm")) for i, c in enumerate(covariates)])
    return per.select("arm", F.inline(rows))


def balance_table(df: DataFrame, covariates, weight: Column, limit: float = cfg.SMD_LIMIT) -> DataFrame:
    """Largest absolute SMD over pairs of arms, before and after weighting (pooled sd always unweighted)."""
    m = _arm_moments(df, covariates, weight)
    a, b = m.alias("a"), m.alias("b")
    pair = a.join(b, (F.col("a.covariate") == F.col("b.covariate")) & (F.col("a.arm") < F.col("b.arm")))
    sd = F.sqrt((F.col("a.v") + F.col("b.v")) / 2)

    def smd(c):
        return F.when(sd == 0, F.lit(0.0)).otherwise(F.abs((F.col(f"a.{c}") - F.col(f"b.{c}")) / sd))

    out = pair.groupBy(F.col("a.covariate").alias("covariate")).agg(F.max(smd("m")).alias("smd_before"), F.max(smd("wm")).alias("smd_after"))
    return out.withColumn("improved", F.col("smd_after") < F.col("smd_before")).withColumn("balanced", F.col("smd_after") < limit)


def confounding_table(df: DataFrame, covariates, first: str, second: str, limit: float = cfg.SMD_LIMIT) -> DataFrame:
    """(covariate, mean_first, mean_second, difference, smd, balanced) without weights."""
    m = _arm_moments(df.where(F.col("arm").isin(first, second)), covariates, None)
    w = m.groupBy("covariate").agg(*[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}{t}") for a, t in ((first, 1), (second, 0)) for c in ("m", "v")])
    sd, d = F.sqrt((F.col("v1") + F.col("v0")) / 2), F.col("m1") - F.col("m0")
    out = w.select("covariate", F.col("m1").alias("mean_first"), F.col("m0").alias("mean_second"), d.alias("difference"),
                   F.when(sd == 0, F.lit(0.0)).otherwise(d / sd).alias("smd"))
    return out.withColumn("balanced", F.abs("smd") < limit)


def evalue_of_ratio(rr: Column) -> Column:
    r = F.when(rr < 1, 1 / rr).otherwise(rr)
    return r + F.sqrt(r * (r - 1))


def e_values(estimates: DataFrame, sd: Column, slope: float = cfg.EVALUE_SLOPE) -> DataFrame:
    """Adds evalue, evalue_ci (1 if the interval crosses 0) and robustness from value, ci_low, ci_high."""
    nearest = F.when(F.col("value") < 0, F.col("ci_high")).otherwise(F.col("ci_low"))
    crosses = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
    point = evalue_of_ratio(F.exp(slope * F.col("value") / sd))
    ci = F.when(crosses, F.lit(1.0)).otherwise(evalue_of_ratio(F.exp(slope * nearest / sd)))
    band = F.when(F.col("evalue_ci") < 1.25, "very fragile").when(F.col("evalue_ci") < 2, "moderately robust").when(
        F.col("evalue_ci") < 4, "robust").otherwise("very robust")
    return estimates.withColumn("evalue", point).withColumn("evalue_ci", ci).withColumn("robustness", band)


def confounder_strength(units: DataFrame, column: str, first: str, second: str, slope: float = cfg.EVALUE_SLOPE) -> DataFrame:
    """One row: treatment leg, outcome leg and the weaker of the two for an observed column (top against bottom quarter)."""
    two = units.where(F.col("arm").isin(first, second))
    q = exact_quantiles(two, column, [0.25, 0.75]).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("__lo"), F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("__hi"))
    j = two.crossJoin(F.broadcast(q))  # one-row side
    t = F.when(F.col("arm") == first, 1.0).otherwise(0.0)
    top, low = F.col(column) >= F.col("__hi"), F.col(column) <= F.col("__lo")
    one = j.agg(F.avg(F.when(top, t)).alias("p_top"), F.avg(F.when(low, t)).alias("p_low"), F.avg(F.when(top, F.col("y"))).alias("y_top"),
                F.avg(F.when(low, F.col("y"))).alias("y_low"), F.stddev_samp("y").alias("sd"))
    rr_t = F.greatest("p_top", "p_low") / F.greatest(F.least("p_top", "p_low"), F.lit(1e-9))
    rr_y = F.exp(slope * F.abs(F.col("y_top") - F.col("y_low")) / F.col("sd"))
    return one.select(rr_t.alias("rr_treatment"), rr_y.alias("rr_outcome"), F.least(rr_t, rr_y).alias("strength"))


def strength_verdict(strength: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """Adds quoted (the E-value of the interval, else of the point) and whether the observed column is strong enough to erase the finding."""
    quoted = F.when(F.col("evalue_ci") > 0, F.col("evalue_ci")).otherwise(F.col("evalue"))
    j = strength.crossJoin(F.broadcast(sensitivity.select(quoted.alias("quoted"))))  # two one-row inputs
    return j.withColumn("judgement", F.when(F.col("strength") >= F.col("quoted"), "erased").otherwise("survives"))


def audit(overlap: DataFrame, balance: DataFrame, sensitivity: DataFrame, least: float = 1.25) -> DataFrame:
    """One row: safe to report only with overlap, balance and a robust interval (three one-row inputs)."""
    bad = balance.agg(F.sum((~F.col("balanced")).cast("bigint")).alias("n_unbalanced"))
    j = overlap.select("verdict").crossJoin(bad).crossJoin(sensitivity.select("evalue_ci"))
    safe = (F.col("verdict") != "VIOLATED") & (F.col("n_unbalanced") == 0) & (F.col("evalue_ci") >= least)
    return j.withColumn("safe_to_report", safe)


# Refutation


def placebo_arms(units: DataFrame, repeats: int, arms=cfg.ARMS) -> DataFrame:
    """Every unit ``repeats`` times with the arm column permuted (same arm counts): adds ``rep``.

    A permutation is a cut of the seeded hash order at the arms' cumulative counts. Only the cuts are looked up (one small
    bucket per cut is sorted); arms are then attached by comparing the hash, without ranking the rows.
    """
    counts = {r["arm"]: r["n"] for r in units.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per arm
    cuts, total = [], 0
    for a in arms[:-1]:
        total += counts.get(a, 0)
        cuts.append(total)
    rep = units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("__key", hash_key("unit_id", F.lit("perm"), F.col("rep")))
    want = units.sparkSession.range(1, repeats + 1).select(F.col("id").cast("int").alias("rep"), F.explode(F.array(*[F.lit(c) for c in cuts])).alias("k"))
    found = hash_threshold(rep.select("rep", "__key"), "__key", want, by=("rep",))
    wide = materialise(found.groupBy("rep").agg(*[F.max(F.when(F.col("k") == c, F.col("threshold"))).alias(f"__c{i}") for i, c in enumerate(cuts)]), "cuts")
    arm = F.lit(arms[-1])
    for i in reversed(range(len(cuts))):
        arm = F.when(F.col("__key") <= F.coalesce(F.col(f"__c{i}"), F.lit("")), arms[i]).otherwise(arm)
    return rep.join(small(wide), "rep").withColumn("arm", arm).drop("__key", *[f"__c{i}" for i in range(len(cuts))])


def placebo_estimates(folded: DataFrame, repeats: int = 20, arms=cfg.ARMS) -> DataFrame:
    """Cross-fitted AIPW of every permuted copy: (rep, target, value, se, ci_low, ci_high), one grouped pass."""
    st = E.cell_stats(placebo_arms(folded, repeats, arms), by=("rep",))
    return E.aipw(st, E.cell_nuisance(st, arms, ("rep", "outcome")), arms, ("rep", "outcome"))


def noisy_cells(folded: DataFrame, bins: int = 2, salt: str = "noise") -> DataFrame:
    """The cell split further by a column of pure noise (a random common cause)."""
    extra = F.floor(uniform("unit_id", salt) * bins).cast("string")
    return folded.withColumn("cell", F.concat_ws("|", F.col("cell").cast("string"), extra))


def subset(folded: DataFrame, fraction: float = 0.8, draws: int = 1) -> DataFrame:
    """A seeded share of the units, once per draw: adds ``draw``."""
    out = folded.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return out.where(uniform("unit_id", F.lit("sub"), F.col("draw")) < fraction)


def refutation_table(folded: DataFrame, arms=cfg.ARMS, repeats: int = 20, fraction: float = 0.8, multiple: float = 2.0,
                     share: float = 0.85) -> DataFrame:
    """(check, target, original, original_se, new_value, new_low, new_high, criterion, passed)."""
    def run(units):
        st = E.cell_stats(units)
        return E.aipw(st, E.cell_nuisance(st, arms), arms).where(F.col("target").contains("-"))

    orig = run(folded).select("target", F.col("value").alias("original"), F.col("se").alias("original_se"))
    placebo = placebo_estimates(folded, repeats, arms).where(F.col("target").contains("-")).groupBy("target").agg(
        F.avg("value").alias("new_value"), F.avg("ci_low").alias("new_low"), F.avg("ci_high").alias("new_high"),
        F.avg(((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).cast("double")).alias("__share"))
    stable = union_all([
        run(noisy_cells(folded)).select(F.lit("random common cause").alias("check"), "target", "value", "ci_low", "ci_high"),
        run(subset(folded, fraction)).select(F.lit("data subset").alias("check"), "target", "value", "ci_low", "ci_high"),
    ]).join(orig, "target").select(
        "check", "target", "original", "original_se", F.col("value").alias("new_value"), F.col("ci_low").alias("new_low"), F.col("ci_high").alias("new_high"),
        F.lit(f"within {multiple:g} SE of original").alias("criterion"), (F.abs(F.col("value") - F.col("original")) <= multiple * F.col("original_se")).alias("passed"))
    shuffled = placebo.join(orig, "target").select(
        F.lit("placebo treatment").alias("check"), "target", "original", "original_se", "new_value", "new_low", "new_high",
        F.concat(F.round(F.col("__share") * 100, 0).cast("int").cast("string"), F.lit(f"% of {repeats} placebo intervals contain 0")).alias("criterion"),
        (F.col("__share") >= share).alias("passed"))
    return shuffled.unionByName(stable)


def unobserved_confounder(folded: DataFrame, strengths, first: str, second: str, truth: Column | float) -> DataFrame:
    """Shift the outcome by a simulated confounder tied to treatment at several strengths and re-estimate.

    (strength, value, bias, sign_flipped); all strengths share one pass.
    """
    two = folded.where(F.col("arm").isin(first, second))
    t = F.when(F.col("arm") == first, 1.0).otherwise(0.0)
    mean = two.agg(F.avg(t).alias("__mt"))
    s = F.col("strength")
    rows = two.crossJoin(F.broadcast(mean)).withColumn("strength", F.explode(F.array(*[F.lit(float(x)) for x in strengths])))
    u = noise("unit_id", F.lit("uc")) + s * (t - F.col("__mt"))
    shifted = rows.withColumn("y", F.col("y") - s * u * 0.5)
    arms = (first, second)
    st = E.cell_stats(shifted, by=("strength",))
    est = E.aipw(st, E.cell_nuisance(st, arms, ("strength", "outcome")), arms, ("strength", "outcome")).where(F.col("target") == f"{first}-{second}")
    tr = truth if isinstance(truth, Column) else F.lit(float(truth))
    return est.select("strength", "value", (F.col("value") - tr).alias("bias"), (F.signum("value") != F.signum(tr)).alias("sign_flipped"))
