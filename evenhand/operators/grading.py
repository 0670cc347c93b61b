"""Grading estimates against planted truth, policy value and summaries over replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenhand import config as cfg
from evenhand.functions.hashing import hash_key
from evenhand.functions.ranking import exact_quantiles, global_rank, hash_rank, spearman
from evenhand.functions.stats import union_all

# 0.975 quantiles of Student's t for 1 to 30 degrees of freedom, beyond that an expansion in 1/df.
T_975 = {1: 12.7062, 2: 4.3027, 3: 3.1824, 4: 2.7764, 5: 2.5706, 6: 2.4469, 7: 2.3646, 8: 2.3060, 9: 2.2622, 10: 2.2281,
         11: 2.2010, 12: 2.1788, 13: 2.1604, 14: 2.1448, 15: 2.1314, 16: 2.1199, 17: 2.1098, 18: 2.1009, 19: 2.0930, 20: 2.0860,
         21: 2.0796, 22: 2.0739, 23: 2.0687, 24: 2.0639, 25: 2.0595, 26: 2.0555, 27: 2.0518, 28: 2.0484, 29: 2.0452, 30: 2.0423}


def t_quantile(df: Column) -> Column:
    """0.975 quantile of Student's t: the table up to 30 degrees of freedom, then the expansion about the normal quantile (to 1e-6)."""
    z = cfg.CI_Z
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    out = F.lit(z)
    for i, t in enumerate(terms, 1):
        out = out + F.lit(t) / F.pow(df.cast("double"), F.lit(float(i)))
    for n in sorted(T_975, reverse=True):
        out = F.when(df <= n, F.lit(T_975[n])).otherwise(out)
    return out


# Replicates


def replicate_scores(est: DataFrame, truth: DataFrame) -> DataFrame:
    """(method, target, true_value, mean_estimate, bias, rmse, coverage, mean_width, n_reps)."""
    j = est.join(truth, "target")
    err = F.col("value") - F.col("true_value")
    hit = (F.col("ci_low") <= F.col("true_value")) & (F.col("true_value") <= F.col("ci_high"))
    return j.groupBy("method", "target").agg(
        F.max("true_value").alias("true_value"), F.avg("value").alias("mean_estimate"), F.avg(err).alias("bias"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(hit.cast("double")).alias("coverage"), F.avg(F.col("ci_high") - F.col("ci_low")).alias("mean_width"), F.count(F.lit(1)).alias("n_reps"))


def mean_ci(df: DataFrame, by, value: str = "value") -> DataFrame:
    """Mean over replicates with a 95 % t interval; NaN is left out, one replicate has no interval."""
    v = F.when(~F.isnan(value), F.col(value))
    g = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("__sd"), F.count(v).alias("n_reps"))
    half = F.when(F.col("n_reps") > 1, t_quantile(F.col("n_reps") - 1) * F.col("__sd") / F.sqrt("n_reps"))
    return g.select(*by, "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"), "n_reps")


def paired(df: DataFrame, first: str, second: str, keys) -> DataFrame:
    """Second minus first version on the same replicate, as rows of version 'second-first'."""
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col("version") == v, F.col("value"))).alias(f"__{i}") for i, v in enumerate((first, second))])
    out = wide.where(F.col("__0").isNotNull() & F.col("__1").isNotNull())
    return out.select(F.lit(f"{second}-{first}").alias("version"), *keys, (F.col("__1") - F.col("__0")).alias("value"))


def change_verdict(summary: DataFrame, first: str, second: str) -> DataFrame:
    """(metric, comparison, a, b, relative, verdict, words) from summary rows of both versions and their paired row.

    ``kind`` is bias, lower, share_up, share_down or coverage; an improvement counts only if the paired interval excludes 0.
    """
    keys = ["metric", "comparison", "kind"]
    pick = lambda v, c: F.max(F.when(F.col("version") == v, F.col(c)))
    pair = f"{second}-{first}"
    w = summary.groupBy(*keys).agg(pick(first, "mean").alias("a"), pick(second, "mean").alias("b"), pick(pair, "ci_low").alias("lo"), pick(pair, "ci_high").alias("hi"))
    a, b = F.col("a"), F.col("b")
    rel = (F.when(F.col("kind") == "bias", (F.abs(a) - F.abs(b)) / F.nullif(F.abs(a), F.lit(0.0))).when(F.col("kind") == "share_up", (b - a) / F.nullif(a, F.lit(0.0)))
           .when(F.col("kind") != "coverage", (a - b) / F.nullif(a, F.lit(0.0))))
    unclear = F.coalesce((F.col("lo") <= 0) & (F.col("hi") >= 0), F.lit(False))
    verdict = (F.when(F.col("kind") == "coverage", "not comparable").when(F.coalesce(rel, F.lit(0.0)) <= 0, "no improvement")
               .when(unclear, "not a clear difference").otherwise("better"))
    better = rel > 0
    noun = (F.when(F.col("kind") == "bias", F.when(better, "smaller bias").otherwise("larger bias")).when(F.col("kind") == "lower", F.when(better, "lower").otherwise("higher"))
            .when(F.col("kind") == "share_up", F.when(better, "more").otherwise("fewer")).when(F.col("kind") == "share_down", F.when(better, "fewer").otherwise("more")))
    words = F.when(F.col("kind") == "coverage", "only the second version gives an interval").otherwise(
        F.concat(F.round(F.abs(rel) * 100, 0).cast("int").cast("string"), F.lit("% "), noun))
    return w.select("metric", "comparison", a, b, rel.alias("relative"), verdict.alias("verdict"), words.alias("words"))


# Policies, one unit per row: no grouping by unit is needed


def _ordered(prefix: str, arms, allowed: str):
    return [F.when(F.col(f"{allowed}_{a}"), F.struct(F.col(f"{prefix}_{a}").alias("v"), F.lit(i).alias("i"), F.col(f"mu_true_{a}").alias("t")))
            for i, a in enumerate(arms)]


def choose(df: DataFrame, prefix: str, arms=cfg.ARMS, allowed: str = "allowed") -> DataFrame:
    """Adds chosen (arm with the lowest prediction among allowed arms; first arm wins ties), best (truly best), regret."""
    names = F.array(*[F.lit(a) for a in arms])
    pick, best = F.array_min(F.array_compact(F.array(*_ordered(prefix, arms, allowed)))), F.array_min(F.array_compact(F.array(*_ordered("mu_true", arms, allowed))))
    out = df.withColumn("__c", pick).withColumn("__b", best)
    return out.withColumn("chosen", F.element_at(names, F.col("__c.i") + 1)).withColumn("best", F.element_at(names, F.col("__b.i") + 1)).withColumn(
        "regret", F.col("__c.t") - F.col("__b.t")).withColumn("n_allowed", sum(F.col(f"{allowed}_{a}").cast("int") for a in arms)).drop("__c", "__b")


def policy_summary(chosen: DataFrame, by=()) -> DataFrame:
    return chosen.groupBy(*by).agg(
        F.avg("regret").alias("regret"), F.count("chosen").alias("decided"), F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("n_allowed") >= 2, (F.col("chosen") == F.col("best")).cast("double"))).alias("best_pick_rate"))


def thin_metrics(df: DataFrame, effects: list[tuple[str, Column, Column]], arms=cfg.ARMS, limit: float = cfg.OVERLAP_MIN) -> DataFrame:
    """(metric, comparison, value): thin units are those whose smallest true propensity is below the limit."""
    thin = F.least(*[F.col(f"e_true_{a}") for a in arms]) < limit
    answered = F.greatest(*[F.col(f"allowed_{a}").cast("int") for a in arms])
    pairs = sum(F.when(F.col(f"safe_{a}") & (F.col(f"e_true_{a}") < limit), 1).otherwise(0) for a in arms)
    pair_hits = sum(F.when(F.col(f"safe_{a}") & (F.col(f"e_true_{a}") < limit) & F.col(f"allowed_{a}"), 1).otherwise(0) for a in arms)
    aggs = [("thin_share", "all", F.avg(thin.cast("double"))), ("answered_when_thin", "all", F.avg(F.when(thin, answered))),
            ("answered_when_thin_pairs", "all", F.sum(pair_hits) / F.nullif(F.sum(pairs), F.lit(0)))]
    for name, est, tr in effects:
        sq = (est - tr) * (est - tr)
        aggs += [("pehe_thin", name, F.sqrt(F.avg(F.when(thin, sq)))), ("pehe_not_thin", name, F.sqrt(F.avg(F.when(~thin, sq))))]
    one = df.agg(*[c.alias(f"__{i}") for i, (_, _, c) in enumerate(aggs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("comparison"), F.col(f"__{i}").cast("double").alias("value"))
                                         for i, (m, c, _) in enumerate(aggs)])))


def coverage_by_level(df: DataFrame, levels=("Moderate", "Low", "Insufficient"), arms=cfg.ARMS) -> DataFrame:
    """Interval coverage by evidence level and arm plus 'all'; empty cells are kept. Needs level, arm, hit, width."""
    g = df.groupingSets([[F.col("level"), F.col("arm")], [F.col("level")]], F.col("level"), F.col("arm")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("coverage"), F.avg("width").alias("mean_width"))
    total = df.agg(F.count(F.lit(1)).alias("__t"))
    grid = df.sparkSession.createDataFrame([(lv, a) for lv in levels for a in (*arms, "all")], "level string, option string")
    cells = g.select("level", F.coalesce("arm", F.lit("all")).alias("option"), "n", "coverage", "mean_width")
    out = grid.join(cells, ["level", "option"], "left").crossJoin(F.broadcast(total))
    return out.select("level", "option", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.coalesce("n", F.lit(0)) / F.col("__t")).alias("share"), "coverage", "mean_width")


# Calibration, curves, rankings


def calibration(df: DataFrame, pred: str, truth: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_pred, mean_true) by quantile edges of the prediction."""
    q = exact_quantiles(df, pred, [i / bins for i in range(1, bins)]).agg(F.sort_array(F.collect_list("value")).alias("__e"))
    b = F.size(F.filter("__e", lambda x: x <= F.col(pred)))
    return df.crossJoin(F.broadcast(q)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(pred).alias("mean_pred"), F.avg(truth).alias("mean_true"))


def rolling_mean(df: DataFrame, order: str, tie: str, value: str, width: int, block: int = 4096) -> DataFrame:
    """Rolling mean of an odd ``width`` along a sorted column, edges padded with the end values: adds rank, smooth.

    Ranks are cut into blocks; a block also gets the few rows its neighbours' windows need, so blocks run apart.
    """
    half = width // 2
    block = max(block, half + 1)
    r = global_rank(df.select(tie, order, value), order, tie, "rank")
    n_rows = df.agg(F.count(F.lit(1)).alias("__n"))
    home = F.floor((F.col("rank") - 1) / block)
    near = F.array_distinct(F.array(F.floor((F.col("rank") - 1 - half) / block), home, F.floor((F.col("rank") - 1 + half) / block)))
    rows = r.withColumn("__home", home).withColumn("__blk", F.explode(near)).where(F.col("__blk") >= 0)
    w = W.partitionBy("__blk").orderBy("rank").rowsBetween(-half, half)
    got = rows.withColumn("__s", F.sum(value).over(w)).withColumn("__c", F.count(value).over(w)).where(F.col("__blk") == F.col("__home"))
    ends = r.agg(F.min(F.struct("rank", value)).getField(value).alias("__first"), F.max(F.struct("rank", value)).getField(value).alias("__last"))
    j = got.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(n_rows))
    below, above = F.greatest(half - (F.col("rank") - 1), F.lit(0)), F.greatest(half - (F.col("__n") - F.col("rank")), F.lit(0))
    return j.select(tie, order, value, "rank", ((F.col("__s") + below * F.col("__first") + above * F.col("__last")) / width).alias("smooth"))


def leaderboard(est: DataFrame, truth: DataFrame) -> DataFrame:
    """Each estimate against the truth: error, coverage, sign."""
    j = est.join(truth, "target")
    return j.select("method", "target", "value", "true_value", (F.col("value") - F.col("true_value")).alias("error"), F.abs(F.col("value") - F.col("true_value")).alias("abs_error"),
                    ((F.col("ci_low") <= F.col("true_value")) & (F.col("true_value") <= F.col("ci_high"))).alias("covers"),
                    (F.signum("value") == F.signum("true_value")).alias("right_sign")).orderBy("abs_error")


def effect_leaderboard(long: DataFrame) -> DataFrame:
    """(learner, …) from long rows (learner, pred, truth): errors, rank correlation, sign agreement, spreads."""
    p, t = F.col("pred"), F.col("truth")
    g = long.groupBy("learner").agg(
        F.avg(p).alias("mean_effect"), (F.avg(p) - F.avg(t)).alias("ate_error"), F.avg(F.abs(p - t)).alias("mae"), F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"),
        F.avg((F.signum(p) == F.signum(t)).cast("double")).alias("sign_agreement"), F.stddev_samp(p).alias("spread"), F.stddev_samp(t).alias("true_spread"))
    return g.join(spearman(long, "pred", "truth", ("learner",)), "learner").withColumn("rank_corr", F.coalesce("spearman", F.lit(0.0))).drop("spearman")


def policy_comparison(df: DataFrame, truth: str, models: dict[str, str], threshold: float = 0.0) -> DataFrame:
    """Gain, share treated and regret of treat-all, treat-none, each model's sign and the oracle: one aggregate."""
    t = F.col(truth)
    rules = {"treat everyone": F.lit(1.0), "treat nobody": F.lit(0.0), **{f"follow {n}": (F.col(c) > threshold).cast("double") for n, c in models.items()},
             "oracle": (t > threshold).cast("double")}
    aggs = [f for i, d in enumerate(rules.values()) for f in (F.avg(d * t).alias(f"v{i}"), F.avg(d).alias(f"f{i}"))]
    one = df.agg(F.avg(F.greatest(t, F.lit(0.0))).alias("best"), *aggs)
    rows = [F.struct(F.lit(n).alias("policy"), F.col(f"v{i}").alias("gain"), F.col(f"f{i}").alias("treated"), (F.col("best") - F.col(f"v{i}")).alias("regret")) for i, n in enumerate(rules)]
    return one.select(F.inline(F.array(*rows)))


def top_share_gain(df: DataFrame, score: str, truth: str, tie: str, shares: list[float]) -> DataFrame:
    """(share, n_treated, gain, mean_effect, random_gain): treat the top share by score; exact ranks, running sums."""
    r = global_rank(df.select(tie, score, truth), score, tie, "rank", descending=True, sum_cols={truth: "__run"})
    tot = df.agg(F.count(F.lit(1)).alias("__n"), F.avg(truth).alias("__avg"))
    grid = tot.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares]))).withColumn(
        "rank", F.greatest(F.lit(1), F.round(F.col("share") * F.col("__n"))).cast("bigint"))
    j = r.join(F.broadcast(grid), "rank")  # one row per share
    return j.select("share", F.col("rank").alias("n_treated"), (F.col("__run") / F.col("__n")).alias("gain"), (F.col("__run") / F.col("rank")).alias("mean_effect"),
                    (F.col("__avg") * F.col("share")).alias("random_gain"))


def holdout(df: DataFrame, fraction: float = 0.3, salt: str = "split") -> DataFrame:
    """Adds ``test``: a seeded share of every arm, by position in its hash order."""
    keyed = hash_rank(df.withColumn("__h", hash_key("unit_id", salt)), "__h", "__rk", by=("arm",), keep=False)
    size = df.groupBy("arm").agg(F.count(F.lit(1)).alias("__na"))
    return keyed.join(size, "arm").withColumn("test", F.col("__rk") <= F.round(F.col("__na") * fraction)).drop("__h", "__rk", "__na")


def two_implementations(ours: DataFrame, other: DataFrame, same: float = 0.02, different: float = 0.10) -> DataFrame:
    """(target, ours, theirs, gap, tolerance, agree); ``same_estimator`` on the right side picks the tolerance."""
    j = ours.select("target", F.col("value").alias("ours")).join(other.select("target", F.col("value").alias("theirs"), "same_estimator"), "target")
    gap, tol = F.abs(F.col("ours") - F.col("theirs")), F.when(F.col("same_estimator"), same).otherwise(different)
    return j.select("target", "ours", "theirs", gap.alias("gap"), tol.alias("tolerance"), (gap < tol).alias("agree"))
