"""C: treatment-effect estimation on the cohort and planted views."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand import config as cfg
from evenhand.functions.stats import rnd, small, union_all
from evenhand.operators import effects as E
from evenhand.operators import linear as L
from evenhand.operators import learners as M
from evenhand.operators import matching as N

from evenhand.plans import sqlviews as V
from evenhand.plans.registry import query
from evenhand.sources import tables as T

EST = ["target", "value", "se", "ci_low", "ci_high", "n"]
NUM = ["value", "se", "ci_low", "ci_high"]


def est(df, extra=()):
    return rnd(df.select(*extra, *EST).withColumn("n", F.col("n").cast("bigint")))


def est_sql(select, ctes, extra=()):
    return V.rounded(select, [*extra, "target", "cast(n as bigint) n"], NUM, ctes=ctes)


def _naive_sql(src, by=""):
    b = f"{by}," if by else ""
    one = f"na as (select {b} arm, avg(y) m, var_samp(y)/count(*) v, count(*) n from {src} group by all)"
    on = " and ".join(f"p.{x}=q.{x}" for x in by.split(",")) if by else "true"
    pb = ",".join(f"p.{x} {x}" for x in by.split(",")) + "," if by else ""
    sel = f"""select {b} target, value, sqrt(v) se, value-1.959964*sqrt(v) ci_low, value+1.959964*sqrt(v) ci_high, n from (
      select {b} arm target, m value, v, n from na union all
      select {pb} p.arm||'-'||q.arm target, p.m-q.m, p.v+q.v, p.n+q.n from na p join na q on {on} and p.arm<q.arm)"""
    return sel, one


_s, _c = _naive_sql("cohort")


@query("c01_naive", est_sql(_s, V.COHORT + "," + _c))
def c01(spark, sf):
    return est(E.naive(E.cell_stats(T.cohort(spark, sf))))


@query("c02_influence", est_sql(V.influence("sc"), V.FULL_FIT))
def c02(spark, sf):
    sc = E.scored_cohort(T.cohort(spark, sf))
    return est(E.influence_estimates(sc, E.target_values("phi")))


@query("c03_propensity_logistic")
def c03(spark, sf):
    """Fitted minus true propensity on the planted view: mean and mean absolute gap per arm."""
    got = M.logistic_propensity(T.planted(spark, sf), ["x1", "b1", "b2"])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"e_{a}").alias("e"), F.col(f"e_true_{a}").alias("t"))
                               for a in cfg.ARMS]))
    return rnd(got.select(rows.alias("r")).groupBy("r.arm").agg(
        F.avg(F.col("r.e") - F.col("r.t")).alias("mean_gap"), F.avg(F.abs(F.col("r.e") - F.col("r.t"))).alias("mean_abs_gap"),
        F.count(F.lit(1)).alias("n")), 3)


@query("c04_propensity_cells", V.rounded(
    "select cell, arm, count(*)*1.0/sum(count(*)) over (partition by cell) e, count(*) n from cohort group by cell, arm",
    ["cell", "arm", "n"], ["e"], ctes=V.COHORT))
def c04(spark, sf):
    st = E.cell_stats(T.cohort(spark, sf))
    nu = E.cell_nuisance(st, cross_fit=False, floor=0.0).where("n_out > 0")
    return rnd(nu.select("cell", "arm", F.col("n_out").cast("bigint").alias("n"), "e"))


@query("c05_folds", "with " + V.COHORT + "," + V.folds("cohort") + " select fold, arm, count(*) n, cast(sum(unit_id) as bigint) ids from f group by all")
def c05(spark, sf):
    f = E.add_folds(T.cohort(spark, sf))
    return f.groupBy("fold", "arm").agg(F.count(F.lit(1)).alias("n"), F.sum("unit_id").alias("ids"))


@query("c06_crossfit_propensity", V.rounded("select cell, fold, arm, e_raw from nz", ["cell", "fold", "arm"], ["e_raw"],
                                            ctes=V.COHORT + "," + V.folds("cohort") + "," + V.nuisance("f")))
def c06(spark, sf):
    nu = E.cell_nuisance(E.cell_stats(E.add_folds(T.cohort(spark, sf))))
    return rnd(nu.select("cell", "fold", "arm", "e_raw"))


@query("c06_crossfit_logistic")
def c06_logistic(spark, sf):
    """Each fold scored by the logistic model of the others: fitted minus true propensity per arm."""
    got = M.logistic_propensity(E.add_folds(T.planted(spark, sf)), ["x1", "b1", "b2"], folds=cfg.FOLDS)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"e_{a}").alias("e"), F.col(f"e_true_{a}").alias("t")) for a in cfg.ARMS]))
    return rnd(got.select(rows.alias("r")).groupBy("r.arm").agg(F.avg(F.col("r.e") - F.col("r.t")).alias("mean_gap"), F.avg(F.abs(F.col("r.e") - F.col("r.t"))).alias("mean_abs_gap"), F.count(F.lit(1)).alias("n")), 3)


@query("c07_clip", V.rounded(
    "select arm, count(*) n, sum(case when e_raw<0.2 then 1 else 0 end) clipped, min(e) lowest, max(e) highest, sum(e*cell_n) mass "
    "from (select *, greatest(e_raw,0.2)/sum(greatest(e_raw,0.2)) over (partition by cell) e from "
    " (select cell, arm, count(*) cell_n, count(*)*1.0/sum(count(*)) over (partition by cell) e_raw from cohort group by cell, arm)) group by arm",
    ["arm", "n", "cast(clipped as bigint) clipped"], ["lowest", "highest", "mass"], ctes=V.COHORT))
def c07(spark, sf):
    nu = E.cell_nuisance(E.cell_stats(T.cohort(spark, sf)), cross_fit=False, floor=0.2)
    return rnd(nu.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("e_raw") < 0.2).cast("bigint")).alias("clipped"), F.min("e").alias("lowest"),
        F.max("e").alias("highest"), F.sum(F.col("e") * F.col("n_out")).alias("mass")))


def _hajek(arms=("A", "B", "C")):
    m = ", ".join(f"sum(case when arm='{a}' then y/e_{a} end)/sum(case when arm='{a}' then 1/e_{a} end) m_{a}, "
                  f"sum(case when arm='{a}' then 1/e_{a} end)/count(*) w_{a}" for a in arms)
    psi = ", ".join(f"case when arm='{a}' then (y-m_{a})/e_{a}/w_{a} else 0 end + m_{a} psi_{a}" for a in arms)
    return f"hm as (select {m} from sc), hp as (select {psi} from sc, hm)"


@query("c08_ipw_hajek", est_sql(V.influence("hp", "psi"), V.FULL_FIT + "," + _hajek()))
def c08(spark, sf):
    st = E.cell_stats(E.add_folds(T.cohort(spark, sf)))
    return est(E.ipw(st, E.cell_nuisance(st)))


TWO = V.COHORT + ", two as (select *, 0 fold from cohort where arm in ('A','B'))," + V.nuisance("two", arms=("A", "B"), cross=False) + "," + V.scores("two", arms=("A", "B"))
_C09 = TWO + """, m as (select sum(case when arm='A' then y/e_A end) wy1, sum(case when arm='B' then y/e_B end) wy0,
  sum(case when arm='A' then 1/e_A end) w1, sum(case when arm='B' then 1/e_B end) w0, count(*) n from sc),
 fm as (select 'hajek' method, wy1/w1 p1, wy0/w0 p0 from m union all select 'horvitz_thompson', wy1/n, wy0/n from m),
 ps as (select method, p1-p0 value, case when arm='A' then (y-p1)/e_A else -(y-p0)/e_B end psi,
   case when arm='A' then 1/e_A else 1/e_B end w from sc, fm)"""


@query("c09_ipw_two_forms", V.rounded(
    "select method, 'A-B' target, max(value) value, stddev_samp(psi)/sqrt(count(*)) se, max(value)-1.959964*stddev_samp(psi)/sqrt(count(*)) ci_low,"
    " max(value)+1.959964*stddev_samp(psi)/sqrt(count(*)) ci_high, count(*) n, max(w) max_weight, sum(w)*sum(w)/sum(w*w) ess from ps group by method",
    ["method", "target", "n"], NUM + ["max_weight", "ess"], ctes=_C09))
def c09(spark, sf):
    st = E.cell_stats(T.cohort(spark, sf).where(F.col("arm").isin("A", "B")))
    nu = E.cell_nuisance(st, ("A", "B"), cross_fit=False)
    got = E.ipw_two_arms(st, nu, "A", "B")
    return rnd(got.select("method", *EST, "max_weight", "ess").withColumn("n", F.col("n").cast("bigint")))


def _strata_sql(ks):
    parts = []
    for k in ks:
        cuts = "[" + ",".join(f"{i}/{k}.0" for i in range(1, k)) + "]"
        parts.append(f"""select {k} n_strata, arm, y, len(list_filter((select quantile_cont(e_A, {cuts}) from sc), lambda x: x <= e_A)) b from sc""")
    return TWO + ", bk as (" + " union all ".join(parts) + """),
 g as (select n_strata, b, count(*) n, count(*) filter (arm='A') n1, count(*) filter (arm='B') n0,
   avg(y) filter (arm='A') m1, avg(y) filter (arm='B') m0, var_samp(y) filter (arm='A') v1, var_samp(y) filter (arm='B') v0 from bk group by all),
 r as (select n_strata, sum(n*(m1-m0)) filter (n1>0 and n0>0)/sum(n) filter (n1>0 and n0>0) value,
   sqrt(sum(cast(n as double)*n*(v1/n1+v0/n0)) filter (n1>0 and n0>0))/sum(n) filter (n1>0 and n0>0) se,
   n_strata-count(*) filter (n1>0 and n0>0) skipped, sum(n) n from g group by 1)"""


def _strata(spark, sf, ks):
    two = T.cohort(spark, sf).where(F.col("arm").isin("A", "B")).withColumn("fold", F.lit(0))
    wide = E.widen(E.cell_nuisance(E.cell_stats(two), ("A", "B"), cross_fit=False), ("A", "B"))
    scored = two.join(small(wide.select("cell", F.col("e_A").alias("e"))), "cell").select("arm", "y", "e")
    got = E.stratified_effect(scored, "A", "B", ks)
    return rnd(got.select("n_strata", "value", "se", "ci_low", "ci_high", F.col("n").cast("bigint").alias("n"),
                          F.col("skipped").cast("bigint").alias("skipped")))


_SR = "select n_strata, value, se, value-1.959964*se ci_low, value+1.959964*se ci_high, n, skipped from r"
_SC = ["n_strata", "cast(n as bigint) n", "cast(skipped as bigint) skipped"]


@query("c10_stratification", V.rounded(_SR, _SC, NUM, ctes=_strata_sql((5,))))
def c10(spark, sf):
    return _strata(spark, sf, (5,))


@query("c11_strata_sensitivity", V.rounded(_SR, _SC, NUM, ctes=_strata_sql((5, 10, 20, 50))))
def c11(spark, sf):
    return _strata(spark, sf, (5, 10, 20, 50))


def _match_sql():
    l = "ln(e_true_a), ln(e_true_b), ln(e_true_c)"
    parts = ", ".join(
        f"""d{a} as (select unit_id, y, la, lb, lc from lv where arm='{a}'),
 m{a} as (select q.unit_id, arg_min(d.y, {{'x': (q.la-d.la)*(q.la-d.la)+(q.lb-d.lb)*(q.lb-d.lb)+(q.lc-d.lc)*(q.lc-d.lc), 'i': d.unit_id}}) y
   from lv q, d{a} d where q.arm<>'{a}' group by 1),
 r{a} as (select '{a}' arm, (coalesce((select sum(y) from lv where arm='{a}'),0)+(select sum(y) from m{a}))/(select count(*) from lv) v)"""
        for a in cfg.ARMS)
    return V.PLANTED + ", lv as (select unit_id, arm, y, ln(e_true_a) la, ln(e_true_b) lb, ln(e_true_c) lc from planted), " + parts + \
        ", rall as (select * from rA union all select * from rB union all select * from rC)"


@query("c12_matching", V.rounded(
    "select arm target, v value from rall union all select p.arm||'-'||q.arm, p.v-q.v from rall p join rall q on p.arm<q.arm",
    ["'matching' as method", "target"], ["value"], ctes=_match_sql()))
def c12(spark, sf):
    units = T.planted(spark, sf)
    for a in cfg.ARMS:
        units = units.withColumn(f"e_{a}", F.col(f"e_true_{a}"))
    return rnd(N.matching(units))


@query("c13_matching_bootstrap")
def c13(spark, sf):
    units = T.planted(spark, sf)
    for a in cfg.ARMS:
        units = units.withColumn(f"e_{a}", F.col(f"e_true_{a}"))
    return rnd(N.matching(units, replicates=100), 4)


@query("c14_outcome_models", V.rounded("select cell, fold, arm, mu from nz", ["cell", "fold", "arm"], ["mu"],
                                       ctes=V.COHORT + "," + V.folds("cohort") + "," + V.nuisance("f")))
def c14(spark, sf):
    nu = E.cell_nuisance(E.cell_stats(E.add_folds(T.cohort(spark, sf))))
    return rnd(nu.select("cell", "fold", "arm", "mu"))


def _lin_sql():
    a = []
    for arm in cfg.ARMS:
        a.append(f"""select f1.fold, '{arm}' arm, regr_slope(y,x1) b, regr_intercept(y,x1) a0 from (select distinct fold from f) f1
          join f on f.fold<>f1.fold and f.arm='{arm}' group by f1.fold""")
    return V.PLANTED + "," + V.folds("planted") + ", co as (" + " union all ".join(a) + ")"


@query("c14_outcome_models_linear", V.rounded(
    "select co.arm, avg(a0+b*x1) mean_mu, avg((a0+b*x1)*(a0+b*x1)) mean_mu2, count(*) n from f join co on co.fold=f.fold group by co.arm",
    ["arm", "n"], ["mean_mu", "mean_mu2"], ctes=_lin_sql()))
def c14_linear(spark, sf):
    got = L.crossfit_linear_outcomes(E.add_folds(T.planted(spark, sf)), ["x1"])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"mu_{a}").alias("mu")) for a in cfg.ARMS]))
    return rnd(got.select(rows.alias("r")).groupBy("r.arm").agg(
        F.avg("r.mu").alias("mean_mu"), F.avg(F.col("r.mu") * F.col("r.mu")).alias("mean_mu2"), F.count(F.lit(1)).alias("n")))


@query("c15_aipw_scores", V.rounded(
    "select * from (" + " union all ".join(f"select '{a}' arm, count(*) n, sum(phi_{a}) total, min(phi_{a}) lowest, max(phi_{a}) highest, stddev_samp(phi_{a}) sd from sc"
                                           for a in cfg.ARMS) + ")", ["arm", "n"], ["total", "lowest", "highest", "sd"], 4, V.FULL_FIT))
def c15(spark, sf):
    sc = E.long_scores(E.scored_cohort(T.cohort(spark, sf)))
    return rnd(sc.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("phi").alias("total"), F.min("phi").alias("lowest"),
                                     F.max("phi").alias("highest"), F.stddev_samp("phi").alias("sd")), 4)


@query("c16_aipw", est_sql(V.influence("sc"), V.FULL_FIT))
def c16(spark, sf):
    return est(E.crossfit_aipw(T.cohort(spark, sf)))


@query("c16_aipw_planted", est_sql(V.influence("sc"), V.PLANTED_FIT))
def c16_planted(spark, sf):
    return est(E.crossfit_aipw(T.planted(spark, sf)))


@query("c16_aipw_not_crossfit", est_sql(V.influence("sc"), V.PLANTED + ", f as (select *, 0 fold from planted)," +
                                        V.nuisance("f", cross=False) + "," + V.scores("f")))
def c16_plain(spark, sf):
    return est(E.crossfit_aipw(T.planted(spark, sf), folds=1))


_GC = V.COHORT + """, t as (select case when arm='A' then 1.0 else 0.0 end t, x1 x, y from cohort where arm in ('A','B')),
 s as (select covar_pop(t,y) ty, covar_pop(t,x) tx, covar_pop(x,y) xy, var_pop(t) tt, var_pop(x) xx from t)"""


@query("c17_g_computation", V.rounded("select (ty*xx-tx*xy)/(tt*xx-tx*tx) value from s", ["'A-B' target"], ["value"], ctes=_GC))
def c17(spark, sf):
    return rnd(L.g_computation(T.cohort(spark, sf), ["x1"], "A", "B").select("target", "value"))


@query("c17_g_computation_bootstrap")
def c17_boot(spark, sf):
    return rnd(L.g_computation(T.cohort(spark, sf), ["x1", "x2", "b1", "b2"], "A", "B", replicates=50), 4)


_TL = V.PLANTED + ", tm as (select cell, arm, avg(y) m from planted group by all), am as (select arm, avg(y) m from planted group by 1)"
_TLP = "coalesce((select m from tm where tm.cell=p.cell and tm.arm='{a}'),(select m from am where arm='{a}'))"


@query("c18_t_learner", V.rounded(
    "select * from (" + " union all ".join(
        f"select '{t}' target, avg(v) mean_pred, sqrt(avg((v-tr)*(v-tr))) pehe, count(*) n from (select {v} v, {tr} tr from p2)" for t, v, tr in
        [(a, f"p_{a}", f"mu_true_{a}") for a in cfg.ARMS] + [(f"{a}-{b}", f"p_{a}-p_{b}", f"mu_true_{a}-mu_true_{b}") for a, b in V.CONTRASTS]) + ")",
    ["target", "n"], ["mean_pred", "pehe"],
    ctes=_TL + ", p2 as (select p.*, " + ",".join(_TLP.format(a=a) + f" p_{a}" for a in cfg.ARMS) + " from planted p)"))
def c18_t(spark, sf):
    units = T.planted(spark, sf)
    pred = units.join(small(E.cell_means(units)), "cell")
    return M.grade_levels(pred, "t")


@query("c18_s_learner", V.rounded(
    "select * from (" + " union all ".join(
        f"select '{t}' target, avg(v) mean_pred, sqrt(avg((v-tr)*(v-tr))) pehe, count(*) n from (select {v} v, {tr} tr from p2)" for t, v, tr in
        [(a, f"p_{a}", f"mu_true_{a}") for a in cfg.ARMS] + [(f"{a}-{b}", f"p_{a}-p_{b}", f"mu_true_{a}-mu_true_{b}") for a, b in V.CONTRASTS]) + ")",
    ["target", "n"], ["mean_pred", "pehe"],
    ctes=V.PLANTED + """, wm as (select arm, avg(y) my, avg(x1) mx from planted group by 1),
 sl as (select sum((x1-mx)*(y-my))/sum((x1-mx)*(x1-mx)) b from planted join wm using (arm)),
 p2 as (select p.*, """ + ",".join(f"(select my-b*mx from wm where arm='{a}')+b*x1 p_{a}" for a in cfg.ARMS) + " from planted p, sl)"))
def c18_s(spark, sf):
    units = T.planted(spark, sf)
    return M.grade_levels(E.s_learner(units, units, "x1"), "s")


def dr_sql(src="sc", xs=("x1", "b1"), name="dr"):
    """Closed form of the two-covariate second stage on standardised covariates, all six targets."""
    x, w = xs
    tg = [(a, f"phi_{a}") for a in cfg.ARMS] + [(f"{a}-{b}", f"phi_{a}-phi_{b}") for a, b in V.CONTRASTS]
    union = " union all ".join(f"select unit_id, z1, z2, '{t}' target, {v} ps from {name}_z" for t, v in tg)
    return f"""
{name}_m as (select avg({x}) m1, stddev_pop({x}) s1, avg(cast({w} as double)) m2, stddev_pop({w}) s2 from {src}),
{name}_z as (select q.*, ({x}-m1)/s1 z1, ({w}-m2)/s2 z2 from {src} q, {name}_m),
{name}_p as ({union}),
{name}_r as (select count(*)*1.0 n, avg(z1*z2) r from {name}_z),
{name}_b as (select target, avg(ps) k0, (avg(ps*z1)-r*avg(ps*z2))/(1-r*r) k1, (avg(ps*z2)-r*avg(ps*z1))/(1-r*r) k2
   from {name}_p, {name}_r group by target, r),
{name}_a as (select p.*, ((ps-k0-k1*z1-k2*z2)/(1-(1+(z1*z1+z2*z2-2*r*z1*z2)/(1-r*r))/n))**2 a2 from {name}_p p join {name}_b using (target), {name}_r),
{name}_k as (select target, sum(a2) k00, sum(a2*z1) k01, sum(a2*z2) k02, sum(a2*z1*z1) k11, sum(a2*z1*z2) k12, sum(a2*z2*z2) k22 from {name}_a group by 1),
{name}_v as (select target, k00/(n*n) v00, (k01-r*k02)/(1-r*r)/(n*n) v01, (k02-r*k01)/(1-r*r)/(n*n) v02,
   (k11-2*r*k12+r*r*k22)/((1-r*r)**2)/(n*n) v11, (k12-r*k11-r*k22+r*r*k12)/((1-r*r)**2)/(n*n) v12,
   (k22-2*r*k12+r*r*k11)/((1-r*r)**2)/(n*n) v22 from {name}_k, {name}_r),
{name}_s as (select unit_id, target, z1, z2, k0+k1*z1+k2*z2 value, sqrt(v00+2*v01*z1+2*v02*z2+v11*z1*z1+2*v12*z1*z2+v22*z2*z2) se,
   k0, k1, k2, v00, v11, v12, v22 from {name}_z cross join {name}_b join {name}_v using (target)),
{name} as (select *, value-1.959964*se ci_low, value+1.959964*se ci_high from {name}_s)"""


def fitted(units, covariates=("x1", "b1")):
    """Scores and the linear second stage; the scored units are kept because three passes read them."""
    sc = E.scored_cohort(units).persist()
    return sc, L.fit_effect(sc, covariates, E.target_values("phi"))


@query("c19_dr_learner", V.rounded(
    "select target, avg(value) mean_value, avg(se) mean_se, min(value) lowest, max(value) highest, sum(ci_low) sum_low, sum(ci_high) sum_high, count(*) n from dr group by target",
    ["target", "n"], ["mean_value", "mean_se", "lowest", "highest", "sum_low", "sum_high"], 4, V.PLANTED_FIT + "," + dr_sql()))
def c19(spark, sf):
    sc, m = fitted(T.planted(spark, sf))
    return rnd(m.score(sc).groupBy("target").agg(
        F.avg("value").alias("mean_value"), F.avg("se").alias("mean_se"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.sum("ci_low").alias("sum_low"), F.sum("ci_high").alias("sum_high"), F.count(F.lit(1)).alias("n")), 4)


@query("c19_dr_learner_many_covariates")
def c19_many(spark, sf):
    units = T.cohort(spark, sf).withColumn("x1x2", F.col("x1") * F.col("x2")).withColumn("x1sq", F.col("x1") * F.col("x1"))
    sc, m = fitted(units, ("x1", "x2", "b1", "b2", "x1x2", "x1sq"))
    return rnd(m.coefficients(spark).select("target", "pos", "covariate", "beta", "var"))


_XL = V.PLANTED + """, tw as (select * from planted where arm in ('A','B')), tm as (select cell, arm, avg(y) m, count(*) n from tw group by all),
 am as (select arm, avg(y) m from tw group by 1),
 cm as (select c.cell, coalesce((select m from tm where tm.cell=c.cell and arm='A'),(select m from am where arm='A')) m1,
   coalesce((select m from tm where tm.cell=c.cell and arm='B'),(select m from am where arm='B')) m0,
   greatest(coalesce((select n*1.0/c.n from tm where tm.cell=c.cell and arm='A'),0.01),0.01) q1,
   greatest(coalesce((select n*1.0/c.n from tm where tm.cell=c.cell and arm='B'),0.01),0.01) q0 from (select cell, count(*) n from tw group by 1) c),
 im as (select tw.*, q1/(q1+q0) e, case when arm='A' then y-m0 else m1-y end d from tw join cm using (cell)),
 ft as (select regr_slope(d,x1) filter (arm='A') b1_, regr_intercept(d,x1) filter (arm='A') a1, regr_slope(d,x1) filter (arm='B') b0_, regr_intercept(d,x1) filter (arm='B') a0 from im),
 xl as (select e*(a0+b0_*x1)+(1-e)*(a1+b1_*x1) tau, mu_true_a-mu_true_b tr from im, ft)"""


@query("c20_x_learner", V.rounded("select avg(tau) mean_effect, sqrt(avg((tau-tr)*(tau-tr))) pehe, min(tau) lowest, max(tau) highest, count(*) n from xl",
                                  ["n"], ["mean_effect", "pehe", "lowest", "highest"], ctes=_XL))
def c20(spark, sf):
    got = E.x_learner(T.planted(spark, sf), "x1", "A", "B").withColumn("tr", F.col("mu_true_A") - F.col("mu_true_B"))
    return rnd(got.agg(F.avg("tau").alias("mean_effect"), F.sqrt(F.avg((F.col("tau") - F.col("tr")) ** 2)).alias("pehe"),
                       F.min("tau").alias("lowest"), F.max("tau").alias("highest"), F.count(F.lit(1)).alias("n")))


@query("c21_dr_learner_trees")
def c21(spark, sf):
    sc = E.scored_cohort(T.planted(spark, sf))
    got = M.tree_effect(sc, ["x1", "b1", "b2"], "phi_A", "phi_B")
    return rnd(got.agg(F.avg("tau").alias("mean_effect"),
                       F.sqrt(F.avg((F.col("tau") - (F.col("mu_true_A") - F.col("mu_true_B"))) ** 2)).alias("pehe"),
                       F.count(F.lit(1)).alias("n")), 4)


_C22 = V.COHORT + "," + V.folds("cohort", "f0") + """, f as (
 select 'y' outcome, unit_id, arm, cell, fold, y yy from f0 union all select 'y2', unit_id, arm, cell, fold, y2 from f0
 union all select 'y3', unit_id, arm, cell, fold, y3 from f0),""" + V.nuisance("f", by="outcome", y="yy") + "," + V.scores("f", by="outcome", y="yy")


@query("c22_several_outcomes", est_sql(V.influence("sc", by="outcome"), _C22, ["outcome"]))
def c22(spark, sf):
    return est(E.crossfit_aipw(T.cohort(spark, sf), outcomes=("y", "y2", "y3")), ["outcome"])


_VAR = {"right": ["seg", "prio"], "omit prio": ["seg"], "omit all": [], "add mediator": ["seg", "prio", "m1"]}


def _variants_sql():
    parts = [f"select '{v}' variant, concat_ws('|','c'{''.join(',cast(' + c + ' as varchar)' for c in cols)}) cell, arm, y from cohort where arm in ('A','B')"
             for v, cols in _VAR.items()]
    return V.COHORT + ", va as (" + " union all ".join(parts) + """),
 g as (select variant, cell, count(*) n, avg(y) filter (arm='A') - avg(y) filter (arm='B') d from va group by all),
 e as (select variant, sum(n*d) filter (d is not null)/sum(n) filter (d is not null) value, sum(n) filter (d is not null) n from g group by 1)"""


@query("c24_structural_mistakes", V.rounded("select variant, value, n, value-(select value from e where variant='right') distortion from e",
                                            ["variant", "cast(n as bigint) n"], ["value", "distortion"], ctes=_variants_sql()))
def c24(spark, sf):
    got = E.structural_mistakes(T.cohort(spark, sf), "A", "B", _VAR, "right")
    return rnd(got.select("variant", F.col("n").cast("bigint").alias("n"), "value", "distortion"))


@query("c24_subgroup_split", V.rounded(
    """select case when grouping(m1)=1 then 'all' else 'm1='||cast(m1 as varchar) end subgroup,
  avg(y) filter (arm='A')-avg(y) filter (arm='B') value, count(*) n,
  avg(y) filter (arm='A')-avg(y) filter (arm='B') - (select avg(y) filter (arm='A')-avg(y) filter (arm='B') from cohort) distortion
  from cohort where arm in ('A','B') group by grouping sets ((),(m1))""", ["subgroup", "n"], ["value", "distortion"], ctes=V.COHORT))
def c24_subgroup(spark, sf):
    return rnd(E.subgroup_split(T.cohort(spark, sf), "m1", "A", "B"))
