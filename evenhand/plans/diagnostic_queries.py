"""D: diagnostics, refutation, sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand import config as cfg
from evenhand.functions.stats import rnd
from evenhand.operators import diagnostics as D
from evenhand.operators import effects as E
from evenhand.plans import effect_queries as C
from evenhand.plans import sqlviews as V
from evenhand.plans.registry import query
from evenhand.sources import tables as T

COV = ["x1", "x2", "b1", "b2"]


def two_arm_scores(spark, sf):
    """Arms A and B of the cohort with the share of A in the cell as ``e``."""
    two = T.cohort(spark, sf).where(F.col("arm").isin("A", "B"))
    wide = E.widen(E.cell_nuisance(E.cell_stats(two), ("A", "B"), cross_fit=False), ("A", "B"))
    return two.join(wide.select("cell", F.col("e_A").alias("e")), "cell")


OVERLAP_SQL = C.TWO + """, ov as (select count(*) n, min(e_A) filter (arm='A') min_first, max(e_A) filter (arm='A') max_first, min(e_A) filter (arm='B') min_second,
  max(e_A) filter (arm='B') max_second, count(*) filter (e_A<0.45 or e_A>0.55) n_extreme, max(case when arm='A' then 1/e_A else 1/(1-e_A) end) max_weight,
  sum(case when arm='A' then 1/e_A else 1/(1-e_A) end)**2/sum((case when arm='A' then 1/e_A else 1/(1-e_A) end)**2) ess from sc),
 ow as (select *, least(max_first,max_second)-greatest(min_first,min_second) shared_width from ov),
 oz as (select *, case when shared_width<=0 then 'VIOLATED' when ess<0.4*n or max_weight>50 then 'FRAGILE' when n_extreme>0.05*n then 'ACCEPTABLE' else 'SATISFIED' end verdict from ow)"""


@query("d01_overlap_report", V.rounded("select * from oz", ["n", "n_extreme", "verdict"],
                                       ["min_first", "max_first", "min_second", "max_second", "max_weight", "ess", "shared_width"], ctes=OVERLAP_SQL))
def d01(spark, sf):
    return rnd(D.overlap_report(two_arm_scores(spark, sf), "A", "B", 0.45, 0.55))


@query("d02_propensity_histogram", "with " + V.PLANTED_FIT + " " + " union all ".join(
    f"select '{a}' arm, arm arm_received, cast(least(floor(e_{a}*40),39) as int) bin, count(*) n from sc group by all" for a in cfg.ARMS))
def d02(spark, sf):
    return D.propensity_histogram(E.long_scores(E.scored_cohort(T.planted(spark, sf))))


@query("d03_trim_audit", V.rounded(" union all ".join(
    f"select '{c}' covariate, count(*) filter (k) kept, count(*) filter (not k) dropped, avg({c}) filter (k) kept_mean, avg({c}) filter (not k) dropped_mean from tr" for c in ("x1", "b1", "b2")),
    ["covariate", "kept", "dropped"], ["kept_mean", "dropped_mean"], ctes=V.PLANTED_FIT + ", tr as (select *, e_A>=0.25 and e_A<=0.5 k from sc)"))
def d03(spark, sf):
    sc = E.scored_cohort(T.planted(spark, sf)).withColumn("e", F.col("e_A"))
    return rnd(D.trim_audit(sc, ["x1", "b1", "b2"], 0.25, 0.5))


_W = "case arm when 'A' then 1/e_A when 'B' then 1/e_B else 1/e_C end"
BALANCE_SQL = V.PLANTED_FIT + ", mo as (" + " union all ".join(
    f"select '{c}' covariate, arm, avg(cast({c} as double)) m, var_samp(cast({c} as double)) v, sum(w*{c})/sum(w) wm from (select *, {_W} w from sc) group by arm" for c in ("x1", "b1", "b2")) + """),
 bt as (select a.covariate, max(abs((a.m-b.m)/sqrt((a.v+b.v)/2))) smd_before, max(abs((a.wm-b.wm)/sqrt((a.v+b.v)/2))) smd_after from mo a join mo b on a.covariate=b.covariate and a.arm<b.arm group by 1)"""


def balance(spark, sf):
    sc = E.scored_cohort(T.planted(spark, sf))
    return D.balance_table(sc, ["x1", "b1", "b2"], 1 / E.pick("e", F.col("arm"), cfg.ARMS))


@query("d04_balance", V.rounded("select *, smd_after<smd_before improved, smd_after<0.1 balanced from bt", ["covariate", "improved", "balanced"], ["smd_before", "smd_after"], ctes=BALANCE_SQL))
def d04(spark, sf):
    return rnd(balance(spark, sf))


def _ev(r):
    return f"(greatest({r},1/({r}))+sqrt(greatest({r},1/({r}))*(greatest({r},1/({r}))-1)))"


EV_SQL = V.PLANTED_FIT + ", es as (" + V.influence("sc") + """), sd as (select stddev_samp(y) sd from planted),
 ev as (select target, value, """ + _ev("exp(0.91*value/sd)") + " evalue, case when ci_low<=0 and ci_high>=0 then 1.0 else " + _ev("exp(0.91*(case when value<0 then ci_high else ci_low end)/sd)") + """ end evalue_ci from es, sd where target like '%-%'),
 ez as (select *, case when evalue_ci<1.25 then 'very fragile' when evalue_ci<2 then 'moderately robust' when evalue_ci<4 then 'robust' else 'very robust' end robustness from ev)"""


def evalues(spark, sf):
    units = T.planted(spark, sf)
    est = E.crossfit_aipw(units).where(F.col("target").contains("-"))
    sd = units.agg(F.stddev_samp("y").alias("__sd"))
    return D.e_values(est.crossJoin(F.broadcast(sd)), F.col("__sd")).select("target", "value", "evalue", "evalue_ci", "robustness")


@query("d05_e_values", V.rounded("select * from ez", ["target", "robustness"], ["value", "evalue", "evalue_ci"], ctes=EV_SQL))
def d05(spark, sf):
    return rnd(evalues(spark, sf))


@query("d06_confounder_strength", V.rounded("""select greatest(pt,pl)/greatest(least(pt,pl),1e-9) rr_treatment, exp(0.91*abs(yt-yl)/sd) rr_outcome, least(greatest(pt,pl)/greatest(least(pt,pl),1e-9), exp(0.91*abs(yt-yl)/sd)) strength, q quoted, case when least(greatest(pt,pl)/greatest(least(pt,pl),1e-9), exp(0.91*abs(yt-yl)/sd))>=q then 'erased' else 'survives' end judgement from (select case when evalue_ci>0 then evalue_ci else evalue end q from ez where target='A-B'), (
   select avg(t) filter (x1>=hi) pt, avg(t) filter (x1<=lo) pl, avg(y) filter (x1>=hi) yt, avg(y) filter (x1<=lo) yl, stddev_samp(y) sd
   from (select *, case when arm='A' then 1.0 else 0.0 end t from planted where arm in ('A','B')), (select quantile_cont(x1,0.25) lo, quantile_cont(x1,0.75) hi from planted where arm in ('A','B')))""",
   ["judgement"], ["rr_treatment", "rr_outcome", "strength", "quoted"], ctes=EV_SQL))
def d06(spark, sf):
    return rnd(D.strength_verdict(D.confounder_strength(T.planted(spark, sf), "x1", "A", "B"), evalues(spark, sf).where(F.col("target") == "A-B")))


@query("d07_audit", V.rounded("""select verdict, n_unbalanced, evalue_ci, verdict<>'VIOLATED' and n_unbalanced=0 and evalue_ci>=1.25 safe_to_report from
  (select case when shared_width<=0 then 'VIOLATED' when ess<0.4*n or max_weight>50 then 'FRAGILE' when n_extreme>0.05*n then 'ACCEPTABLE' else 'SATISFIED' end verdict from ow),
  (select count(*) filter (smd_after>=0.1) n_unbalanced from bt), (select evalue_ci from ez where target='A-B')""",
  ["verdict", "n_unbalanced", "safe_to_report"], ["evalue_ci"],
  ctes=EV_SQL + ", mo as (" + BALANCE_SQL.split(", mo as (", 1)[1] + """, pe as (select arm, e_A/(e_A+e_B) e from sc where arm in ('A','B')),
 ov as (select count(*) n, min(e) filter (arm='A') min_first, max(e) filter (arm='A') max_first, min(e) filter (arm='B') min_second, max(e) filter (arm='B') max_second, count(*) filter (e<0.05 or e>0.95) n_extreme,
  max(case when arm='A' then 1/e else 1/(1-e) end) max_weight, sum(case when arm='A' then 1/e else 1/(1-e) end)**2/sum((case when arm='A' then 1/e else 1/(1-e) end)**2) ess from pe),
 ow as (select *, least(max_first,max_second)-greatest(min_first,min_second) shared_width from ov)"""))
def d07(spark, sf):
    sc = E.scored_cohort(T.planted(spark, sf))
    over = D.overlap_report(sc.withColumn("e", F.col("e_A") / (F.col("e_A") + F.col("e_B"))), "A", "B")
    bal = D.balance_table(sc, ["x1", "b1", "b2"], 1 / E.pick("e", F.col("arm"), cfg.ARMS))
    return rnd(D.audit(over, bal, evalues(spark, sf).where(F.col("target") == "A-B")))


@query("d08_confounding_table", V.rounded("select *, abs(smd)<0.1 balanced from (" + " union all ".join(
    f"select '{c}' covariate, avg({c}) filter (arm='A') mean_first, avg({c}) filter (arm='B') mean_second, avg({c}) filter (arm='A')-avg({c}) filter (arm='B') difference, "
    f"(avg({c}) filter (arm='A')-avg({c}) filter (arm='B'))/sqrt((var_samp({c}) filter (arm='A')+var_samp({c}) filter (arm='B'))/2) smd from cohort" for c in COV) + ")",
    ["covariate", "balanced"], ["mean_first", "mean_second", "difference", "smd"], ctes=V.COHORT))
def d08(spark, sf):
    return rnd(D.confounding_table(T.cohort(spark, sf), COV, "A", "B"))


M = 20
PLACEBO_SQL = V.COHORT + "," + V.folds("cohort", "f0") + f""",
 ct as (select count(*) filter (arm='A') na, count(*) filter (arm in ('A','B')) nab from cohort),
 rp as (select f0.* exclude (arm), rep, row_number() over (partition by rep order by md5(cast(unit_id as varchar)||':perm:'||cast(rep as varchar))) rk from f0, range(1,{M + 1}) r(rep)),
 f as (select rp.*, case when rk<=na then 'A' when rk<=nab then 'B' else 'C' end arm from rp, ct),""" + V.nuisance("f", by="rep") + "," + V.scores("f", by="rep")


@query("d09_placebo", V.rounded("select target, avg(value) value, avg(ci_low) ci_low, avg(ci_high) ci_high, avg(case when ci_low<=0 and ci_high>=0 then 1.0 else 0.0 end) share, count(*) n_rep from (" +
                                V.influence("sc", by="rep") + ") group by target", ["target", "n_rep"], ["value", "ci_low", "ci_high", "share"], ctes=PLACEBO_SQL))
def d09(spark, sf):
    got = D.placebo_estimates(E.add_folds(T.cohort(spark, sf)), M)
    return rnd(got.groupBy("target").agg(
        F.avg("value").alias("value"), F.avg("ci_low").alias("ci_low"), F.avg("ci_high").alias("ci_high"),
        F.avg(((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).cast("double")).alias("share"), F.count(F.lit(1)).alias("n_rep")))


_NOISY = V.COHORT + "," + V.folds("cohort", "f0") + ", f as (select * exclude (cell), cell||'|'||cast(cast(floor(" + V.u("'noise'") + "*2) as int) as varchar) cell from f0)," + V.nuisance("f") + "," + V.scores("f")


@query("d10_random_common_cause", C.est_sql(V.influence("sc"), _NOISY))
def d10(spark, sf):
    st = E.cell_stats(D.noisy_cells(E.add_folds(T.cohort(spark, sf))))
    return C.est(E.aipw(st, E.cell_nuisance(st)))


_SUB = V.COHORT + "," + V.folds("cohort", "f0") + ", f as (select f0.*, draw from f0, range(1,4) r(draw) where " + V.u("'sub:'||cast(draw as varchar)") + "<0.8)," + V.nuisance("f", by="draw") + "," + V.scores("f", by="draw")


@query("d11_data_subset", C.est_sql(V.influence("sc", by="draw"), _SUB, ["cast(draw as int) draw"]))
def d11(spark, sf):
    st = E.cell_stats(D.subset(E.add_folds(T.cohort(spark, sf)), 0.8, 3), by=("draw",))
    return C.est(E.aipw(st, E.cell_nuisance(st, by=("draw", "outcome")), by=("draw", "outcome")), ["draw"])


_UC = V.PLANTED + "," + V.folds("planted", "f0") + ", mt as (select avg(case when arm='A' then 1.0 else 0.0 end) mt from f0 where arm in ('A','B')), f as (select f0.* exclude (y), s strength, y - s*0.5*(sqrt(3.0)*(" + "+".join(
    V.u(f"'{k}:uc'") for k in ("n1", "n2", "n3", "n4")) + "-2)+s*((case when arm='A' then 1.0 else 0.0 end)-mt)) y from f0, mt, (values (0.5),(1.0),(2.0),(3.0)) v(s) where arm in ('A','B'))," + V.nuisance(
    "f", by="strength", arms=("A", "B")) + "," + V.scores("f", by="strength", arms=("A", "B"))


@query("d12_unobserved_confounder", V.rounded("select cast(strength as double) strength, value, value+0.2 bias, sign(value)<>-1 sign_flipped from (" + V.influence("sc", by="strength", arms=("A", "B")) + ") where target='A-B'",
                                              ["strength", "sign_flipped"], ["value", "bias"], ctes=_UC))
def d12(spark, sf):
    return rnd(D.unobserved_confounder(E.add_folds(T.planted(spark, sf)), (0.5, 1.0, 2.0, 3.0), "A", "B", -0.2))


_REF = PLACEBO_SQL + "," + f"pl as ({V.influence('sc', by='rep')}), " + \
    V.folds("cohort", "g")[1:] + "," + V.nuisance("g", "nz1") + "," + V.scores("g", "nz1", "sc1") + f", o1 as ({V.influence('sc1')})" + \
    ", h as (select * exclude (cell), cell||'|'||cast(cast(floor(" + V.u("'noise'") + "*2) as int) as varchar) cell from g)," + V.nuisance("h", "nz2") + "," + V.scores("h", "nz2", "sc2") + f", o2 as ({V.influence('sc2')})" + \
    ", k as (select * from g where " + V.u("'sub:1'") + "<0.8)," + V.nuisance("k", "nz3") + "," + V.scores("k", "nz3", "sc3") + f", o3 as ({V.influence('sc3')})"


@query("d13_refutation_table", V.rounded(f"""select 'placebo treatment' as "check", o1.target, o1.value original, o1.se original_se, avg(pl.value) new_value, avg(pl.ci_low) new_low, avg(pl.ci_high) new_high,
   cast(cast(round(100*avg(case when pl.ci_low<=0 and pl.ci_high>=0 then 1.0 else 0.0 end),0) as int) as varchar)||'% of {M} placebo intervals contain 0' criterion, avg(case when pl.ci_low<=0 and pl.ci_high>=0 then 1.0 else 0.0 end)>=0.85 passed
   from o1 join pl using (target) where o1.target like '%-%' group by all
 union all select 'random common cause', o1.target, o1.value, o1.se, o2.value, o2.ci_low, o2.ci_high, 'within 2 SE of original', abs(o2.value-o1.value)<=2*o1.se from o1 join o2 using (target) where o1.target like '%-%'
 union all select 'data subset', o1.target, o1.value, o1.se, o3.value, o3.ci_low, o3.ci_high, 'within 2 SE of original', abs(o3.value-o1.value)<=2*o1.se from o1 join o3 using (target) where o1.target like '%-%'""",
 ['"check"', "target", "criterion", "passed"], ["original", "original_se", "new_value", "new_low", "new_high"], ctes=_REF))
def d13(spark, sf):
    return rnd(D.refutation_table(E.add_folds(T.cohort(spark, sf)), repeats=M))
