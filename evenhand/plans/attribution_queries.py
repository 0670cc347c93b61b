"""F: attribution of the planted effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand import config as cfg
from evenhand.functions.hashing import uniform
from evenhand.functions.ranking import spearman
from evenhand.functions.stats import rnd
from evenhand.operators import attribution as A
from evenhand.plans import effect_queries as C
from evenhand.plans import sqlviews as V
from evenhand.plans.registry import query
from evenhand.sources import literals as LT
from evenhand.sources import tables as T

PAIRS = ("A-B", "A-C", "B-C")
SLOPES = [("A", "x1", -0.20), ("A", "b1", 0.10), ("A", "b2", 0.0), ("B", "x1", -0.12), ("B", "b1", 0.0), ("B", "b2", 0.0),
          ("C", "x1", -0.25), ("C", "b1", 0.0), ("C", "b2", 0.15)]
TRUE = [("A-B", "x1", -0.08), ("A-B", "b1", 0.10), ("A-C", "x1", 0.05), ("A-C", "b1", 0.10), ("B-C", "x1", 0.13), ("B-C", "b1", 0.0)]


def explained(spark, sf):
    sc, m = C.fitted(T.planted(spark, sf))
    return sc, m, A.explain(m, sc, PAIRS)


EX = V.PLANTED_FIT + "," + C.dr_sql() + """,
 ct as (select unit_id, target, k0 base, value estimate, 0 pos, 'x1' covariate, k1*z1 phi, abs(z1)*sqrt(v11) se, abs(k1)>1.959964*sqrt(v11) clear from dr where target like '%-%'
  union all select unit_id, target, k0, value, 1, 'b1', k2*z2, abs(z2)*sqrt(v22), abs(k2)>1.959964*sqrt(v22) from dr where target like '%-%'),
 tp as (select *, row_number() over (partition by unit_id, target order by -abs(phi), pos) rk from ct where clear and phi<>0)"""


@query("f01_contributions", V.rounded("select target, covariate, clear, count(*) n, sum(phi) total, avg(abs(phi)) mean_abs, avg(se) mean_se, avg(base) base from ct group by all",
                                      ["target", "covariate", "clear", "n"], ["total", "mean_abs", "mean_se", "base"], ctes=EX))
def f01(spark, sf):
    _, _, ex = explained(spark, sf)
    return rnd(A.contributions_long(ex).groupBy("target", "covariate", "clear").agg(
        F.count(F.lit(1)).alias("n"), F.sum("phi").alias("total"), F.avg(F.abs("phi")).alias("mean_abs"), F.avg("se").alias("mean_se"), F.avg("base").alias("base")))


@query("f02_driver_records", "with " + EX + """, us as (select unit_id, string_agg(target||':'||covariate, ';' order by target, rk) d from tp where rk<=3 group by 1)
 select coalesce(d,'') drivers, count(*) n from (select distinct unit_id from ct) left join us using (unit_id) group by 1""")
def f02(spark, sf):
    _, _, ex = explained(spark, sf)
    maps = A.driver_maps(A.top_drivers(ex))
    flat = F.flatten(F.transform(F.array_sort(F.map_keys("drivers")), lambda t: F.transform(F.element_at("drivers", t), lambda d: F.concat_ws(":", t, d["covariate"]))))
    return maps.groupBy(F.concat_ws(";", flat).alias("drivers")).agg(F.count(F.lit(1)).alias("n"))


@query("f03_top_drivers", V.rounded("select target, rk as \"rank\", covariate, count(*) n, sum(phi) total from tp where rk<=3 group by all", ["target", "cast(\"rank\" as int) \"rank\"", "covariate", "n"], ["total"], ctes=EX))
def f03(spark, sf):
    _, _, ex = explained(spark, sf)
    d = A.top_drivers(ex).select("target", F.posexplode("drivers").alias("p", "d"))
    return rnd(d.groupBy("target", (F.col("p") + 1).alias("rank"), F.col("d.covariate").alias("covariate")).agg(F.count(F.lit(1)).alias("n"), F.sum("d.phi").alias("total")))


@query("f04_other_details", V.rounded("""select target, n_others, count(*) n, sum(phi) total, sum(sqrt(greatest(var,0))) total_se from
 (select dr.target, (case when s.covariate='x1' then 0 else 1 end)+(case when s.covariate='b1' then 0 else 1 end) n_others,
   (case when s.covariate='x1' then 0 else k1*z1 end)+(case when s.covariate='b1' then 0 else k2*z2 end) phi,
   (case when s.covariate='x1' then 0 else v11*z1*z1 end)+(case when s.covariate='b1' then 0 else v22*z2*z2 end)+(case when s.covariate is null then 2*v12*z1*z2 else 0 end) var
  from dr left join (select * from tp where rk=1) s using (unit_id, target) where dr.target like '%-%') group by all""", ["target", "n_others", "n"], ["total", "total_se"], ctes=EX))
def f04(spark, sf):
    sc, m, _ = explained(spark, sf)
    got = A.other_details(m, sc, PAIRS, 1)
    return rnd(got.groupBy("target", "n_others").agg(F.count(F.lit(1)).alias("n"), F.sum("phi").alias("total"), F.sum("se").alias("total_se")))


@query("f05_global_importance", V.rounded("select target, covariate, m mean_abs, row_number() over (partition by target order by m desc, pos) as \"rank\" from (select target, covariate, pos, avg(abs(phi)) m from ct group by all)",
                                          ["target", "covariate", "cast(\"rank\" as int) \"rank\""], ["mean_abs"], ctes=EX))
def f05(spark, sf):
    _, _, ex = explained(spark, sf)
    return rnd(A.global_importance(A.contributions_long(ex)))


_F06 = EX + "," + LT.sql_values("tru", ["target", "covariate", "slope"], TRUE) + """, im as (select target, covariate, avg(abs(phi)) m, row_number() over (partition by target order by avg(abs(phi)) desc, any_value(pos)) rk from ct group by target, covariate),
 nm as (select target, count(*) filter (slope<>0) k from tru group by 1),
 q1 as (select target, sum(case when rk<=k and slope<>0 then 1.0 else 0 end)/any_value(k) precision_at_k, sum(case when slope<>0 then 1.0 else 0 end)/least(3,any_value(k)) top_overlap from im join tru using (target, covariate) join nm using (target) group by 1),
 cd as (select u.unit_id, u.target, count(tp.covariate) shown, count(tp.covariate) filter (slope<>0) hits from (select distinct unit_id, target from ct) u left join tp on tp.unit_id=u.unit_id and tp.target=u.target and rk<=3 left join tru on tru.target=tp.target and tru.covariate=tp.covariate group by 1,2),
 q2 as (select target, 1-sum(hits)/nullif(sum(shown),0) false_driver_rate, avg(hits*1.0/k) driver_recall, avg(case when shown=0 then 1.0 else 0.0 end) no_driver_share from cd join nm using (target) group by 1),
 co as (select distinct target, 'x1' covariate, k1 beta, v11 var, s1 scale from dr, dr_m where target like '%-%' union select distinct target, 'b1', k2, v22, s2 from dr, dr_m where target like '%-%'),
 q3 as (select target, avg(case when abs(beta/scale-slope)<=1.959964*sqrt(var)/scale then 1.0 else 0.0 end) slope_coverage, bool_and((abs(beta)>1.959964*sqrt(var))=(slope<>0)) clear_set_equal from co join tru using (target, covariate) group by 1)"""


@query("f06_explanation_quality", V.rounded("select * from q1 join q2 using (target) join q3 using (target)", ["target", "clear_set_equal", "true as additive"],
                                            ["precision_at_k", "top_overlap", "false_driver_rate", "driver_recall", "no_driver_share", "slope_coverage"], ctes=_F06))
def f06(spark, sf):
    _, m, ex = explained(spark, sf)
    top = A.top_drivers(ex)
    truth = T.literal(spark, "target string, covariate string, slope double", TRUE)
    got = A.explanation_quality(top, A.global_importance(A.contributions_long(ex)), truth, m.coefficients(spark), m.z)
    return rnd(got.withColumn("additive", F.col("additivity_error") < 1e-9).drop("additivity_error"))


@query("f07_true_importance", V.rounded("select a.arm||'-'||b.arm target, covariate, a.slope-b.slope slope, abs(a.slope-b.slope)*sd importance from co a join co b using (covariate) join sd using (covariate) where a.arm<b.arm", ["target", "covariate"], ["slope", "importance"],
    ctes=V.PLANTED + "," + LT.sql_values("co", ["arm", "covariate", "slope"], SLOPES) + ", sd as (select 'x1' covariate, stddev_pop(x1) sd from planted union all select 'b1', stddev_pop(b1) from planted union all select 'b2', stddev_pop(b2) from planted)"))
def f07(spark, sf):
    cov = ("x1", "b1", "b2")
    one = T.planted(spark, sf).agg(*[F.stddev_pop(c).alias(c) for c in cov])
    sds = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).alias("sd")) for c in cov])))
    return rnd(A.true_importance(T.literal(spark, "arm string, covariate string, slope double", SLOPES), sds, PAIRS))


def _runs(spark, sf, runs=6):
    """(run, item, score): absolute correlation of each covariate with the outcome in seeded halves of the cohort."""
    cov = ("x1", "x2", "b1", "b2")
    u = T.cohort(spark, sf).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).where(uniform("unit_id", F.lit("run"), F.col("run")) < 0.5)
    one = u.groupBy("run").agg(*[F.abs(F.corr(F.col(c).cast("double"), "y")).alias(c) for c in cov])
    return one.select("run", F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("score")) for c in cov])))


_RUNS = V.COHORT + ", ru as (select cohort.*, run from cohort, range(1,7) r(run) where " + V.u("'run:'||cast(run as varchar)") + "<0.5), ri as (" + " union all ".join(
    f"select run, '{c}' item, abs(corr({c},y)) score from ru group by run" for c in ("x1", "x2", "b1", "b2")) + ")"


@query("f08_ranking_stability", V.rounded("""select (select avg(len(list_intersect(a.s,b.s))*1.0/len(list_distinct(list_concat(a.s,b.s)))) from tp a join tp b on a.run<b.run) mean_jaccard, item lead_item, stddev_samp(score)/abs(avg(score)) lead_cv from ri group by item
  order by avg(abs(score)) desc, item desc limit 1""", ["lead_item"], ["mean_jaccard", "lead_cv"], ctes=_RUNS + ", rk as (select *, row_number() over (partition by run order by score desc, item) r from ri), tp as (select run, list(item) s from rk where r<=2 group by 1)"))
def f08(spark, sf):
    return rnd(A.ranking_stability(_runs(spark, sf)))


@query("f08_ranking_agreement", V.rounded("""select run, corr(ra, rb) agreement from (select run, rank() over (partition by run order by score) ra, rank() over (partition by run order by m) rb from ri join (select item, avg(score) m from ri group by 1) using (item)) group by 1""",
                                          ["cast(run as int) run"], ["agreement"], ctes=_RUNS))
def f08_agreement(spark, sf):
    r = _runs(spark, sf).persist()
    mean = r.groupBy("item").agg(F.avg("score").alias("m"))
    return rnd(spearman(r.join(mean, "item"), "score", "m", ("run",)).select("run", F.col("spearman").alias("agreement")))
