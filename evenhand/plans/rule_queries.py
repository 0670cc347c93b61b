"""B: validation, rules, eligibility, status and evidence levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand import config as cfg
from evenhand.functions import text as X
from evenhand.functions.stats import rnd, small, union_all
from evenhand.operators import effects as E
from evenhand.operators import rules as R
from evenhand.plans import effect_queries as C
from evenhand.plans import source_queries as A
from evenhand.plans import sqlviews as V
from evenhand.plans.registry import query
from evenhand.sources import literals as LT
from evenhand.sources import tables as T

_SQL_OP = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "="}


def verdict_sql(rules, src="cohort", name="vd"):
    """(unit, arm, excluded, fired): a rule table joined to the units on the field, as SQL."""
    rows = [(i, r["rule_id"], r["arm"], r["field"], r["op"], r["value"], r["action"]) for i, r in enumerate(rules)]
    fields = sorted({r["field"] for r in rules})
    long = " union all ".join(f"select unit_id, '{f}' field, cast({f} as double) v from {src}" for f in fields)
    return f"""{LT.sql_values(name + '_r', ['pos', 'rule_id', 'arm', 'field', 'op', 'rv', 'action'], rows)},
 {name}_l as ({long}),
 {name}_h as (select unit_id, arm, pos, rule_id, action from {name}_l join {name}_r using (field) where case op when 'lt' then v<rv when 'le' then v<=rv when 'gt' then v>rv when 'ge' then v>=rv else v=rv end),
 {name}_g as (select unit_id, arm, bool_or(action='EXCLUDE') ex, string_agg(rule_id, ',' order by pos) fired, string_agg(case when action='EXCLUDE' then rule_id end, ', ' order by pos) exfired from {name}_h group by all),
 {name} as (select u.unit_id, a.arm, coalesce(ex,false) excluded, coalesce(fired,'') fired, exfired,
   case when coalesce(ex,false) then 'excluded' when fired is not null then 'caution' else 'no_rule_fired' end status
   from {src} u cross join (values ('A'),('B'),('C')) a(arm) left join {name}_g g on g.unit_id=u.unit_id and g.arm=a.arm)"""


@query("b01_range_violations", """select field, lo, hi, count(*) n, round(min(value),4) lowest, round(max(value),4) highest from (
 select 'c_acctbal' field, 0.0 lo, 9000.0 hi, c_acctbal as value from customer union all select 'c_nationkey', 2, 20, c_nationkey from customer)
 where value<lo or value>hi group by all""")
def b01(spark, sf):
    got = R.range_violations(T.table(spark, sf, "customer"), "c_custkey", {"c_acctbal": (0, 9000), "c_nationkey": (2, 20)})
    return got.groupBy("field", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 4).alias("lowest"), F.round(F.max("value"), 4).alias("highest"))


@query("b02_band", """select case when c_acctbal<0 then 'debt' when c_acctbal<2500 then 'low' when c_acctbal<6000 then 'middle' else 'high' end band,
 count(*) n, round(min(c_acctbal),2) lowest, round(max(c_acctbal),2) highest from customer group by 1""")
def b02(spark, sf):
    b = R.band(F.col("c_acctbal"), [(0, "debt"), (2500, "low"), (6000, "middle")], "high")
    return T.table(spark, sf, "customer").groupBy(b.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("c_acctbal"), 2).alias("lowest"), F.round(F.max("c_acctbal"), 2).alias("highest"))


@query("b03_observed_view", "with " + V.PLANTED + " " + " union all ".join(f"select '{c}' col, count({c}) n from planted" for c in ("unit_id", "x1", "b1", "b2", "cell", "arm", "y")))
def b03(spark, sf):
    seen = R.observed_view(T.planted(spark, sf))
    counts = seen.agg(*[F.count(c).alias(c) for c in seen.columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("n")) for c in seen.columns])))


@query("b04_adjustment_roles", "with " + V.COHORT + "," + LT.sql_values("nd", ["variable", "role"], LT.NODES) + "," + LT.sql_values("ed", ["src", "dst"], LT.EDGES) + """,
 av as (select 'x1' variable, avg(x1) m from cohort union all select 'b1', avg(b1) from cohort union all select 'b2', avg(b2) from cohort union all select 'x2', avg(x2) from cohort
   union all select 'm1', avg(m1) from cohort union all select 'y3', avg(y3) from cohort union all select 'y2', avg(y2) from cohort)
 select variable, role, role in ('confounder','treatment_predictor','outcome_predictor') adjust,
 case when role='confounder' and not (exists(select 1 from ed where src=variable and dst='treatment') and exists(select 1 from ed where src=variable and dst='outcome')) then 'a confounder must point to treatment and outcome'
      when role='mediator' and not exists(select 1 from ed where dst=variable and src='treatment') then 'a mediator must follow treatment' end problem,
 round(m,6) mean_value from nd join av using (variable)""")
def b04(spark, sf):
    roles = R.adjustment_roles(T.literal(spark, "node string, role string", LT.NODES), T.literal(spark, "src string, dst string", LT.EDGES))
    names = [n for n, _ in LT.NODES]
    means = T.cohort(spark, sf).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names])
    means = means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("mean_value")) for c in names])))
    return rnd(roles.join(F.broadcast(means), "variable").select("variable", "role", "adjust", "problem", "mean_value"))


@query("b05_flat_rules", "with " + V.COHORT + "," + verdict_sql(LT.RULES) + " select arm, status, fired, count(*) n, cast(sum(unit_id) as bigint) ids from vd group by all")
def b05(spark, sf):
    got = R.verdicts(T.cohort(spark, sf), LT.RULES)
    fired = F.concat_ws(",", F.transform("fired", lambda f: f["rule_id"]))
    return got.groupBy("arm", "status", fired.alias("fired")).agg(F.count(F.lit(1)).alias("n"), F.sum("unit_id").alias("ids"))


_B06 = "with " + V.COHORT + "," + A.XU + """, st as (select unit_id, case when x1 < -1.5 then 'G00' when x2n is null then 'G01' end stop_rule,
  case when coalesce(x2n>=150,false) then 'do_not_use' when coalesce(b1=1 and x1>0,false) then 'check_first' else 'safe_to_consider' end sa,
  case when coalesce(x2n>=120,false) then 'do_not_use' else 'safe_to_consider' end sb,
  case when coalesce(x1>=1.0 or x2n>=200,false) then 'do_not_use' else 'safe_to_consider' end sc,
  case when b2=1 then 'G05' else '' end nb from xu)
 select coalesce(stop_rule,'') stop_rule, sa, sb, sc, (case when sb='do_not_use' then 'G04' else '' end)||(case when sb='do_not_use' and nb<>'' then ',' else '' end)||nb rules_b,
  (stop_rule is not null or (sa='do_not_use' and sb='do_not_use' and sc='do_not_use')) blocked, count(*) n from st group by all"""


@query("b06_expression_rules", _B06)
def b06(spark, sf):
    units = A.with_gaps(T.cohort(spark, sf))
    usable, _ = R.expression_rules(units, LT.EXPRESSION_RULES)
    got = R.apply_expression_rules(units, usable, cfg.ARMS)
    return got.groupBy(F.coalesce("stop_rule", F.lit("")).alias("stop_rule"), F.col("status_A").alias("sa"), F.col("status_B").alias("sb"),
                       F.col("status_C").alias("sc"), F.concat_ws(",", "rules_B").alias("rules_b"), "blocked").agg(F.count(F.lit(1)).alias("n"))


def flagged(spark, sf):
    """Cohort units with a cell-mode effect of A against B, flags and severity."""
    units = T.cohort(spark, sf)
    j = units.join(small(E.cell_means(units)), "cell").withColumn("effect", F.col("t_A") - F.col("t_B"))
    x1, x2, e = F.col("x1"), F.col("x2"), F.col("effect")
    return R.severity_flags(j, [
        ("veto_low", 3, x1 < -1.2), ("warn_band", 2, (x1 >= -1.2) & (x1 < -0.9)), ("out_of_range", 2, (x2 < 5) | (x2 > 250)),
        ("predicted_harm", 2, e <= -0.3), ("near_equivalent", 1, F.abs(e) < 0.3), ("high_baseline", 1, x2 >= 200), ("indication", 0, F.col("b2") == 1)])


FLAGS_SQL = V.COHORT + """, cm as (select cell, avg(y) filter (arm='A')-avg(y) filter (arm='B') effect from cohort group by 1),
 fl as (select c.*, effect, list_filter([case when x1 < -1.2 then 'veto_low' end, case when x1 >= -1.2 and x1 < -0.9 then 'warn_band' end, case when x2<5 or x2>250 then 'out_of_range' end,
   case when effect <= -0.3 then 'predicted_harm' end, case when abs(effect)<0.3 then 'near_equivalent' end, case when x2>=200 then 'high_baseline' end, case when b2=1 then 'indication' end], lambda x: x is not null) flags,
   greatest(case when x1 < -1.2 then 3 else 0 end, case when (x1 >= -1.2 and x1 < -0.9) or x2<5 or x2>250 or effect <= -0.3 then 2 else 0 end, case when abs(effect)<0.3 or x2>=200 then 1 else 0 end) severity
   from cohort c join cm using (cell))"""
_STATUS = "case severity when 3 then 'BLOCKED' when 2 then 'HOLD' when 1 then 'CAUTION' else 'APPROVED' end guard_status"


@query("b07_severity_flags", "with " + FLAGS_SQL + f" select array_to_string(flags,',') flags, severity, {_STATUS}, count(*) n from fl group by all")
def b07(spark, sf):
    return flagged(spark, sf).groupBy(F.concat_ws(",", "flags").alias("flags"), "severity", "guard_status").agg(F.count(F.lit(1)).alias("n"))


@query("b08_support", "with " + V.COHORT + """, tr as (select min(x1) l1, max(x1) h1, min(x2) l2, max(x2) h2, min(b1) lb, max(b1) hb from cohort where b1=0 and arm='B'),
 rs as (select array_to_string(list_filter([case when x1<l1 or x1>h1 then 'x1: outside the range' end, case when x2<l2 or x2>h2 then 'x2: outside the range' end,
   case when b1 not in (lb,hb) then 'b1: value never seen' end], lambda x: x is not null),'; ') reasons from cohort, tr)
 select reasons, count(*) n from rs group by 1""")
def b08(spark, sf):
    units = T.cohort(spark, sf)
    ranges = R.support_ranges(units.where((F.col("b1") == 0) & (F.col("arm") == "B")), ["x1", "x2", "b1"])
    return units.groupBy(F.concat_ws("; ", R.support_reasons(ranges)).alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("b09_overlap", "with " + V.PLANTED_FIT + " " + " union all ".join(f"select '{a}' arm, e_{a}>=0.2 usable, count(*) n from sc group by 2" for a in cfg.ARMS))
def b09(spark, sf):
    sc = E.long_scores(E.scored_cohort(T.planted(spark, sf)))
    return sc.groupBy("arm", R.overlap_ok(F.col("e"), 0.2).alias("usable")).agg(F.count(F.lit(1)).alias("n"))


@query("b10_allowed", "with " + V.PLANTED_FIT + "," + verdict_sql(LT.PLANTED_RULES, "sc") + """, al as (select vd.*, case arm when 'A' then e_A when 'B' then e_B else e_C end e from vd join (select unit_id, e_A, e_B, e_C from sc) q using (unit_id))
 select arm, not excluded safe, (not excluded and e>=0.2) allowed, count(*) n from al group by all""")
def b10(spark, sf):
    sc = R.verdict_columns(E.scored_cohort(T.planted(spark, sf)), LT.PLANTED_RULES)
    rows = F.array(*[F.struct(F.lit(a).alias("arm"), (~F.col(f"excluded_{a}")).alias("safe"),
                              (~F.col(f"excluded_{a}") & R.overlap_ok(F.col(f"e_{a}"), 0.2)).alias("allowed")) for a in cfg.ARMS])
    return sc.select(F.inline(rows)).groupBy("arm", "safe", "allowed").agg(F.count(F.lit(1)).alias("n"))


# Status resolution: the fitted planted cohort, with limits that make every status occur
MIN_E, MAX_W, LOW_W, LOW_E = 0.15, 0.18, 0.12, 0.25


def resolved(spark, sf):
    sc, model = C.fitted(T.planted(spark, sf))
    ranges = R.support_ranges(sc.where(F.col("arm") == "B").where("x1 > -1.6"), ["x1"])
    units = R.verdict_columns(model.score_wide(sc), LT.PLANTED_RULES).withColumn("outside", R.support_reasons(ranges))
    return R.resolve_status(units, minimum=MIN_E, max_width=MAX_W)


_WIDE = ", ".join(f"max(value) filter (target='{t}') v_{t.replace('-', '')}, max(se) filter (target='{t}') s_{t.replace('-', '')}" for t, _, _ in cfg.targets())
RESOLVED_SQL = V.PLANTED_FIT + "," + C.dr_sql() + "," + verdict_sql(LT.PLANTED_RULES, "sc") + f""",
 dw as (select unit_id, {_WIDE} from dr group by 1),
 rg as (select min(x1) lo, max(x1) hi from sc where arm='B' and x1 > -1.6),
 op as (select vd.unit_id, vd.arm, excluded, fired, exfired, (x1<lo or x1>hi) outside,
   case vd.arm when 'A' then e_A when 'B' then e_B else e_C end e, case vd.arm when 'A' then v_A when 'B' then v_B else v_C end v,
   case vd.arm when 'A' then s_A when 'B' then s_B else s_C end s
   from vd join (select unit_id, x1, e_A, e_B, e_C from sc) q using (unit_id) join dw using (unit_id), rg),
 os as (select *, case when excluded then 'excluded' when outside then 'outside_support' when e<{MIN_E} then 'low_overlap' when 2*1.959964*s>{MAX_W} then 'too_uncertain' else 'estimate' end status from op),
 ou as (select unit_id, bool_or(status='estimate') app, bool_and(excluded) allex, bool_or(outside) outs from os group by 1),
 ol as (select os.*, case when app then 'APPLICABLE' else 'NOT_APPLICABLE' end applicable,
   case when app then null when allex then 'every option is excluded by a rule' when outs then 'x1: outside the range' else 'no option has a useful estimate' end reason,
   case when status='estimate' then v end as value, case when status='estimate' then v-1.959964*s end ci_low, case when status='estimate' then v+1.959964*s end ci_high from os join ou using (unit_id))"""


@query("b11_status", V.rounded("select arm, status, applicable, coalesce(reason,'') reason, count(*) n, sum(value) total, sum(ci_high-ci_low) widths from ol group by all",
                               ["arm", "status", "applicable", "reason", "n"], ["total", "widths"], 4, RESOLVED_SQL))
def b11(spark, sf):
    got = R.options_long(resolved(spark, sf), extra=("reason",))
    return rnd(got.groupBy("arm", "status", "applicable", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("ci_high") - F.col("ci_low")).alias("widths")), 4)


@query("b11_comparisons", V.rounded(" union all ".join(
    f"select '{a}-{b}' target, count(*) n, sum(v_{a}{b}) total, sum(v_{a}{b}-1.959964*s_{a}{b}) lows from dw where unit_id in (select unit_id from os where arm='{a}' and status='estimate') "
    f"and unit_id in (select unit_id from os where arm='{b}' and status='estimate') having count(*)>0" for a, b in V.CONTRASTS), ["target", "n"], ["total", "lows"], 4, RESOLVED_SQL))
def b11_comparisons(spark, sf):
    got = R.comparisons_long(resolved(spark, sf))
    return rnd(got.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum("ci_low").alias("lows")), 4)


_LV = f"""select ol.*, round(ci_high-ci_low,3) w, case when status='excluded' then null when status<>'estimate' then 'Insufficient' when e<{MIN_E} or round(ci_high-ci_low,3)>{MAX_W} then 'Insufficient'
  when round(ci_high-ci_low,3)>{LOW_W} or e<{LOW_E} then 'Low' else 'Moderate' end level from ol"""


def levelled(spark, sf):
    return R.evidence_level(R.options_long(resolved(spark, sf)), LOW_W, MAX_W, MIN_E, LOW_E)


@query("b12_evidence_level", "with " + RESOLVED_SQL + ", lv as (" + _LV + f""") select arm, coalesce(level,'-') as level,
  case when status='excluded' then 'removed by '||exfired when status='low_overlap' then 'low_overlap' when status in ('outside_support','too_uncertain') then status
   when level='Low' then (case when w>{LOW_W} then 'interval' else '' end)||(case when e<{LOW_E} then 'propensity' else '' end) else 'both' end reason, count(*) n from lv group by all""")
def b12(spark, sf):
    got = levelled(spark, sf)
    reason = (F.when(F.col("status") == "excluded", F.col("level_reason")).when(F.col("status") != "estimate", F.col("status"))
              .when(F.col("level") == "Low", F.concat(F.when(F.col("level_reason").contains("interval"), "interval").otherwise(""),
                                                      F.when(F.col("level_reason").contains("propensity"), "propensity").otherwise(""))).otherwise("both"))
    return got.groupBy("arm", F.coalesce("level", F.lit("-")).alias("level"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("b13_abstain_reason", "with " + RESOLVED_SQL + """ select arm, case status when 'low_overlap' then 'too few similar units (propensity '||printf('%.2f', round(e,2))||')'
  when 'too_uncertain' then 'the interval is too wide for a useful estimate' else 'outside the range of the reference data' end why, count(*) n from ol where status not in ('estimate','excluded') group by all""")
def b13(spark, sf):
    got = R.options_long(resolved(spark, sf)).where(~F.col("status").isin("estimate", "excluded"))
    return got.groupBy("arm", R.abstain_reason(F.col("status"), F.col("e")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query("b14_constraints", "with " + RESOLVED_SQL + """ select 'checked' as "constraint", count(*) n from ol
 union all select 'estimate', count(*) from ol where status='estimate' and not (ci_low<=value and value<=ci_high) having count(*)>0""")
def b14(spark, sf):
    options = R.options_long(resolved(spark, sf)).persist()
    texts = options.withColumn("note", R.abstain_reason(F.col("status"), F.col("e")))
    bad = R.constraint_violations(texts, ["note"], X.DOSE).groupBy("constraint").agg(F.count(F.lit(1)).alias("n"))
    return options.agg(F.lit("checked").alias("constraint"), F.count(F.lit(1)).alias("n")).unionByName(bad)


@query("b15_direction", "with " + FLAGS_SQL + f""" select case when severity=3 then 'blocked' when abs(effect)<0.3 then 'equivalent' when effect>0 then 'A' else 'B' end direction, {_STATUS}, count(*) n, round(sum(effect),4) total from fl group by all""")
def b15(spark, sf):
    got = flagged(spark, sf)
    return rnd(got.groupBy(R.direction(F.col("effect"), F.col("severity"), "A", "B").alias("direction"), "guard_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("effect").alias("total")), 4)


@query("c23_batch_scoring", V.rounded("select arm, status, applicable, count(*) n, sum(value) total, avg(e) mean_e, sum(100*greatest(0,least(1,0.3+v))) risk from ol group by all",
                                      ["arm", "status", "applicable", "n"], ["total", "mean_e", "risk"], 4, RESOLVED_SQL))
def c23(spark, sf):
    """Rules, support, overlap, estimates and a clipped percentage for every unit in one job."""
    wide = resolved(spark, sf)
    risk = F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"status_{a}").alias("status"), F.col(f"e_{a}").alias("e"),
                                       F.when(F.col(f"status_{a}") == "estimate", F.col(f"value_{a}")).alias("value"),
                                       (100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 + F.col(f"value_{a}")))).alias("risk")) for a in cfg.ARMS]))
    return rnd(wide.select("applicable", risk).groupBy("arm", "status", "applicable").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("e").alias("mean_e"), F.sum("risk").alias("risk")), 4)
