"""K and L: reconciling result tables, operational summaries and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evenhand.functions.stats import rnd
from evenhand.operators import diffs as D
from evenhand.operators import effects as E
from evenhand.operators import grading as G
from evenhand.operators import rules as R
from evenhand.plans import effect_queries as C
from evenhand.plans import grading_queries as GQ
from evenhand.plans import rule_queries as B
from evenhand.plans import sqlviews as V
from evenhand.plans.registry import query
from evenhand.session import shared_dir
from evenhand.sources import literals as LT
from evenhand.sources import tables as T
from evenhand.streaming import jobs as J


@query("k01_table_diff", """with a as (select c_custkey k, c_mktsegment seg, c_acctbal bal from customer where c_nationkey<>3), b as (select c_custkey k, case when c_nationkey=5 then 'OTHER' else c_mktsegment end seg, case when c_nationkey=7 then c_acctbal*(1+1e-6) when c_nationkey=8 then c_acctbal*(1+1e-15) else c_acctbal end bal from customer where c_nationkey<>4),
 d as (select '(key)' "column", coalesce(a.k,b.k) k from a full join b using (k) where a.k is null or b.k is null union all select 'seg', a.k from a join b using (k) where a.seg<>b.seg union all select 'bal', a.k from a join b using (k) where abs(a.bal-b.bal)>1e-12 and abs(a.bal-b.bal)>1e-12*greatest(abs(a.bal),abs(b.bal)))
 select "column", count(*) n, cast(sum(k) as bigint) keys from d group by 1""")
def k01(spark, sf):
    c = T.table(spark, sf, "customer")
    a = c.where("c_nationkey <> 3").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    n = F.col("c_nationkey")
    bal = F.when(n == 7, F.col("c_acctbal") * (1 + 1e-6)).when(n == 8, F.col("c_acctbal") * (1 + 1e-15)).otherwise(F.col("c_acctbal"))
    b = c.where("c_nationkey <> 4").select(F.col("c_custkey").alias("k"), F.when(n == 5, "OTHER").otherwise(F.col("c_mktsegment")).alias("seg"), bal.alias("bal"))
    return D.table_diff(a, b, ["k"]).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@query("k02_determinism", "select 'units' part, count(*) n from (with " + V.COHORT + " select * from cohort) union all select 'differences', 0")
def k02(spark, sf):
    """Two runs with the same seeds: how many rows were compared and how many differ."""
    def run():
        return E.add_folds(T.cohort(spark, sf)).select("unit_id", "arm", "fold", "y")

    a = run()
    diff = D.table_diff(a, run().repartition(5), ["unit_id"])
    return a.agg(F.lit("units").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(diff.agg(F.lit("differences").alias("part"), F.count(F.lit(1)).alias("n")))


@query("k03_report_panel", "with " + GQ._E20 + """, pc as (select metric, comparison, format('{:,.4f}', round(max(mean) filter (version='0'),4)) cell_0, format('{:,.4f}', round(max(mean) filter (version='B'),4)) cell_B from su group by 1,2)
 select metric, comparison, cell_0, cell_B, verdict, words from pc join cz using (metric, comparison)""")
def k03(spark, sf):
    s = GQ.summary_with_kind(spark, sf).persist()
    return D.panel_cells(s, G.change_verdict(s, "0", "B"), ["0", "B"])


def events(spark, sf):
    return T.table(spark, sf, "events")


@query("l01_latency_summary", """select event_type, count(*) n, round(quantile_cont(value,0.5),6) p50, round(quantile_cont(value,0.95),6) p95, max(value) max_value, round(100*avg(case when value>100 then 1.0 else 0.0 end),6) fallback_pct,
 round(100*avg(case when json_valid(props) then 1.0 else 0.0 end),6) valid_pct from events group by 1""")
def l01(spark, sf):
    return rnd(J.latency_summary(events(spark, sf), "event_type", "value", F.col("value") > 100, F.try_parse_json("props").isNotNull()))


_WINDOWS = "select strftime({start}, '%Y-%m-%d') as start, count(*) n, max(value) max_value, count(*) filter (event_type='error') fallbacks, round(100.0*count(*) filter (event_type='error')/count(*),6) fallback_pct, true p50_within, true p95_within from events group by 1"


def windows_with_ranks(spark, sf, windows, start, error=0.02):
    """The windows, and whether their quantiles have the rank they should, within ``error`` of the window, counted in the events themselves."""
    q = J.with_quantiles(windows).withColumn("start", F.date_format("start", "yyyy-MM-dd"))
    e = events(spark, sf).select(F.date_format(start, "yyyy-MM-dd").alias("start"), "value").join(q.select("start", "p50", "p95"), "start")
    up_to = lambda c, strict: F.avg((F.col("value") < F.col(c) if strict else F.col("value") <= F.col(c)).cast("double"))
    ranks = e.groupBy("start").agg(*[((up_to(c, True) <= p + error) & (up_to(c, False) >= p - error)).alias(f"{c}_within") for c, p in (("p50", 0.5), ("p95", 0.95))])
    return rnd(q.join(ranks, "start").select("start", "n", "max_value", "fallbacks", "fallback_pct", "p50_within", "p95_within"))


def day_windows(spark, sf):
    return J.latency_windows(events(spark, sf), "ts", "value", F.col("event_type") == "error")


@query("l01_latency_windows", _WINDOWS.format(start="ts"))
def l01_windows(spark, sf):
    return windows_with_ranks(spark, sf, day_windows(spark, sf), F.col("ts"))


@query("l01_latency_months", _WINDOWS.format(start="date_trunc('month', ts)"))
def l01_months(spark, sf):
    """Months merged from the sketches of days."""
    return windows_with_ranks(spark, sf, J.longer_windows(day_windows(spark, sf), F.date_trunc("month", "start")), F.date_trunc("month", "ts"))


_FAIL, _OK = "event_type='error'", "event_type='purchase'"


@query("l02_throttle", """with e as (select user_id, event_id, event_type='error' f, sum(case when event_type='purchase' then 1 else 0 end) over (partition by user_id order by event_id) g from events where event_type in ('error','purchase')),
 k as (select user_id, event_id, (row_number() over (partition by user_id, g order by event_id)-1)%5+1 level from e where f)
 select level, case when level=5 then 900 when level>=3 then cast(least(2**(level-2),30) as int) else 0 end wait, level=5 locked, count(*) n, cast(sum(event_id) as bigint) ids from k group by all""")
def l02(spark, sf):
    t = J.throttle_batch(events(spark, sf), "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return t.groupBy(F.col("level").cast("bigint").alias("level"), "wait", "locked").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


_IN_TIME = """with recursive e as (select user_id, event_id, epoch_us(ts) tm, event_type='error' bad, row_number() over (partition by user_id order by ts, event_id) n from events where event_type in ('error','purchase') and user_id is not null),
 r as (select user_id, cast(0 as bigint) n, cast(null as varchar) outcome, 0 fails, cast(null as bigint) "last", cast(null as bigint) until, 0 wait from (select distinct user_id from e)
  union all select user_id, n, case when tm<ready then 'refused' when not bad then 'ok' when fails+1>=5 then 'locked' else 'failed' end,
   case when tm<ready then fails when not bad then 0 else fails+1 end, case when tm<ready then "last" when bad then tm end, case when tm<ready then until when bad and fails+1>=5 then tm+900000000 end,
   case when tm<ready then cast((ready-tm)//1000000+1 as int) when not bad then 0 when fails+1>=5 then 900 when fails+1>=3 then least(2<<(fails+1-3),30) else 0 end
  from (select *, coalesce(until, "last"+case when fails<3 then 0 else least(2<<(fails-3),30) end*1000000, -1) ready from (select e.user_id, e.n, e.tm, e.bad, case when r.until<=e.tm then 0 else r.fails end fails, case when r.until<=e.tm then null else r."last" end "last", case when r.until<=e.tm then null else r.until end until
   from r join e on e.user_id=r.user_id and e.n=r.n+1)))
 select outcome, cast(fails as bigint) level, count(*) n, cast(sum(wait) as bigint) waits from r where n>0 group by all"""


@query("l02_throttle_in_time", _IN_TIME)
def l02_in_time(spark, sf):
    t = J.throttle_in_time(events(spark, sf), "user_id", "event_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return t.groupBy("outcome", F.col("level").cast("bigint").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wait").cast("bigint")).alias("waits"))


FORGET = 86_400


@query("l02_throttle_forgetting", _IN_TIME.replace("r.until<=e.tm", f'(r.until<=e.tm or r.until is null and e.tm-r."last">={FORGET}000000)'))
def l02_forgetting(spark, sf):
    """As in time, with failures forgotten after a day: what bounds the state of a stream."""
    t = J.throttle_in_time(events(spark, sf), "user_id", "event_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase", FORGET)
    return t.groupBy("outcome", F.col("level").cast("bigint").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wait").cast("bigint")).alias("waits"))


@query("l03_address_block", """with recursive e as (select user_id, epoch_us(ts) tm, row_number() over (partition by user_id order by ts, event_id) n from events where event_type='error' and user_id is not null and ts is not null),
 r as (select user_id, cast(0 as bigint) n, cast([] as bigint[]) recent, cast(-1 as bigint) until, cast(null as varchar) outcome, cast(0 as bigint) k from (select distinct user_id from e)
  union all select user_id, n, case when tm<until then recent when len(now)>=2 then cast([] as bigint[]) else now end, case when tm>=until and len(now)>=2 then tm+86400000000 else until end,
   case when tm<until then 'refused' when len(now)>=2 then 'blocked' else 'counted' end, case when tm<until then 0 else len(now) end
  from (select e.user_id, e.n, e.tm, r.recent, r.until, list_append(list_filter(r.recent, lambda t: e.tm-t<86400000000), e.tm) now from r join e on e.user_id=r.user_id and e.n=r.n+1))
 select user_id, outcome, count(*) n, cast(sum(k) as bigint) recent from r where n>0 group by all""")
def l03_block(spark, sf):
    """Two failures within a day block an address for a day."""
    t = J.address_block(events(spark, sf), "user_id", "event_id", "ts", F.col("event_type") == "error", span=86_400, limit=2)
    return t.groupBy("user_id", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("recent").cast("bigint")).alias("recent"))


@query("l03_sliding_block", """select user_id, count(*) n, max(r) most, count(*) filter (r>=2) blocked from (select user_id, count(*) over (partition by user_id order by s range between 899 preceding and current row) r from (select user_id, floor(epoch(ts)) s from events where event_type='error')) group by 1""")
def l03(spark, sf):
    sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = events(spark, sf).withColumn("sec", sec.cast("bigint"))
    r = J.sliding_failures(e, "user_id", "sec", F.col("event_type") == "error", limit=2)
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("recent").alias("most"), F.sum(F.col("blocked").cast("bigint")).alias("blocked"))


@query("l04_audit", "select status, rules, fields, count(*) n from (select case when event_type='error' then 'excluded' else 'estimate' end status, case when event_type='error' then 'R1' else '' end rules, case when value<100 then 'user_id,value' else 'user_id' end fields from events) group by all")
def l04(spark, sf):
    e = events(spark, sf).withColumn("value", F.when(F.col("value") < 100, F.col("value")))
    err = F.col("event_type") == "error"
    a = J.audit_lines(e.unionByName(e), "event_id", "ts", ["user_id", "value"], F.when(err, "excluded").otherwise("estimate"), F.when(err, F.array(F.lit("R1"))).otherwise(F.array().cast("array<string>")), "0.1")
    return a.groupBy("status", F.array_join("rules", ",").alias("rules"), F.array_join("fields_received", ",").alias("fields")).agg(F.count(F.lit(1)).alias("n"))


STREAM_RULES = [dict(LT.RULES[0], field="price", value=20000.0), dict(LT.RULES[1], field="price", op="ge", value=300000.0)]


@query("l05_streaming_scoring", """select arm, status, count(*) n, round(sum(case when status<>'excluded' then -0.2+0.000001*p else 0 end),4) effect from (select 'A' arm, o_totalprice p, case when o_totalprice<20000 then 'excluded' when o_totalprice>=300000 then 'caution' else 'no_rule_fired' end status from orders) group by all""")
def l05(spark, sf):
    """Orders as a file stream: rules and a linear effect as column expressions, written and read back."""
    schema = T.table(spark, sf, "orders").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    units = s.select(F.col("o_orderkey").alias("unit_id"), F.col("o_totalprice").alias("price"))
    v = R.verdicts(units, STREAM_RULES, ("A",), extra=("price",))
    scored = v.select("unit_id", "arm", "status", F.when(F.col("status") != "excluded", -0.2 + 0.000001 * F.col("price")).alias("effect"))
    root = shared_dir(spark, f"evenhand_scoring_{uuid.uuid4().hex[:8]}")
    J.run_to_table(scored, f"{root}/out", f"{root}/state")
    got = spark.read.schema("unit_id bigint, arm string, status string, effect double").parquet(f"{root}/out")
    return got.groupBy("arm", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("effect", F.lit(0.0))), 4).alias("effect"))


def order_units(spark, sf, orders):
    """unit_id, price and the covariates of the model for a table or a stream of orders; customers are a table."""
    cust = T.table(spark, sf, "customer").select("c_custkey", ((F.col("c_acctbal") - 4500) / 3200).alias("x1"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("b1"))
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("unit_id"), F.col("o_totalprice").alias("price"), "x1", "b1")


_SCORED = V.PLANTED_FIT + "," + C.dr_sql() + """,
 un as (select o_totalprice p, ((c_acctbal-4500)/3200.0-m1)/s1 z1, (cast(c_mktsegment in ('BUILDING','MACHINERY') as int)-m2)/s2 z2 from orders join customer on o_custkey=c_custkey, dr_m),
 sc2 as (select 'A' arm, case when p<20000 then 'excluded' when p>=300000 then 'caution' else 'no_rule_fired' end status, k0+k1*z1+k2*z2 value,
   sqrt(v00+2*v01*z1+2*v02*z2+v11*z1*z1+2*v12*z1*z2+v22*z2*z2) se from un, dr_b join dr_v using (target) where target='A')"""


@query("l05_model_scoring", V.rounded("select arm, status, 1 as version, count(*) n, sum(case when status<>'excluded' then value end) total, sum(case when status<>'excluded' then se end) total_se from sc2 group by all",
                                      ["arm", "status", "version", "n"], ["total", "total_se"], 3, _SCORED))
def l05_model(spark, sf):
    """New units as a file stream, scored by the newest published version of the fitted second stage."""
    _, model = C.fitted(T.planted(spark, sf))
    root = shared_dir(spark, f"evenhand_models_{uuid.uuid4().hex[:8]}")
    model.publish(spark, f"{root}/models", 1)
    s = spark.readStream.schema(T.table(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    J.score_stream(order_units(spark, sf, s), f"{root}/models", STREAM_RULES, ("A",), f"{root}/out", f"{root}/state")
    got = spark.read.schema("unit_id bigint, arm string, status string, value double, se double, version int").parquet(f"{root}/out")
    return rnd(got.groupBy("arm", "status", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum("se").alias("total_se")), 3)
