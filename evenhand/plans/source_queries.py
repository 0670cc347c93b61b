"""A: reading, checking and writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evenhand.functions.stats import rnd, small
from evenhand.operators import effects as E
from evenhand.operators import rules as R
from evenhand.plans import effect_queries as C
from evenhand.plans import sqlviews as V
from evenhand.plans.registry import query
from evenhand.session import shared_dir
from evenhand.sources import literals as LT
from evenhand.sources import readers as S
from evenhand.sources import tables as T


@query("a01_load_observational", """
select o_orderstatus arm, count(*) n, count(*) filter (c_acctbal>5000) rich, count(*) filter (seg='none') filled, round(sum(c_acctbal),2) total
from (select o_orderstatus, case when c_acctbal>=0 then c_acctbal end c_acctbal, coalesce(nullif(c_mktsegment,'FURNITURE'),'none') seg
      from orders join customer on o_custkey=c_custkey) where c_acctbal is not null group by 1""")
def a01(spark, sf):
    raw = T.table(spark, sf, "orders").select("o_custkey", "o_orderstatus").join(
        T.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    raw = raw.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).withColumn("seg", F.nullif("c_mktsegment", F.lit("FURNITURE")))
    got = S.load_observational(raw, ["o_orderstatus", "c_acctbal"], "o_orderstatus", ("F", "O", "P"),
                               {"rich": (F.col("c_acctbal") > 5000).cast("bigint")}, {"seg": "none"})
    return got.groupBy(F.col("o_orderstatus").alias("arm")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rich").alias("rich"), F.sum((F.col("seg") == "none").cast("bigint")).alias("filled"),
        F.round(F.sum("c_acctbal"), 2).alias("total"))


# a rule table derived from the parts: many rows are unusable in one way or another
_PART_RULES = """pr as (select case when p_size=50 then 'twice' else 'P'||p_partkey end rule_id, p_brand arm, lower(p_type) field,
  case when p_size<10 then 'lt' when p_size<20 then 'ge' when p_size<45 then 'eq' else 'about' end op,
  case when p_size in (7,8) then 'n/a' when p_size=9 then '' else cast(p_retailprice as varchar) end as value,
  case when p_size>40 then 'IGNORE' else 'EXCLUDE' end action, p_name message, 'label' source, 'VERIFIED' status from part)"""


def part_rules(spark, sf):
    s = F.col("p_size")
    return T.table(spark, sf, "part").select(
        F.when(s == 50, "twice").otherwise(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("rule_id"),
        F.col("p_brand").alias("arm"), F.lower("p_type").alias("field"),
        F.when(s < 10, "lt").when(s < 20, "ge").when(s < 45, "eq").otherwise("about").alias("op"),
        F.when(s.isin(7, 8), "n/a").when(s == 9, "").otherwise(F.col("p_retailprice").cast("string")).alias("value"),
        F.when(s > 40, "IGNORE").otherwise("EXCLUDE").alias("action"), F.col("p_name").alias("message"),
        F.lit("label").alias("source"), F.lit("VERIFIED").alias("status"))


@query("a02_rule_table_problems", "with " + _PART_RULES + """
select rule_id, problem from (
 select rule_id, 'empty value' problem from pr where value='' union all
 select rule_id, 'unknown arm '||arm from pr where arm not in ('Brand#1','Brand#2','Brand#3') union all
 select rule_id, 'unknown field '||field from pr where field not in ('small','large','medium') union all
 select rule_id, 'unknown op '||op from pr where op='about' union all
 select rule_id, 'unknown action '||action from pr where action='IGNORE' union all
 select rule_id, 'value is not a number' from pr where value='n/a' union all
 select rule_id, 'duplicate rule_id' from pr group by 1 having count(*)>1)""")
def a02(spark, sf):
    return R.rule_problems(part_rules(spark, sf), ["Brand#1", "Brand#2", "Brand#3"], ["small", "large", "medium"])


XU = "xu as (select *, case when x2 >= 10 then x2 end x2n from cohort)"
_A03 = {"G00": "x1 < -1.5", "G01": "x2n is null", "G02": "x2n >= 150", "G03": "b1=1 and x1>0", "G04": "x2n >= 120", "G05": "b2=1", "G06": "x1>=1.0 or x2n>=200"}
_A03R = {"G07": "condition could not be read", "G08": "condition could not be read", "G09": "no source", "G10": "unknown action", "G11": "placeholder"}


def with_gaps(units):
    """The cohort with a quantity that is sometimes missing."""
    return units.withColumn("x2n", F.when(F.col("x2") >= 10, F.col("x2")))


@query("a03_expression_rules", "with " + V.COHORT + "," + XU + " " + " union all ".join(
    [f"select '{k}' id, 'usable' status, cast(null as varchar) why, count(*) filter ({c}) n_fired from xu" for k, c in _A03.items()]
    + [f"select '{k}' id, 'refused' status, '{w}' why, cast(0 as bigint) n_fired" for k, w in _A03R.items()]))
def a03(spark, sf):
    units = with_gaps(T.cohort(spark, sf))
    usable, refused = R.expression_rules(units, LT.EXPRESSION_RULES)
    counts = units.agg(*[F.sum(F.coalesce(F.expr(r["condition"]), F.lit(False)).cast("bigint")).alias(r["id"]) for r in usable])
    rows = [F.struct(F.lit(r["id"]).alias("id"), F.lit("usable").alias("status"), F.lit(None).cast("string").alias("why"), F.col(r["id"]).alias("n_fired")) for r in usable]
    rows += [F.struct(F.lit(i).alias("id"), F.lit("refused").alias("status"), F.lit(w).alias("why"), F.lit(0).cast("bigint").alias("n_fired")) for i, w in refused]
    return counts.select(F.inline(F.array(*rows)))


def register(spark):
    return T.literal(spark, LT.REGISTER_SCHEMA, LT.register_rows())


REG = LT.sql_values("reg", ["id", "title", "issuer", "version", "bucket", "checked_by", "tier", "relevance"], LT.register_rows())
CLEARED_SQL = "(bucket='GREEN' and trim(checked_by)<>'' and not regexp_matches(lower(checked_by),'draft|to confirm'))"


@query("a04_register", "with " + REG + " select source, title, issuer, version, bucket, count(*) n_docs from documents join reg on source=id group by all")
def a04(spark, sf):
    docs = T.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    reg = register(spark).withColumnRenamed("id", "source")
    return docs.join(small(reg), "source").select("source", "title", "issuer", "version", "bucket", "n_docs")


@query("a05_part_numbers", """select source, count(*) n, max(part) last_part, cast(sum(part*doc_id) as bigint) checksum from
 (select source, doc_id, row_number() over (partition by source order by doc_id)-1 part from documents) group by 1""")
def a05(spark, sf):
    got = S.part_numbers(T.table(spark, sf, "documents").select("doc_id", "source"))
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last_part"), F.sum(F.col("part") * F.col("doc_id")).alias("checksum"))


@query("a06_licence_gate", "with " + REG + f" select source, count(*) n, cast(sum(n_chars) as bigint) chars from documents where source in (select id from reg where {CLEARED_SQL}) group by 1")
def a06(spark, sf):
    got = S.licence_gate(T.table(spark, sf, "documents").select("doc_id", "source", "n_chars"), register(spark))
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _html_sql():
    t = "html"
    for tag in ("script", "style", "table"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<sup\\b.*?</sup>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<h[1-3][^>]*>', chr(10)||'## ', 'g')"
    t = f"regexp_replace({t}, '(?i)<(br|/p|/li|/h\\d|/div)[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?i)<li[^>]*>', chr(10)||'- ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    for a, b in S.ENTITIES:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    t = f"regexp_replace({t}, '[ \\t\\x{{00A0}}]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, ' ?\\n ?', chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)||' ')"


@query("a07_page_sections", "with tx as (select page_id, chr(10)||" + _html_sql() + """ t from pages),
 pt as (select page_id, unnest(string_split(t, chr(10)||'## ')) part, unnest(range(len(string_split(t, chr(10)||'## ')))) pos from tx),
 sp as (select page_id, pos, trim(string_split(part,chr(10))[1]) heading, substr(part, length(string_split(part,chr(10))[1])+1) rest from pt where pos>0),
 bd as (select page_id, pos, heading, trim(regexp_split_to_array(rest, '\\n(©|Content current as of)')[1], chr(10)||' ') body from sp)
 select page_id, count(*) n_sections, cast(sum(length(body)) as bigint) chars, min(md5(heading||body)) fingerprint from bd
 where body<>'' and not regexp_matches(heading,'^(References|Related)') group by 1""")
def a07(spark, sf):
    got = S.page_sections(T.table(spark, sf, "pages"))
    return got.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("body").cast("bigint")).alias("chars"),
                                      F.min(F.md5(F.concat("heading", "body"))).alias("fingerprint"))


@query("a08_confirmed_price", """with pp as (select p_partkey, case when p_size<5 then 'n/a' else cast(p_retailprice as varchar) end price,
  case when p_size>45 then '' else '2024-01-01' end as_of, p_brand price_source, case when p_type='PROMO' then 'DRAFT' else 'CONFIRMED' end price_status from part),
 j as (select l_orderkey, case when price_status='CONFIRMED' and try_cast(price as double) is not null and as_of<>'' and price_source<>'' then try_cast(price as double) end shown
   from lineitem left join pp on l_partkey=p_partkey)
 select case when shown is null then 'price unavailable' else 'about '||format('{:,}', cast(round(shown,0) as bigint)) end price_label, count(*) n, round(sum(shown),2) total from j group by 1""")
def a08(spark, sf):
    s = F.col("p_size")
    prices = T.table(spark, sf, "part").select(
        "p_partkey", F.when(s < 5, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.when(s > 45, "").otherwise("2024-01-01").alias("as_of"), F.col("p_brand").alias("price_source"),
        F.when(F.col("p_type") == "PROMO", "DRAFT").otherwise("CONFIRMED").alias("price_status"))
    lines = T.table(spark, sf, "lineitem").select("l_partkey")
    got = S.confirmed_price(lines.join(prices, F.col("l_partkey") == F.col("p_partkey"), "left"))
    return got.groupBy("price_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("shown_price"), 2).alias("total"))


@query("a09_write_metrics", V.rounded(C._s, ["target"], C.NUM, 4, V.COHORT + "," + C._c))
def a09(spark, sf):
    got = E.naive(E.cell_stats(T.cohort(spark, sf)))
    path = shared_dir(spark, f"evenhand_metrics_{uuid.uuid4().hex[:12]}")
    S.write_metrics(got, path, ["target", "value", "se", "ci_low", "ci_high"], "csv")
    return S.read_metrics(spark, path, "target string, value double, se double, ci_low double, ci_high double", "csv")


_OLD = "select event_type grp, count(*) n, round(max(value),4) top from events where ts < (select min(ts) + interval 15 day from events) group by 1"
_NEW = "select event_type grp, count(*) n, round(max(value),4) top from events where event_type in ('error','view') group by 1"


@query("a11_replace_by_key", f"select * from ({_OLD}) where grp not in (select grp from ({_NEW})) union all {_NEW}")
def a11(spark, sf):
    ev = T.table(spark, sf, "events").select("ts", F.col("event_type").alias("grp"), "value")
    start = ev.agg(F.min("ts").alias("__t0"))

    def summary(df):
        return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("top"))

    old = summary(ev.crossJoin(F.broadcast(start)).where(F.col("ts") < F.col("__t0") + F.expr("INTERVAL 15 DAYS")))
    return S.replace_by_key(old, summary(ev.where(F.col("grp").isin("error", "view"))), ["grp"])


@query("a12_parse_drafts", """with d as (select event_type, case event_type when 'error' then substr(props,1,length(props)-1) when 'view' then replace(props,'"k"','"z"') else props end raw from events)
 select event_type, case when not json_valid(raw) then 'INVALID_JSON' when try_cast(json_extract_string(case when json_valid(raw) then raw else '{}' end,'$.k') as bigint) is null then 'SCHEMA_INVALID' else 'OK' end code,
 count(*) n, cast(sum(try_cast(json_extract_string(case when json_valid(raw) then raw else '{}' end,'$.k') as bigint)) as bigint) total from d group by all""")
def a12(spark, sf):
    p, kind = F.col("props"), F.col("event_type")
    raw = F.when(kind == "error", F.expr("substring(props, 1, length(props) - 1)")).when(kind == "view", F.replace(p, F.lit('"k"'), F.lit('"z"'))).otherwise(p)
    got = S.parse_drafts(T.table(spark, sf, "events").select("event_type", raw.alias("raw")), "raw", "k bigint", ["k"])
    return got.groupBy("event_type", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("draft.k").alias("total"))
