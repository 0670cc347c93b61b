"""SQL text of the derived views, shared by the equivalent SQL of many queries."""

from __future__ import annotations

COHORT = """
li as (
  select l_orderkey, sum(l_quantity) x2,
    cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18,4))) as double)/1000 y,
    cast(sum(cast(l_discount as decimal(18,4))) as double)/count(l_discount)*100 y2,
    max(case when l_returnflag='R' then 1 else 0 end) y3, max(l_shipdate) last_ship
  from lineitem group by 1),
cohort as (
  select o_orderkey unit_id, case o_orderstatus when 'F' then 'A' when 'O' then 'B' else 'C' end arm,
    (c_acctbal-4500)/3200 x1, x2,
    case when c_mktsegment in ('BUILDING','MACHINERY') then 1 else 0 end b1,
    case when o_orderpriority in ('1-URGENT','2-HIGH') then 1 else 0 end b2,
    c_mktsegment seg, o_orderpriority prio, c_mktsegment||'|'||o_orderpriority cell, y, y2, y3,
    case when last_ship > o_orderdate + interval 60 day then 1 else 0 end m1
  from orders join li on o_orderkey=l_orderkey join customer on o_custkey=c_custkey)"""


def u(salt: str, unit: str = "unit_id") -> str:
    """A hash uniform; ``salt`` is an SQL expression."""
    return f"(('0x'||substr(md5(cast({unit} as varchar)||':'||{salt}),1,8))::BIGINT/4294967296.0)"


def planted(mult: str = "1.0", rep: str | None = None, source: str = "punits", name: str = "planted") -> str:
    """The planted view over ``source`` (which may carry columns named by ``mult`` and ``rep``)."""
    tail = "" if rep is None else f"||':'||cast({rep} as varchar)"
    eps = "+".join(u(f"'{k}'{tail}") for k in ("n1", "n2", "n3", "n4"))
    return f"""
{name}_s as (select *, exp({mult}*(0.8*x1+0.5*b1)) sa, exp({mult}*(-0.3*x1+0.8*b2)) sc from {source}),
{name}_e as (select *, sa/(sa+1+sc) e_true_a, 1/(sa+1+sc) e_true_b, sc/(sa+1+sc) e_true_c,
   -1.05-0.20*x1+0.10*b1 mu_true_a, -0.85-0.12*x1 mu_true_b, -1.15-0.25*x1+0.15*b2 mu_true_c,
   {u("'t'" + tail)} ut, 0.6*sqrt(3.0)*({eps}-2) eps from {name}_s),
{name}_r as (select *, case when ut<e_true_a then 'A' when ut<e_true_a+e_true_b then 'B' else 'C' end arm from {name}_e),
{name} as (select *, case arm when 'A' then mu_true_a when 'B' then mu_true_b else mu_true_c end + eps y from {name}_r)"""


PUNITS = """
punits as (
  select o_orderkey unit_id, (c_acctbal-4500)/3200 x1,
    case when c_mktsegment in ('BUILDING','MACHINERY') then 1 else 0 end b1,
    case when o_orderpriority in ('1-URGENT','2-HIGH') then 1 else 0 end b2,
    cast(least(7,greatest(0,floor(((c_acctbal-4500)/3200+1.75)/0.4375)))*4
      + (case when c_mktsegment in ('BUILDING','MACHINERY') then 1 else 0 end)*2
      + (case when o_orderpriority in ('1-URGENT','2-HIGH') then 1 else 0 end) as int) cell
  from orders join customer on o_custkey=c_custkey
  where exists (select 1 from lineitem where l_orderkey=o_orderkey))"""

PLANTED = PUNITS + "," + planted()


def folds(src: str, name: str = "f", k: int = 5, salt: str = "fold", by: str = "") -> str:
    by = f"{by}," if by else ""
    return f"""
{name} as (select *, cast((row_number() over (partition by {by} arm order by md5(cast(unit_id as varchar)||':{salt}'))-1)%{k} as int) fold from {src})"""


def nuisance(src: str, name: str = "nz", by: str = "", y: str = "y", arms=("A", "B", "C"), cross: bool = True,
             floor: float = 0.01) -> str:
    """Cross-fitted cell propensity and outcome mean at (by, cell, fold, arm), written with correlated sums."""
    b = f"{by}," if by else ""
    vals = ",".join(f"('{a}')" for a in arms)
    j = " ".join(f"and c.{x.strip()}=g.{x.strip()}" for x in by.split(",")) if by else ""
    other = "and c.fold<>g.fold" if cross else ""
    return f"""
{name}_c as (select {b} cell, fold, arm, count(*) n, sum({y}) s from {src} group by all),
{name}_g as (select {b} cell, fold, arm from (select distinct {b} cell, fold from {src}) cross join (values {vals}) v(arm)),
{name}_o as (select {b} g.cell, g.fold, g.arm,
   coalesce((select sum(n) from {name}_c c where c.cell=g.cell and c.arm=g.arm {other} {j}),0) n_out,
   coalesce((select sum(s) from {name}_c c where c.cell=g.cell and c.arm=g.arm {other} {j}),0) s_out,
   coalesce((select sum(n) from {name}_c c where c.cell=g.cell {other} {j}),0) n_all,
   (select sum(s)/sum(n) from {name}_c c where c.arm=g.arm {other} {j}) arm_mean from {name}_g g),
{name}_q as (select {b} cell, fold, arm, n_out, case when n_out>0 then n_out/n_all else {floor} end e_raw,
   case when n_out>0 then s_out/n_out else arm_mean end mu from {name}_o),
{name} as (select *, greatest(e_raw,{floor})/sum(greatest(e_raw,{floor})) over (partition by {b} cell, fold) e from {name}_q)"""


def scores(src: str, nz: str = "nz", name: str = "sc", by: str = "", y: str = "y", arms=("A", "B", "C")) -> str:
    """Unit-level e, mu and phi, wide."""
    b = f"{by}," if by else ""
    cols = ",".join(f"max(case when arm='{a}' then e end) e_{a}, max(case when arm='{a}' then mu end) mu_{a}" for a in arms)
    phi = ",".join(f"mu_{a} + case when arm='{a}' then ({y}-mu_{a})/e_{a} else 0 end phi_{a}" for a in arms)
    return f"""
{name}_w as (select {b} cell, fold, {cols} from {nz} group by all),
{name} as (select *, {phi} from {src} join {name}_w using ({b} cell, fold))"""


CONTRASTS = (("A", "B"), ("A", "C"), ("B", "C"))


def influence(src: str, prefix: str = "phi", by: str = "", arms=("A", "B", "C"), value=None, z: float = 1.959964) -> str:
    """Select text: (by, target, value, se, ci_low, ci_high, n) from unit-level influence columns."""
    b = f"{by}," if by else ""
    g = f"group by {by}" if by else ""
    parts = [f"select {b} '{a}' target, avg({prefix}_{a}) v, stddev_samp({prefix}_{a})/sqrt(count(*)) s, count(*) n from {src} {g}" for a in arms]
    parts += [f"select {b} '{a}-{c}' target, avg({prefix}_{a}-{prefix}_{c}) v, stddev_samp({prefix}_{a}-{prefix}_{c})/sqrt(count(*)) s, count(*) n from {src} {g}"
              for i, a in enumerate(arms) for c in arms[i + 1:]]
    return f"select {b} target, v value, s se, v-{z}*s ci_low, v+{z}*s ci_high, n from (" + " union all ".join(parts) + ")"


FULL_FIT = COHORT + "," + folds("cohort") + "," + nuisance("f") + "," + scores("f")
PLANTED_FIT = PLANTED + "," + folds("planted") + "," + nuisance("f") + "," + scores("f")


def rounded(select: str, text: list[str], nums: list[str], places: int = 6, ctes: str = "") -> str:
    """``with … select`` with doubles rounded."""
    cols = ", ".join(text + [f"round(cast({c} as double),{places}) {c}" for c in nums])
    head = f"with {ctes} " if ctes else ""
    return f"{head} select {cols} from ({select}) zz"
