"""Validation, eligibility rules, support, overlap, status and evidence levels.

Rule tables are configuration. Their size is checked when they are read and they are compiled into column expressions,
so applying them costs no join and no shuffle, and eligibility is decided in the scan that reads the units.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand import config as cfg
from evenhand.functions.stats import fsum, union_all

MAX_RULES = 500
OPS = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
       "eq": lambda a, b: a == b}
ACTIONS = ("EXCLUDE", "CAUTION")
STATUSES = ("VERIFIED", "UNVERIFIED")
RULE_COLUMNS = ("rule_id", "arm", "field", "op", "value", "action", "message", "source", "status")


class RuleError(ValueError):
    """A rule table or a row that cannot be trusted."""


def read_config(rules: DataFrame, limit: int = MAX_RULES) -> list:
    """The rows of a configuration table, refused when it is larger than a rule table can be."""
    rows = rules.limit(limit + 1).collect()
    if len(rows) > limit:
        raise RuleError(f"more than {limit} rules: this is not a rule table")
    return rows


# Rule tables


def rule_problems(rules: DataFrame, arms, fields) -> DataFrame:
    """(rule_id, problem): every reason a row of a flat rule table cannot be used, duplicates included."""
    empty = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.concat(F.lit("empty "), F.lit(c))) for c in RULE_COLUMNS]

    def unknown(c, allowed):
        return F.when((F.trim(F.col(c)) != "") & ~F.col(c).isin(*allowed), F.concat(F.lit(f"unknown {c} "), F.col(c)))

    checks = [*empty, unknown("arm", arms), unknown("field", fields), unknown("op", list(OPS)), unknown("action", ACTIONS),
              unknown("status", STATUSES),
              F.when((F.trim("value") != "") & F.expr("try_cast(value as double)").isNull(), F.lit("value is not a number"))]
    rows = rules.select("rule_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    twice = rules.groupBy("rule_id").count().where("count > 1").select("rule_id", F.lit("duplicate rule_id").alias("problem"))
    return rows.unionByName(twice)


def load_rules(rules: DataFrame, arms, fields) -> list:
    """The rows of a valid flat rule table; an error naming the first problem otherwise."""
    missing = [c for c in RULE_COLUMNS if c not in rules.columns]
    if missing:
        raise RuleError(f"columns missing: {missing}")
    rows = read_config(rules)
    if not rows:
        raise RuleError("the rule table is empty")
    first = rule_problems(rules, arms, fields).orderBy("rule_id", "problem").first()
    if first:
        raise RuleError(f"{first['rule_id']}: {first['problem']}")
    return rows


def expression_rules(df: DataFrame, rules: list[dict], strict: bool = False) -> tuple[list[dict], list[tuple[str, str]]]:
    """(usable rules, refused (id, why)). A condition is tried by analysing it against the units' own columns."""
    usable, refused = [], []
    for r in rules:
        why = None
        if not r.get("source"):
            why = "no source"
        elif "TODO" in r["source"] or "TODO" in r["condition"]:
            why = "placeholder"
        elif r["scope"] not in ("patient", "option"):
            why = "unknown scope"
        elif r["action"] not in ("abstain", "do_not_use", "check_first", "info"):
            why = "unknown action"
        else:
            try:
                kind = dict(df.limit(0).select(F.expr(r["condition"]).alias("c")).dtypes)["c"]
                why = None if kind == "boolean" else "condition is not true or false"
            except (AnalysisException, ParseException):
                why = "condition could not be read"
        if why is None:
            usable.append(r)
        elif strict:
            raise RuleError(f"{r['id']}: {why}")
        else:
            refused.append((r["id"], why))
    return usable, refused


# Applying rules


def _fires(rule, columns, strict: bool) -> Column:
    if rule["field"] not in columns:
        raise RuleError(f"{rule['rule_id']} needs '{rule['field']}', which was not given")
    x = F.col(rule["field"]).cast("double")
    test = OPS[rule["op"]](x, F.lit(float(rule["value"])))
    if strict:  # a rule that cannot be checked stops the job
        return F.when(x.isNull(), F.raise_error(F.lit(f"{rule['rule_id']} needs '{rule['field']}', which is empty")).cast("boolean")).otherwise(test)
    return F.coalesce(test, F.lit(False))


def verdict_columns(units: DataFrame, rules, arms=cfg.ARMS, strict: bool = True) -> DataFrame:
    """Adds excluded_<arm> and fired_<arm> (rule ids in table order)."""
    cols = []
    for a in arms:
        mine = [r for r in rules if r["arm"] == a]
        tests = [(r, _fires(r, units.columns, strict)) for r in mine]
        ex = [t for r, t in tests if r["action"] == "EXCLUDE"]
        any_ex = F.lit(False)
        for t in ex:
            any_ex = any_ex | t
        ids = [F.when(t, F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["action"]).alias("action"))) for r, t in tests]
        fired = F.array_compact(F.array(*ids)) if ids else F.array().cast("array<struct<rule_id:string,action:string>>")
        cols += [any_ex.alias(f"excluded_{a}"), fired.alias(f"fired_{a}")]
    return units.select("*", *cols)


def verdicts(units: DataFrame, rules, arms=cfg.ARMS, strict: bool = True, extra=()) -> DataFrame:
    """(unit_id, arm, excluded, fired, status): one row per unit and arm."""
    wide = verdict_columns(units, rules, arms, strict)
    rows = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"excluded_{a}").alias("excluded"), F.col(f"fired_{a}").alias("fired")) for a in arms])
    out = wide.select("unit_id", *extra, F.explode(rows).alias("__v")).select("unit_id", *extra, "__v.*")
    status = F.when(F.col("excluded"), "excluded").when(F.size("fired") > 0, "caution").otherwise("no_rule_fired")
    return out.withColumn("status", status)


SEVERITY = {"info": 0, "check_first": 1, "do_not_use": 2}


def apply_expression_rules(units: DataFrame, rules: list[dict], options) -> DataFrame:
    """Adds stop_rule (first patient rule that fires), status_<option>, rules_<option>, blocked.

    A condition over missing values is null and does not fire, unless it asks IS NULL itself.
    """
    def fires(r):
        return F.coalesce(F.expr(r["condition"]), F.lit(False))

    patient = [F.when(fires(r), F.lit(r["id"])) for r in rules if r["scope"] == "patient"]
    cols, status = [], {}
    for o in options:
        mine = [r for r in rules if r["scope"] == "option" and r["option"] == o]
        rank = F.greatest(F.lit(0), F.lit(0), *[F.when(fires(r), F.lit(SEVERITY[r["action"]])).otherwise(0) for r in mine])
        status[o] = F.when(rank == 2, "do_not_use").when(rank == 1, "check_first").otherwise("safe_to_consider")
        fired = F.array_compact(F.array(*[F.when(fires(r), F.lit(r["id"])) for r in mine])) if mine else F.array().cast("array<string>")
        cols += [status[o].alias(f"status_{o}"), fired.alias(f"rules_{o}")]
    none_left = F.lit(True)
    for o in options:
        none_left = none_left & (status[o] == "do_not_use")
    stop = F.coalesce(*patient) if patient else F.lit(None).cast("string")
    return units.select("*", stop.alias("stop_rule"), (stop.isNotNull() | none_left).alias("blocked"), *cols)


# Ranges, bands, roles


def range_violations(df: DataFrame, key: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(key, field, value, lo, hi): one row per value outside its accepted range."""
    parts = [F.when((F.col(f) < lo) | (F.col(f) > hi),
                    F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))
             for f, (lo, hi) in ranges.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*parts))).alias("__v")).select(key, "__v.*")


def band(x: Column, cuts: list[tuple[float, str]], above: str) -> Column:
    """The first band whose upper limit is above the value; the last band is open."""
    out = F.lit(above)
    for limit, name in reversed(cuts):
        out = F.when(x < limit, F.lit(name)).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def observed_view(df: DataFrame, prefixes=("y_true_", "mu_true_", "e_true_")) -> DataFrame:
    """The table without hidden-truth columns."""
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes))])


def adjustment_roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(variable, role, adjust, why, problem) from a node table (node, role) and an edge table (src, dst).

    Adjusts for confounders and pure predictors of treatment or outcome; a role must agree with the edges.
    """
    into = edges.groupBy("src").agg(F.bool_or(F.col("dst") == "treatment").alias("to_t"), F.bool_or(F.col("dst") == "outcome").alias("to_y"))
    back = edges.groupBy("dst").agg(F.bool_or(F.col("src") == "treatment").alias("from_t"))
    j = nodes.join(into, F.col("node") == F.col("src"), "left").join(back, F.col("node") == F.col("dst"), "left")
    to_t, to_y, from_t = (F.coalesce(F.col(c), F.lit(False)) for c in ("to_t", "to_y", "from_t"))
    adjust = F.col("role").isin("confounder", "treatment_predictor", "outcome_predictor")
    why = (F.when(F.col("role") == "confounder", "causes both: leaving it out biases the effect")
           .when(F.col("role") == "treatment_predictor", "predicts the arm before treatment")
           .when(F.col("role") == "outcome_predictor", "predicts the outcome before treatment")
           .when(F.col("role") == "mediator", "on the path of the effect: adjusting removes part of it")
           .when(F.col("role") == "collider", "caused by both: adjusting opens a false path")
           .otherwise("derived from other columns"))
    problem = (F.when((F.col("role") == "confounder") & ~(to_t & to_y), "a confounder must point to treatment and outcome")
               .when((F.col("role") == "mediator") & ~from_t, "a mediator must follow treatment"))
    return j.select(F.col("node").alias("variable"), "role", adjust.alias("adjust"), why.alias("why"), problem.alias("problem"))


# Severity-ranked flags that read the estimate


def severity_flags(df: DataFrame, flags: list[tuple[str, int, Column]]) -> DataFrame:
    """Adds flags (array of rule names in order), severity (highest, 0 if none) and guard_status."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, _, c in flags]))
    sev = F.greatest(F.lit(0), F.lit(0), *[F.when(c, F.lit(s)).otherwise(0) for _, s, c in flags])
    status = F.when(sev == 3, "BLOCKED").when(sev == 2, "HOLD").when(sev == 1, "CAUTION").otherwise("APPROVED")
    return df.withColumn("flags", names).withColumn("severity", sev).withColumn("guard_status", status)


def direction(effect: Column, severity: Column, first: str, second: str, limit: float = 0.3, higher_is_better: bool = True) -> Column:
    """blocked, equivalent, or the better arm."""
    good = effect > 0 if higher_is_better else effect < 0
    return F.when(severity == 3, "blocked").when(F.abs(effect) < limit, "equivalent").when(good, first).otherwise(second)


# Support and overlap


def support_ranges(train: DataFrame, covariates) -> dict[str, tuple]:
    """Per covariate (min, max, the values if at most two else None): one aggregate over the training rows."""
    aggs = []
    for i, c in enumerate(covariates):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 F.sum(F.when((x != 0) & (x != 1), 1).otherwise(0)).alias(f"other{i}")]
    row = train.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(covariates):
        lo, hi, binary = row[f"lo{i}"], row[f"hi{i}"], row[f"other{i}"] == 0
        out[c] = (lo, hi, sorted({lo, hi}) if binary else None)
    return out


def support_reasons(ranges: dict[str, tuple]) -> Column:
    """Array of reasons why a unit lies outside the training table (empty = inside)."""
    parts = []
    for c, (lo, hi, values) in ranges.items():
        x = F.col(c).cast("double")
        if values is not None:
            parts.append(F.when(~x.isin(*values), F.concat(F.lit(f"{c}: value never seen"))))
        else:
            parts.append(F.when((x < lo) | (x > hi), F.lit(f"{c}: outside the range")))
    return F.array_compact(F.array(*parts))


def overlap_ok(e: Column, minimum: float = cfg.OVERLAP_MIN) -> Column:
    return e >= F.lit(minimum)


# Status per unit and arm


def resolve_status(df: DataFrame, arms=cfg.ARMS, minimum: float = cfg.OVERLAP_MIN, max_width: float = cfg.MAX_WIDTH) -> DataFrame:
    """Adds status_<arm> and applicable from excluded_<arm>, outside (array), e_<arm>, value_<arm>, se_<arm>."""
    cols, any_est, all_ex = [], F.lit(False), F.lit(True)
    for a in arms:
        width = 2 * cfg.CI_Z * F.col(f"se_{a}")
        s = (F.when(F.col(f"excluded_{a}"), "excluded").when(F.size("outside") > 0, "outside_support")
             .when(~overlap_ok(F.col(f"e_{a}"), minimum), "low_overlap").when(width > max_width, "too_uncertain").otherwise("estimate"))
        cols.append(s.alias(f"status_{a}"))
        any_est, all_ex = any_est | (s == "estimate"), all_ex & F.col(f"excluded_{a}")
    reason = (F.when(any_est, F.lit(None)).when(all_ex, "every option is excluded by a rule")
              .when(F.size("outside") > 0, F.concat_ws("; ", "outside")).otherwise("no option has a useful estimate"))
    return df.select("*", *cols, F.when(any_est, "APPLICABLE").otherwise("NOT_APPLICABLE").alias("applicable"), reason.alias("reason"))


def options_long(df: DataFrame, arms=cfg.ARMS, extra=()) -> DataFrame:
    """(unit_id, arm, status, e, value, ci_low, ci_high, fired): numbers only where there is an estimate."""
    rows = []
    for a in arms:
        est = F.col(f"status_{a}") == "estimate"
        v, half = F.col(f"value_{a}"), cfg.CI_Z * F.col(f"se_{a}")
        rows.append(F.struct(F.lit(a).alias("arm"), F.col(f"status_{a}").alias("status"), F.col(f"e_{a}").alias("e"),
                             F.when(est, v).alias("value"), F.when(est, v - half).alias("ci_low"), F.when(est, v + half).alias("ci_high"),
                             F.col(f"fired_{a}").alias("fired")))
    return df.select("unit_id", "applicable", *extra, F.explode(F.array(*rows)).alias("__o")).select("unit_id", "applicable", *extra, "__o.*")


def comparisons_long(df: DataFrame, arms=cfg.ARMS) -> DataFrame:
    """(unit_id, target, value, ci_low, ci_high) between two arms that both have an estimate."""
    rows = []
    for a, b in cfg.contrasts(arms):
        both = (F.col(f"status_{a}") == "estimate") & (F.col(f"status_{b}") == "estimate")
        v, half = F.col(f"value_{a}-{b}"), cfg.CI_Z * F.col(f"se_{a}-{b}")
        rows.append(F.when(both, F.struct(F.lit(f"{a}-{b}").alias("target"), v.alias("value"), (v - half).alias("ci_low"), (v + half).alias("ci_high"))))
    return df.select("unit_id", F.explode(F.array_compact(F.array(*rows))).alias("__c")).select("unit_id", "__c.*")


def evidence_level(df: DataFrame, low_width: float = 1.0, max_width: float = cfg.MAX_WIDTH, min_e: float = cfg.OVERLAP_MIN,
                   low_e: float = 0.10, min_citations: int | None = None) -> DataFrame:
    """Adds level and level_reason from status, e, ci_low, ci_high (and citations when given)."""
    width = F.round(F.col("ci_high") - F.col("ci_low"), 3)
    wide = F.concat(F.lit("interval "), F.format_number(F.round(width, 2), 2), F.lit(" wide"))
    prop = F.concat(F.lit("propensity "), F.format_number(F.round("e", 2), 2))
    low = [F.when(width > low_width, wide), F.when(F.col("e") < low_e, prop)]
    if min_citations is not None:
        low.append(F.when(F.col("citations") < min_citations, F.concat(F.col("citations").cast("string"), F.lit(" cited"))))
    reasons = F.array_compact(F.array(*low))
    level = (F.when(F.col("status") == "excluded", F.lit(None)).when(F.col("status") != "estimate", "Insufficient")
             .when((F.col("e") < min_e) | (width > max_width), "Insufficient").when(F.size(reasons) > 0, "Low").otherwise("Moderate"))
    why = (F.when(F.col("status") == "excluded", F.concat(F.lit("removed by "), F.concat_ws(", ", F.transform(
               F.filter("fired", lambda f: f["action"] == "EXCLUDE"), lambda f: f["rule_id"]))))
           .when(F.col("status") != "estimate", abstain_reason(F.col("status"), F.col("e")))
           .when(level == "Low", F.concat_ws("; ", reasons)).when(level == "Insufficient", F.concat_ws("; ", F.array(wide, prop)))
           .otherwise(F.concat_ws(", ", F.array(wide, prop))))
    return df.withColumn("level", level).withColumn("level_reason", why)


def abstain_reason(status: Column, e: Column, limit: float = cfg.MAX_WIDTH) -> Column:
    """One line per option without a usable estimate."""
    return (F.when(status == "low_overlap", F.concat(F.lit("too few similar units (propensity "), F.format_number(F.round(e, 2), 2), F.lit(")")))
            .when(status == "too_uncertain", F.lit("the interval is too wide for a useful estimate"))
            .when(status == "outside_support", F.lit("outside the range of the reference data")))


def constraint_violations(options: DataFrame, text_columns=(), dose_pattern: str | None = None) -> DataFrame:
    """(unit_id, constraint): rows of an options table that break an output rule; expected to be empty."""
    est = F.col("status") == "estimate"
    checks = [
        ("estimate needs low <= value <= high", est & ~F.coalesce((F.col("ci_low") <= F.col("value")) & (F.col("value") <= F.col("ci_high")), F.lit(False))),
        ("only an estimate carries a number", ~est & F.col("value").isNotNull()),
        ("an excluded option cites an EXCLUDE rule", (F.col("status") == "excluded") & ~F.exists("fired", lambda f: f["action"] == "EXCLUDE")),
        ("a removed option never has an estimate", est & F.exists("fired", lambda f: f["action"] == "EXCLUDE")),
        ("NOT_APPLICABLE has no estimate", (F.col("applicable") == "NOT_APPLICABLE") & est),
    ]
    if dose_pattern:
        for c in text_columns:
            checks.append((f"amount-like text in {c}", F.coalesce(F.col(c).rlike(dose_pattern), F.lit(False))))
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    return options.select("unit_id", F.explode(found).alias("constraint"))
