"""Small configuration tables used by the registered queries (all are parameters of the operators)."""

from __future__ import annotations

RULES = [  # rule_id, arm, field, op, value, action
    dict(rule_id="R1", arm="A", field="x1", op="lt", value=-1.2, action="EXCLUDE"),
    dict(rule_id="R2", arm="A", field="b1", op="eq", value=1, action="CAUTION"),
    dict(rule_id="R3", arm="B", field="x2", op="ge", value=180, action="EXCLUDE"),
    dict(rule_id="R4", arm="B", field="b2", op="eq", value=1, action="CAUTION"),
    dict(rule_id="R5", arm="C", field="x1", op="ge", value=1.3, action="EXCLUDE"),
    dict(rule_id="R6", arm="C", field="x2", op="lt", value=20, action="EXCLUDE"),
    dict(rule_id="R7", arm="C", field="b1", op="eq", value=1, action="CAUTION"),
    dict(rule_id="R8", arm="B", field="x1", op="le", value=-1.4, action="CAUTION"),
]

# the planted view has no x2
PLANTED_RULES = [r for r in RULES if r["field"] != "x2"]

EXPRESSION_RULES = [
    dict(id="G00", scope="patient", option=None, condition="x1 < -1.5", action="abstain", source="label 1"),
    dict(id="G01", scope="patient", option=None, condition="x2n IS NULL", action="abstain", source="label 1"),
    dict(id="G02", scope="option", option="A", condition="x2n >= 150", action="do_not_use", source="label 2"),
    dict(id="G03", scope="option", option="A", condition="b1 = 1 AND x1 > 0", action="check_first", source="label 2"),
    dict(id="G04", scope="option", option="B", condition="x2n >= 120", action="do_not_use", source="label 3"),
    dict(id="G05", scope="option", option="B", condition="b2 = 1", action="info", source="label 3"),
    dict(id="G06", scope="option", option="C", condition="x1 >= 1.0 OR x2n >= 200", action="do_not_use", source="label 4"),
    dict(id="G07", scope="option", option="C", condition="no_such_column > 1", action="check_first", source="label 4"),
    dict(id="G08", scope="option", option="C", condition="x1 >", action="check_first", source="label 4"),
    dict(id="G09", scope="option", option="C", condition="b1 = 1", action="check_first", source=""),
    dict(id="G10", scope="option", option="C", condition="b1 = 1", action="maybe", source="label 4"),
    dict(id="G11", scope="option", option="C", condition="b1 = 1", action="check_first", source="TODO"),
]

NODES = [("x1", "confounder"), ("b1", "treatment_predictor"), ("b2", "outcome_predictor"), ("x2", "outcome_predictor"),
         ("m1", "mediator"), ("y3", "collider"), ("y2", "confounder")]
EDGES = [("x1", "treatment"), ("x1", "outcome"), ("b1", "treatment"), ("b2", "outcome"), ("x2", "outcome"), ("treatment", "m1"),
         ("m1", "outcome"), ("treatment", "y3"), ("outcome", "y3"), ("y2", "treatment"), ("treatment", "outcome")]

REGISTER_SCHEMA = "id string, title string, issuer string, version string, bucket string, checked_by string, tier string, relevance string"


def register_rows(n: int = 20) -> list[tuple]:
    """One row per source src0 … src<n-1>, filled by rule: two are versions of one title, some checks are drafts."""
    out = []
    for i in range(n):
        title = "Guide 1" if i in (1, 2) else f"Guide {i}"
        version = {1: "2019-05", 2: "2023"}.get(i, "undated" if i % 7 == 6 else f"{2010 + i % 12}-{1 + i % 9:02d}-{1 + i:02d}")
        bucket = "RED" if i % 5 == 4 else "GREEN"
        checked = "" if i % 9 == 8 else ("ann (DRAFT)" if i % 11 == 10 else "ben")
        out.append((f"src{i}", title, f"Body {1 if i in (1, 2) else i % 3}", version, bucket, checked, str(1 + i % 4),
                    ["india", "global", "other_country", "unknown"][(i // 2) % 4]))
    return out


def sql_values(name: str, columns: list[str], rows) -> str:
    """A literal table as an SQL common table expression."""
    def lit(v):
        if v is None:
            return "null"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    body = ",".join("(" + ",".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({','.join(columns)}) as (values {body})"
