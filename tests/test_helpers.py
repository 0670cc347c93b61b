import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions.ranking import average_ranks, exact_quantiles, global_rank, hash_rank
from evenhand.functions.hashing import hash_key
from evenhand.operators import corpus as K
from evenhand.operators import retrieval as H
from evenhand.operators import rules as R
from evenhand.operators import screening as S
from evenhand.sources import literals as LT
from evenhand.sources import readers as RD


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows share one value and one group."""
    rng = np.random.default_rng(1)
    rows = [(i, "g0" if i % 3 == 0 else f"g{i % 5}", 5.0 if i % 3 == 0 else float(rng.normal(5, 2))) for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, g string, v double").persist()


def test_global_rank_with_hot_value(hot):
    pdf = hot.toPandas().sort_values(["v", "id"], kind="stable").reset_index(drop=True)
    got = global_rank(hot, "v", "id", "r", sum_cols={"v": "run"}).toPandas().sort_values("r")
    assert got["r"].tolist() == list(range(1, 3001)) and got["id"].tolist() == pdf["id"].tolist()
    assert np.allclose(got["run"], pdf["v"].cumsum())


def test_global_rank_by_group_descending(hot):
    got = global_rank(hot, "v", "id", "r", by=("g",), descending=True).toPandas()
    for _, p in got.groupby("g"):
        p = p.sort_values("r")
        assert p["r"].tolist() == list(range(1, len(p) + 1)) and (p["v"].diff().dropna() <= 0).all()


def test_quantiles_and_ranks_are_exact(hot):
    pdf = hot.toPandas()
    for r in exact_quantiles(hot, "v", [0.05, 0.5, 0.95], ("g",)).collect():
        assert abs(r["value"] - np.quantile(pdf.loc[pdf.g == r["g"], "v"], r["p"])) < 1e-12
    ranks = average_ranks(hot, "v", "r").toPandas().set_index("v")["r"]
    assert np.allclose(pdf["v"].map(ranks), pdf["v"].rank())


def test_hash_rank_is_a_permutation(hot):
    got = hash_rank(hot.withColumn("h", hash_key("id", "s")), "h", "r").toPandas()
    assert sorted(got["r"]) == list(range(1, 3001)) and got.sort_values("r")["h"].is_monotonic_increasing


def test_rule_boundaries_and_missing(spark):
    df = spark.createDataFrame([(1, -1.2, 180.0), (2, -1.21, 179.9)], "unit_id int, x1 double, x2 double").withColumn("b1", F.lit(1)).withColumn("b2", F.lit(0))
    got = {(r["unit_id"], r["arm"]): r["status"] for r in R.verdicts(df, LT.RULES).collect()}
    assert got[1, "A"] == "caution" and got[2, "A"] == "excluded" and got[1, "B"] == "excluded" and got[2, "B"] == "no_rule_fired"
    with pytest.raises(R.RuleError):
        R.verdicts(df.drop("x2"), LT.RULES)
    with pytest.raises(Exception):
        R.verdicts(df.withColumn("x1", F.lit(None).cast("double")), LT.RULES).collect()


def test_licence_gate_is_strict(spark):
    reg = spark.createDataFrame(LT.register_rows(), LT.REGISTER_SCHEMA)
    docs = spark.createDataFrame([(1, "src0"), (2, "src4")], "doc_id int, source string")
    assert [r["doc_id"] for r in RD.licence_gate(docs, reg).collect()] == [1]
    with pytest.raises(RD.SourceError):
        RD.licence_gate(docs, reg, strict=True)


def test_sections_and_chunks(spark):
    doc = spark.createDataFrame([(1, "intro\n[page 2]\nmore\n## One\n[page 3] a b. c d e. f\n## Two [page 4]\ng")], "doc_id int, text string")
    s = [(r["section"], r["page"], r["body"]) for r in K.split_sections(doc).orderBy("part_no").collect()]
    assert s == [("Untitled", "", "intro  more"), ("One", "3", "a b. c d e. f"), ("Two", "4", "g")]
    c = K.sentence_chunks(K.split_sections(doc), 3).where("part_no = 1").orderBy("chunk_no").collect()
    assert [r["text"] for r in c] == ["a b.", "c d e.", "f"]


def test_normalise_forms(spark):
    df = spark.createDataFrame([("ＤＫＡ​  risk—Now",), ("Plain  Text",)], "t string")
    assert [r["n"] for r in H.normalise(df, "t", "n").collect()] == ["dka risk-now", "plain text"]


def test_sub_queries(spark):
    rows = [("What is the first thing and what is the second thing?",), ("ketoacidosis and uti",), ("What causes the harm and which drugs is it linked to?",)]
    got = [r["sub_queries"] for r in H.sub_queries(spark.createDataFrame(rows, "text string")).collect()]
    assert got == [["what is the first thing", "what is the second thing?"], ["ketoacidosis and uti"], ["what causes the harm and which drugs is it linked to?"]]


def test_check_digit(spark):
    rows = [("2363",), ("2364",)]
    got = [r["ok"] for r in spark.createDataFrame(rows, "d string").select(S.verhoeff_ok(F.col("d")).alias("ok")).collect()]
    assert got == [True, False]


def test_fresh_sources_prefers_new_ones(spark):
    rows = [(1, 0, 1, "a", 10), (1, 0, 2, "b", 11), (1, 1, 1, "a", 12), (1, 1, 2, "c", 13), (1, 2, 1, "a", 10), (1, 2, 2, "a", 14)]
    df = spark.createDataFrame(rows, "unit_id int, question_no int, rank int, source string, pos int")
    assert [r["pos"] for r in H.fresh_sources(df, 3).orderBy("question_no").collect()] == [10, 13, 14]
