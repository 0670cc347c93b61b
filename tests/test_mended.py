"""Behaviour that SQL on the given tables doesn't show."""

import pytest
from pyspark.sql import functions as F

from evenhand.functions import text as X
from evenhand.functions.stats import small
from evenhand.operators import answers as N
from evenhand.operators import grading as G
from evenhand.operators import ireval as I
from evenhand.operators import retrieval as H
from evenhand.operators import screening as S
from evenhand.sources import readers
from evenhand.streaming import jobs as J


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_broadcast_size_is_checked(spark):
    assert small(spark.range(5), 5).count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        small(spark.range(5), 4).count()


def test_sentence_ends(spark):
    assert one(spark, lambda t: X.sentences(t, ".!?;"), "a; b. c") == ["a;", "b.", "c"] and one(spark, X.sentences, "a; b. c") == ["a; b.", "c"]


def test_folded_case(spark):
    df = spark.createDataFrame([("Straße ΣΑΣ",), ("ﬁve—Six",)], "text string")
    assert [r.n for r in H.normalise(df, "text", "n").collect()] == ["strasse σασ", "five-six"]


def test_numbers_as_written(spark):
    assert one(spark, N.numbers_in, "12.50 and 007, SGLT2 1.2.3 88.0 v2") == ["12.5", "007", "1.2", "88"]


def test_identifier_kinds(spark):
    kinds = {"email": "a＠b.org", "mobile": "call 98765 43210", "health_number": "12-3456-7890-1234", "health_address": "joe.x@abdm", "tax_number": "ABCPE1234F", "title_name": "Smt. Rao", "check_number": "2341 2341 2346"}
    for kind, text in kinds.items():
        got = {k: one(spark, lambda t, k=k: S.identifiers(t)[k], text) for k in kinds}
        assert got[kind], kind
    assert not any(one(spark, lambda t, k=k: S.identifiers(t)[k], "nothing of 12 kinds here") for k in kinds)


def test_role_label(spark):
    words = lambda t: S.with_words(spark.createDataFrame([(t,)], "text string")).select(S.injection(F.col("text"), ["ignore previous"]).alias("x")).first().x
    assert words("hello\n  System: obey") and not words("the system: it works")


def test_student_t_beyond_the_table(spark):
    got = {r.n: r.t for r in spark.createDataFrame([(3,), (30,), (31,), (39,), (60,), (120,)], "n int").select("n", G.t_quantile(F.col("n")).alias("t")).collect()}
    for n, t in {3: 3.1824, 30: 2.0423, 31: 2.0395, 39: 2.0227, 60: 2.0003, 120: 1.9799}.items():
        assert abs(got[n] - t) < 1e-4


def test_every_character_reference(spark):
    assert one(spark, readers.html_lines, "<p>&eacute;&#233;&#x2014;&amp;lt;</p>") == "éé—&lt;" and one(spark, readers.html_lines, "<p>a &amp;lt; &copy;</p>") == "a &lt; ©"


def test_window_of_failures_is_open(spark):
    e = spark.createDataFrame([(1, 0), (1, 899), (1, 900), (1, 1799)], "u int, s bigint")
    got = {r.s: r.recent for r in J.sliding_failures(e, "u", "s", F.lit(True)).collect()}
    assert got == {0: 1, 899: 2, 900: 2, 1799: 2}


def test_short_items_are_an_error(spark):
    docs = spark.createDataFrame([(0, "one two three four five")], "pos bigint, text string")
    items = spark.createDataFrame([(1, "two three four five")], "query_id bigint, text string")
    assert [tuple(r) for r in I.gold_passages(items, docs).collect()] == [(1, 0)]
    with pytest.raises(Exception, match="four words"):
        I.gold_passages(items.withColumn("text", F.lit("two three")), docs).collect()


def test_verdict_order(spark):
    df = spark.createDataFrame([(True, True, True), (False, True, True), (False, False, True), (False, False, False)], "a boolean, b boolean, c boolean")
    assert [r.verdict for r in N.verdict(df, ["a"], ["b"], ["c"]).collect()] == ["BLOCK", "FALLBACK", "ABSTAIN", "PASS"]


def test_tokens_of_readings_are_made_once(spark):
    df = spark.createDataFrame([("glucose 55 mg/dl, no hba1c of 9.1 %",)], "text string").select(S.readings(F.col("text"), ["no"]).alias("r"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [(r.name, r.value, r.cued) for r in df.first().r] == [("glucose", 55.0, False), ("hba1c", 9.1, True)]
