"""Steps that many queries share: what they move, and that their results are those of the plain definition."""

import hashlib
import random

from pyspark.sql import functions as F

from evenhand.functions.ranking import hash_threshold
from evenhand.operators import effects as E
from evenhand.operators import retrieval as H
from evenhand.operators import search as S
from evenhand.plans import grading_queries as GQ
from evenhand.sources import readers as R
from evenhand.sources import tables as T


def shuffled_by(df):
    """What each exchange of the plan deals rows by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_ngram_postings_stay_in_their_part(spark):
    rng = random.Random(5)
    p = spark.createDataFrame([(i, " ".join(rng.choices([f"w{k}" for k in range(40)], k=rng.randrange(0, 30)))) for i in range(300)], "pos bigint, text string")
    index, terms = H.tfidf_index(p)
    assert all(by.startswith(("part", "term")) for by in shuffled_by(index))
    assert not any("pos" in by for by in shuffled_by(index))
    df = {r["term"]: r["df"] for r in terms.collect()}
    plain = H.X.uni_and_bigrams(F.col("text"))
    want = {r["term"]: r["df"] for r in p.select("pos", F.explode(plain).alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    assert df == want
    length = index.groupBy("pos").agg(F.sum(F.col("weight") * F.col("weight")).alias("x")).agg(F.min("x"), F.max("x")).first()
    assert abs(length[0] - 1) < 1e-9 and abs(length[1] - 1) < 1e-9


def test_terms_of_questions_need_no_index(spark):
    p = spark.createDataFrame([(0, "red green blue"), (1, "red red green"), (2, "blue sky")], "pos bigint, text string")
    q = spark.createDataFrame([(0, "red green"), (1, "unknown blue")], "query_id bigint, text string")
    got = {r["term"]: r["df"] for r in H.tfidf_terms(p, q).collect()}
    assert got == {"red": 2, "green": 2, "red green": 2, "blue": 2}
    assert [r["word"] for r in H.unknown_words(q, H.tfidf_terms(p, q)).collect()] == ["unknown"]


def test_copies_of_dealt_units_are_not_moved(spark):
    units = spark.range(3_000).select(F.col("id").alias("unit_id"), (F.col("id") % 4).cast("int").alias("cell"))
    copies = lambda u: u.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn(
        "arm", F.element_at(F.array(*[F.lit(a) for a in "ABC"]), (F.pmod(F.xxhash64("unit_id", "rep"), F.lit(3)) + 1).cast("int")))
    placed = E.add_folds(copies(E.dealt(units, 3_000, rows=500)), by=("rep",))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    plain = E.add_folds(copies(units), by=("rep",))
    key = ["unit_id", "rep", "arm", "fold"]
    assert placed.select(key).exceptAll(plain.select(key)).count() == 0 and placed.count() == 9_000


def test_thresholds_move_only_the_wanted_bucket(spark):
    df = spark.range(5_000).select(F.lit(1).alias("rep"), F.md5(F.col("id").cast("string")).alias("key"))
    want = spark.createDataFrame([(1, 1), (1, 2_500), (1, 5_000)], "rep int, k int")
    got = hash_threshold(df, "key", want, by=("rep",))
    assert "SortMergeJoin [rep" not in got._jdf.queryExecution().executedPlan().toString()
    keys = sorted(r["key"] for r in df.collect())
    assert {r["k"]: r["threshold"] for r in got.collect()} == {k: keys[k - 1] for k in (1, 2_500, 5_000)}


def test_references_without_an_end_stay(spark):
    html = "<h1>a</h1><p>x &amp y &copy; &eacute; &#65; &#66 &amp;lt; &amp</p>"
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    assert df.select(R.html_lines(F.col("html"))).first()[0].split("\n")[-1] == "x &amp y © é A &#66 &lt; &amp"


def test_pairs_of_question_and_passage_are_summed_in_their_part(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)] + ["é1", "ñ2"], k=rng.randrange(0, 9)))) for i in range(250)]
    p = spark.createDataFrame(texts, "pos bigint, text string")
    q = spark.createDataFrame([(0, "w1 w2 é1"), (1, "w3 ñ2"), (2, "none")], "query_id bigint, text string")
    plan = S.Plan.plain(q)
    index = S.build(p, plan)
    s = S.scored(index.impacts, H.materialise(S.weights(plan, index), "weights"))
    assert "Exchange hashpartitioning(" not in s._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    bm, vec = H.bm25(p, q).collect(), H.ngram_scores(p, q).collect()
    for r in H.hybrid(p, q, keep=False).groupBy("query_id").agg(F.collect_list(F.struct("pos", "rank_bm25", "rank_vector")).alias("x")).collect():
        for scores, at in ((bm, 1), (vec, 2)):
            own = {t["pos"]: t["score"] for t in scores if t["query_id"] == r["query_id"]}
            place = {pos: i + 1 for i, pos in enumerate(sorted(range(250), key=lambda k: (-own.get(k, 0.0), k)))}
            assert all(place[x[0]] == x[at] for x in r["x"])


def operators_above_kept(df):
    """Names of the plan's operators, without those below a kept table."""
    todo, names = [df._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        names.append(node.nodeName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return names


def test_folds_are_placed_once(spark, sf):
    folded = E.add_folds(T.planted(spark, sf))
    names = operators_above_kept(folded)
    assert "InMemoryRelation" in names and not {"Window", "Repartition", "RepartitionByExpression", "Aggregate"} & set(names)
    scored = operators_above_kept(E.scored_cohort(T.planted(spark, sf)))
    assert "Window" not in scored
    got = sorted((r.arm, hashlib.md5(f"{r.unit_id}:fold".encode()).hexdigest(), r.fold) for r in folded.select("arm", "unit_id", "fold").collect())
    for arm in "ABC":
        assert [f for a, _, f in got if a == arm] == [i % 5 for i in range(sum(a == arm for a, *_ in got))]


def test_kept_tables_do_not_carry_their_plans_on(spark, sf):
    size = lambda df: len(df._jdf.queryExecution().toString())
    folded = size(E.add_folds(T.planted(spark, sf)))
    scored, lev = E.scored_cohort(T.planted(spark, sf)), GQ.levels(spark, sf)
    assert size(scored) < 3 * folded and size(lev) < 6 * folded


def test_benchmark_summary_keeps_no_replicate_rows(spark, sf):
    df = GQ.e08(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "conv(" not in plan  # no copies of units are kept or drawn again
    assert {r.n_reps for r in df.collect()} == {GQ.REPS}
