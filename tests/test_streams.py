import uuid

from pyspark.sql import functions as F

from evenhand.operators import diffs as D
from evenhand.plans.catalog import ORACLES, QUERIES
from evenhand.session import shared_dir
from evenhand.sources import tables as T
from evenhand.streaming import jobs as J


def test_throttle_stream_equals_batch(spark, sf):
    bad, good = F.col("event_type") == "error", F.col("event_type") == "purchase"
    batch = J.throttle_batch(T.table(spark, sf, "events"), "user_id", "event_id", bad, good)
    stream = spark.readStream.schema(T.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = shared_dir(spark, f"throttle_{uuid.uuid4().hex[:8]}")
    J.run_to_table(J.throttle_stream(stream, "user_id", "event_id", bad, good), f"{root}/out", f"{root}/state")
    got = spark.read.parquet(f"{root}/out")
    assert D.table_diff(batch, got, ["user_id", "event_id"]).count() == 0 and got.count() > 0


def test_throttle_in_time_stream_equals_batch(spark, sf):
    args = ("user_id", "event_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase")
    batch = J.throttle_in_time(T.table(spark, sf, "events"), *args)
    stream = spark.readStream.schema(T.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = shared_dir(spark, f"throttle_{uuid.uuid4().hex[:8]}")
    J.run_to_table(J.throttle_in_time_stream(stream, *args), f"{root}/out", f"{root}/state")
    got = spark.read.parquet(f"{root}/out")
    assert D.table_diff(batch, got, ["user_id", "event_id"]).count() == 0 and got.count() == batch.count() > 0


def test_throttle_waits_locks_and_expiry():
    t, s = J.Throttle(), 1_000_000
    assert [t.attempt(i * s, True)[0] for i in range(3)] == ["failed"] * 3
    assert t.attempt(3 * s, True) == ("refused", 3, 2) and t.attempt(4 * s, True) == ("failed", 4, 4)
    assert t.attempt(7 * s, False)[0] == "refused" and t.attempt(8 * s, True) == ("locked", 5, 900)
    assert t.attempt(907 * s, False)[0] == "refused" and t.attempt(908 * s, True) == ("failed", 1, 0) and t.attempt(909 * s, False) == ("ok", 0, 0)


def test_address_block_stream_equals_batch(spark, sf):
    args = ("user_id", "event_id", "ts", F.col("event_type") == "error", 86_400, 2)
    batch = J.address_block(T.table(spark, sf, "events"), *args)
    stream = spark.readStream.schema(T.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = shared_dir(spark, f"block_{uuid.uuid4().hex[:8]}")
    J.run_to_table(J.address_block_stream(stream, *args), f"{root}/out", f"{root}/state")
    got = spark.read.parquet(f"{root}/out")
    assert D.table_diff(batch, got, ["user_id", "event_id"]).count() == 0 and got.count() == batch.count() > 0
    assert {r["outcome"] for r in got.select("outcome").distinct().collect()} >= {"counted", "blocked"}


def test_address_is_blocked_for_its_time_and_counts_anew():
    a, s = J.Address(), 1_000_000
    assert [a.fail(i * s, 900, 3) for i in (0, 1, 2)] == [("counted", 1), ("counted", 2), ("blocked", 3)]
    assert a.fail(901 * s, 900, 3) == ("refused", 0) and a.fail(902 * s, 900, 3) == ("counted", 1)
    assert a.fail(1802 * s, 900, 3) == ("counted", 1) and len(a.recent) == 1


def test_throttle_forgets_stream_equals_batch(spark, sf):
    args = ("user_id", "event_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase")
    batch = J.throttle_in_time(T.table(spark, sf, "events"), *args, forget=86_400)
    stream = spark.readStream.schema(T.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = shared_dir(spark, f"throttle_{uuid.uuid4().hex[:8]}")
    J.run_to_table(J.throttle_in_time_stream(stream, *args, forget=86_400), f"{root}/out", f"{root}/state")
    got = spark.read.parquet(f"{root}/out")
    assert D.table_diff(batch, got, ["user_id", "event_id"]).count() == 0 and got.count() == batch.count() > 0
    assert D.table_diff(batch, J.throttle_in_time(T.table(spark, sf, "events"), *args), ["user_id", "event_id"]).count() > 0


def test_failures_are_forgotten_after_their_time():
    t, s = J.Throttle(forget=60), 1_000_000
    assert [t.attempt(i * s, True) for i in (0, 59, 119, 178)] == [("failed", 1, 0), ("failed", 2, 0), ("failed", 1, 0), ("failed", 2, 0)]
    locked = J.Throttle(5, 0, 900 * s, forget=60)
    assert locked.attempt(100 * s, True)[0] == "refused"  # a lock outlasts the time after which failures are forgotten


def test_windows_of_a_stream_equal_those_of_a_table_and_merge(spark, sf):
    from pyspark.sql import Row

    events, failed = T.table(spark, sf, "events"), F.col("event_type") == "error"
    batch = J.latency_windows(events, "ts", "value", failed)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = shared_dir(spark, f"windows_{uuid.uuid4().hex[:8]}")
    J.run_to_table(J.latency_windows(stream, "ts", "value", failed), f"{root}/out", f"{root}/state")
    whole = {r["start"]: r for r in J.with_quantiles(batch).collect()}
    got = J.with_quantiles(spark.read.parquet(f"{root}/out")).collect()
    assert len(whole) - 2 <= len(got) <= len(whole) and all(r == whole[r["start"]] for r in got)  # windows under 800 values are exact
    month = J.with_quantiles(J.longer_windows(batch, F.lit("all"))).first()
    values = sorted(r[0] for r in events.where("value is not null").select("value").collect())
    for q, p in ((month["p50"], 0.5), (month["p95"], 0.95)):
        assert sum(v < q for v in values) <= (p + 0.02) * len(values) and sum(v <= q for v in values) >= (p - 0.02) * len(values)
    assert month["n"] == events.count()
    none = spark.createDataFrame([Row(ts="2024-01-01 00:00:00", value=None, event_type="error")], "ts string, value double, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert J.with_quantiles(J.latency_windows(none, "ts", "value", failed)).first().asDict() | {"start": 0} == {"start": 0, "n": 1, "max_value": None, "fallbacks": 1, "p50": None, "p95": None, "fallback_pct": 100.0}


def test_each_micro_batch_is_scored_by_the_newest_model(spark):
    import numpy as np

    from evenhand.operators.linear import LinearEffect

    one = LinearEffect(["x"], ["A", "B"], np.array([1.0]), np.array([2.0]), np.array([[1.0, 2.0], [3.0, 4.0]]), np.array([np.eye(2), 2 * np.eye(2)]))
    two = LinearEffect(["x"], ["A", "B"], np.array([0.0]), np.array([1.0]), np.array([[5.0, 6.0], [7.0, 8.0]]), np.array([np.eye(2), np.eye(2)]))
    root = shared_dir(spark, f"models_{uuid.uuid4().hex[:8]}")
    for n, model in ((1, one), (2, two)):
        model.publish(spark, f"{root}/models", n)
        units = spark.createDataFrame([(10 * n, 3.0), (10 * n + 1, 9.0)], "unit_id long, x double")
        units.write.mode("append").parquet(f"{root}/in")
        J.score_stream(spark.readStream.schema(units.schema).parquet(f"{root}/in"), f"{root}/models", [], ("A", "B"), f"{root}/out", f"{root}/state")
        got = spark.read.parquet(f"{root}/out").drop("batch").where(F.col("version") == n)
        want = J.score_units(units, model, [], ("A", "B")).withColumn("version", F.lit(n))
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    version, back = LinearEffect.published(spark, f"{root}/models")
    assert version == 2 and back.covariates == ["x"] and back.targets == ["A", "B"] and np.array_equal(back.beta, two.beta) and np.array_equal(back.cov, two.cov)
    assert LinearEffect.published(spark, f"{root}/models", 1)[1].value(1)._jc.toString() == one.value(1)._jc.toString()
    two.publish(spark, f"{root}/models", 2)  # once more: no row twice
    assert LinearEffect.published(spark, f"{root}/models")[1].beta.shape == (2, 2)


def test_audit_stream_equals_batch(spark, sf):
    def audit(e):
        return J.audit_lines(e, "event_id", "ts", ["user_id"], F.lit("estimate"), F.array().cast("array<string>"), "0.1")

    stream = spark.readStream.schema(T.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = shared_dir(spark, f"audit_{uuid.uuid4().hex[:8]}")
    J.run_to_table(audit(stream), f"{root}/out", f"{root}/state")
    assert spark.read.parquet(f"{root}/out").count() == audit(T.table(spark, sf, "events")).count()


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 18
