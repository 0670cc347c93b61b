"""Operational jobs over an event stream, each with the batch form it must equal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenhand.functions.ranking import exact_quantiles, global_rank
from evenhand.operators.effects import pick
from evenhand.operators.linear import LinearEffect
from evenhand.operators.rules import verdicts

FREE, LIMIT, LOCK, CAP = 3, 5, 900, 30


# Latency and fallback


def latency_summary(events: DataFrame, by: str, value: str, failed: Column, valid: Column) -> DataFrame:
    """(by, n, p50, p95, max, fallback_pct, valid_pct) with exact quantiles."""
    g = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"), (100 * F.avg(failed.cast("double"))).alias("fallback_pct"), (100 * F.avg(valid.cast("double"))).alias("valid_pct"))
    q = exact_quantiles(events, value, [0.5, 0.95], (by,)).groupBy(by).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95"))
    return g.join(q, by)


def latency_windows(events: DataFrame, ts: str, value: str, failed: Column, width: str = "1 day", late: str = "1 hour", k: int = 800) -> DataFrame:
    """(start, n, max_value, fallbacks, sketch) of tumbling windows, of a table or of a stream with a watermark.

    The sketch of a window's values can be merged with others; a rank read from it is off by about 2.3 / ``k`` ** 0.9 of the window
    (1 in 180 at 800) or less, 99 times in 100, and a window of fewer than ``k`` values is exact.
    """
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"), F.sum(failed.cast("bigint")).alias("fallbacks"),
                                                      F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))
    return g.select(F.col("w.start").alias("start"), "n", "max_value", "fallbacks", "sketch")


def longer_windows(windows: DataFrame, start: Column, k: int = 800) -> DataFrame:
    """Windows merged to longer ones that begin at ``start``: counts add up, sketches merge; the events aren't read again."""
    return windows.groupBy(start.alias("start")).agg(F.sum("n").alias("n"), F.max("max_value").alias("max_value"), F.sum("fallbacks").alias("fallbacks"),
                                                     F.kll_merge_agg_double("sketch", k).alias("sketch"))


def with_quantiles(windows: DataFrame) -> DataFrame:
    """p50, p95 and fallback_pct in the place of the sketch; null for windows without a value."""
    some = F.kll_sketch_get_n_double("sketch") > 0
    p50, p95 = (F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p))) for p in (0.5, 0.95))
    return windows.select("*", p50.alias("p50"), p95.alias("p95"), (100.0 * F.col("fallbacks") / F.col("n")).alias("fallback_pct")).drop("sketch")


# Failure throttle


def throttle_batch(events: DataFrame, key: str, order: str, failed: Column, success: Column) -> DataFrame:
    """(key, order, level, wait, locked) for every failure.

    Failures are numbered since the last success, five to a round. The running totals are exact prefix sums over order
    buckets, so a key with very many events is not folded in one task.
    """
    e = events.where(failed | success).select(key, order, failed.cast("bigint").alias("__fail"), success.cast("bigint").alias("__ok"))
    r = global_rank(e, order, order, "__n", by=(key,), sum_cols={"__fail": "__cf", "__ok": "__cs"})
    start = r.groupBy(key, "__cs").agg(F.min(F.col("__cf") - F.col("__fail")).alias("__base"))  # failures before this success-free stretch
    j = r.join(start, [key, "__cs"]).where(F.col("__fail") == 1)
    level = ((F.col("__cf") - F.col("__base") - 1) % LIMIT + 1).cast("int")
    return j.select(key, order, level.alias("level")).select("*", *_waits(F.col("level")))


def _waits(level: Column):
    wait = F.when(level >= LIMIT, LOCK).when(level >= FREE, F.least(F.pow(F.lit(2.0), level - FREE + 1), F.lit(float(CAP))).cast("int")).otherwise(0)
    return wait.cast("int").alias("wait"), (level >= LIMIT).alias("locked")


def throttle_stream(events: DataFrame, key: str, order: str, failed: Column, success: Column) -> DataFrame:
    """The streaming form: one small counter per key; the events of a batch are taken in order."""
    e = events.where(failed | success).select(F.col(key).cast("bigint").alias(key), F.col(order).cast("bigint").alias(order), failed.alias("is_failure"))

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0
        pdf = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, bad in zip(pdf[order], pdf["is_failure"]):
            level = (level % LIMIT) + 1 if bad else 0
            if bad:
                out.append((k[0], o, level))
        state.update((level,))
        yield pd.DataFrame(out, columns=[key, order, "level"])

    got = e.groupBy(key).applyInPandasWithState(step, f"{key} bigint, {order} bigint, level int", "level int", "append", "NoTimeout")
    return got.select("*", *_waits(F.col("level")))


class Throttle:
    """The throttle of one key in event time (microseconds): attempts during a wait or a lock are refused and not counted, a lock ends by itself,
    and failures are forgotten ``forget`` seconds after the last one (never, if None)."""

    def __init__(self, fails: int = 0, last: int = -1, until: int = -1, forget: int | None = None):
        self.fails, self.last, self.until, self.forget = fails, last, until, forget

    def attempt(self, at: int, failed: bool) -> tuple[str, int, int]:
        """(outcome, failures so far, seconds until the next try)."""
        stale = self.forget is not None and self.last >= 0 and self.until < 0 and at - self.last >= self.forget * 1_000_000
        if 0 <= self.until <= at or stale:
            self.fails, self.last, self.until = 0, -1, -1
        delay = 0 if self.fails < FREE else min(2 ** (self.fails - FREE + 1), CAP)
        ready = self.until if self.until >= 0 else self.last + delay * 1_000_000 if self.last >= 0 else -1
        if at < ready:
            return "refused", self.fails, (ready - at) // 1_000_000 + 1
        if not failed:
            self.fails, self.last, self.until = 0, -1, -1
            return "ok", 0, 0
        self.fails, self.last = self.fails + 1, at
        if self.fails >= LIMIT:
            self.until = at + LOCK * 1_000_000
            return "locked", self.fails, LOCK
        return "failed", self.fails, 0 if self.fails < FREE else min(2 ** (self.fails - FREE + 1), CAP)


TIMELINE = "outcome string, level int, wait int"


def _attempts(events: DataFrame, key: str, order: str, ts: str, failed: Column, success: Column) -> DataFrame:
    return events.where(failed | success).select(F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("seq"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), failed.alias("bad"))


def throttle_in_time(events: DataFrame, key: str, order: str, ts: str, failed: Column, success: Column, forget: int | None = None) -> DataFrame:
    """(key, order, outcome, level, wait) of every attempt. Attempts of a key pass in order of time through one small state; none are gathered."""

    def run(batches):
        own, state = None, Throttle(forget=forget)
        for b in batches:
            out = []
            for k, at, bad in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), b.column("bad").to_pylist(), strict=True):
                if k != own:
                    own, state = k, Throttle(forget=forget)
                out.append(state.attempt(at, bad))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("seq"), pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=["key", "seq", "outcome", "level", "wait"])

    e = _attempts(events, key, order, ts, failed, success).where("key is not null")
    got = e.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(run, f"key bigint, seq bigint, {TIMELINE}")
    return got.withColumnsRenamed({"key": key, "seq": order})


def throttle_in_time_stream(events: DataFrame, key: str, order: str, ts: str, failed: Column, success: Column, late: str = "1 hour", forget: int | None = None) -> DataFrame:
    """The streaming form: state of three numbers per key. It goes at a success, and when the watermark has passed the end of a lock or the time
    after which failures are forgotten; without ``forget``, one to four failures stay. What a micro-batch brings of a key is taken in order of time."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    e = e.where(failed | success).select("__ts", F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("seq"), F.unix_micros("__ts").alias("at"), failed.alias("bad"))

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Throttle(*(state.get if state.exists else ()), forget=forget)
        rows = sorted(r for f in frames for r in zip(f["at"].tolist(), f["seq"].tolist(), f["bad"].tolist(), strict=True))
        out = [(k[0], seq, *own.attempt(at, bad)) for at, seq, bad in rows]
        end = own.until if own.until >= 0 else own.last + forget * 1_000_000 if forget is not None else -1
        if own.fails:
            state.update((own.fails, own.last, own.until))
        elif state.exists:
            state.remove()
        if own.fails and end >= 0:
            state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "seq", "outcome", "level", "wait"])

    got = e.groupBy("key").applyInPandasWithState(step, f"key bigint, seq bigint, {TIMELINE}", "fails int, last bigint, until bigint", "append", "EventTimeTimeout")
    return got.withColumnsRenamed({"key": key, "seq": order})


# Sliding-window block


def sliding_failures(events: DataFrame, key: str, seconds: str, failed: Column, span: int = 900, limit: int = 50) -> DataFrame:
    """Adds recent (failures of the key less than ``span`` whole seconds ago, this one included) and blocked to failures.

    A row joins its own time slice and, as history, the next one; slices of one key are counted apart.
    """
    e = events.where(failed).withColumn("__home", F.floor(F.col(seconds) / span))
    e = e.withColumn("__slice", F.explode(F.array(F.col("__home"), F.col("__home") + 1)))
    w = W.partitionBy(key, "__slice").orderBy(seconds).rangeBetween(1 - span, 0)
    r = e.withColumn("recent", F.count(F.lit(1)).over(w)).where(F.col("__home") == F.col("__slice"))
    return r.withColumn("blocked", F.col("recent") >= limit).drop("__home", "__slice")


class Address:
    """Recent failures of one address (fewer than ``limit`` times) and the end of its block, in microseconds. A block lasts ``span`` seconds whatever
    comes in it; what does is refused and not counted, and the count begins anew with the block."""

    def __init__(self, recent: list[int] | None = None, until: int = -1):
        self.recent, self.until = recent or [], until

    def fail(self, at: int, span: int, limit: int) -> tuple[str, int]:
        """Outcome and number of recent failures, this one included."""
        if at < self.until:
            return "refused", 0
        self.recent = [t for t in self.recent if at - t < span * 1_000_000] + [at]
        n = len(self.recent)
        if n < limit:
            return "counted", n
        self.recent, self.until = [], at + span * 1_000_000
        return "blocked", n


def address_block(events: DataFrame, key: str, order: str, ts: str, failed: Column, span: int = 900, limit: int = 50) -> DataFrame:
    """(key, order, outcome, recent) of every failure: an address with ``limit`` failures within ``span`` seconds is blocked for ``span`` seconds. Failures pass in order of time through a state of bounded size."""

    def run(batches):
        own, state = None, Address()
        for b in batches:
            out = []
            for k, at in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), strict=True):
                if k != own:
                    own, state = k, Address()
                out.append(state.fail(at, span, limit))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("seq"), pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int32())], names=["key", "seq", "outcome", "recent"])

    e = _attempts(events, key, order, ts, failed, F.lit(False)).where("key is not null and at is not null")
    got = e.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(run, "key bigint, seq bigint, outcome string, recent int")
    return got.withColumnsRenamed({"key": key, "seq": order})


def address_block_stream(events: DataFrame, key: str, order: str, ts: str, failed: Column, span: int = 900, limit: int = 50, late: str = "1 hour") -> DataFrame:
    """The streaming form. An address's state ends with its block, or ``span`` seconds after its last failure, once the watermark has passed that."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    e = e.where(failed).select("__ts", F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("seq"), F.unix_micros("__ts").alias("at")).where("key is not null")

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, until = state.get if state.exists else ("", -1)
        own = Address([int(t) for t in recent.split()], until)
        rows = sorted(r for f in frames for r in zip(f["at"].tolist(), f["seq"].tolist(), strict=True))
        out = [(k[0], seq, *own.fail(at, span, limit)) for at, seq in rows]
        state.update((" ".join(map(str, own.recent)), own.until))
        end = max([own.until, *(t + span * 1_000_000 for t in own.recent[-1:])])
        state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "seq", "outcome", "recent"])

    got = e.groupBy("key").applyInPandasWithState(step, "key bigint, seq bigint, outcome string, recent int", "recent string, until bigint", "append", "EventTimeTimeout")
    return got.withColumnsRenamed({"key": key, "seq": order})


# Audit and scoring


def audit_lines(events: DataFrame, request: str, ts: str, fields, decision: Column, rules: Column, engine: str) -> DataFrame:
    """One line per request: identifiers, versions, names of fields present, status and rule ids; never a value."""
    present = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
    lines = events.select(F.col(request).alias("request_id"), F.col(ts).cast("timestamp").alias("time"), F.lit(engine).alias("engine"), present.alias("fields_received"), decision.alias("status"), rules.alias("rules"))
    if lines.isStreaming:
        return lines.withWatermark("time", "1 day").dropDuplicatesWithinWatermark(["request_id"])
    return lines.dropDuplicates(["request_id"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop; the checkpoint makes a restart continue where it was."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def score_units(units: DataFrame, model: LinearEffect, rules, arms) -> DataFrame:
    """(unit_id, arm, status, value, se): the rules' verdict for every unit and arm, and the model's effect where no rule excludes it."""
    wide = [f"{c}_{a}" for a in arms for c in ("value", "se")]
    v = verdicts(model.score_wide(units, only=set(arms)), rules, arms, extra=wide)
    given = F.col("status") != "excluded"
    return v.select("unit_id", "arm", "status", *[F.when(given, pick(c, F.col("arm"), arms)).alias(c) for c in ("value", "se")])


def score_stream(units: DataFrame, models: str, rules, arms, path: str, checkpoint: str) -> None:
    """Score what has come of a stream of units, each micro-batch by the newest model published at ``models`` when it begins.

    Rows carry the model's version. A micro-batch that is run again replaces its own folder, so no unit is scored twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        version, model = LinearEffect.published(batch.sparkSession, models)
        score_units(batch, model, rules, arms).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    units.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
