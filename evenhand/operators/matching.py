"""Exact nearest-neighbour matching on a vector of log propensities, with bootstrap intervals, spread over boxes of donors.

For each arm the space is cut into boxes of about equal numbers of donor vectors, as many as their number asks for. A pass over the distinct vectors finds how
far each has to look, so that a box's units need the donors of a few boxes around it only; with those beside them the answer is exact whatever the cuts.

A bootstrap replicate gives every unit a Poisson(1) count and donors are those counted at least once. The donors of a vector are ordered once, by distance and id; a replicate
takes the first one that it counts. Replicate 0 counts every unit once: the point estimate. So all replicates are one search: counts travel as an array
with the unit, and a task returns sums per replicate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenhand import config as cfg
from evenhand.functions.ranking import value_bucket
from evenhand.functions.stats import union_all
from evenhand.operators.effects import arms_to_targets, with_interval
from evenhand.session import materialise

LEAF = 512  # donor vectors of a box
UNITS = 8192  # units of a box that go into one task
FIRST = 16  # donors of one vector that are looked at before more are fetched
NEAR = 16  # donor vectors ordered at first
TOGETHER = 64


class Boxes:
    """Boxes that tile the plane of two coordinates: strips by quantiles of the first, each cut by quantiles of the second."""

    def __init__(self, axes: tuple[int, int], first: list[float], second: list[list[float]]):
        self.axes, self.first, self.second = axes, np.array(first, float), [np.array(s, float) for s in second]
        self.offset = np.r_[0, np.cumsum([len(s) + 1 for s in second])]

    @classmethod
    def over(cls, vectors: DataFrame, dims: list[str], leaf: int) -> Boxes:
        """Boxes of about ``leaf`` of the vectors; the driver holds one number a box."""
        spread = vectors.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(d).alias(d) for d in dims]).first()
        axes = tuple(sorted(range(len(dims)), key=lambda i: (-(spread[dims[i]] or 0.0), i))[:2])
        axes = axes if len(axes) == 2 else (0, 0)
        strips = max(1, round((spread["n"] / leaf) ** 0.5))
        x, y = dims[axes[0]], dims[axes[1]]
        probs = [i / strips for i in range(1, strips)]
        edges = sorted(set(vectors.approxQuantile(x, probs, 1 / (8 * strips)))) if probs else []
        if not probs:
            return cls(axes, [], [[]])
        cut = value_bucket(vectors, x, edges, "__strip").groupBy("__strip").agg(F.percentile_approx(y, probs, 8 * strips).alias("e"))
        rows = {r["__strip"]: sorted(set(r["e"])) for r in cut.collect()}
        return cls(axes, edges, [rows.get(i, []) for i in range(len(edges) + 1)])

    def home(self, points: np.ndarray) -> np.ndarray:
        """Box number of every point."""
        strip = np.searchsorted(self.first, points[:, self.axes[0]], side="right")
        out = np.zeros(len(points), np.int64)
        for s in np.unique(strip):
            own = strip == s
            out[own] = self.offset[s] + np.searchsorted(self.second[s], points[own, self.axes[1]], side="right")
        return out

    def within(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, box) for every box that a point's radius reaches."""
        radius = radius * (1 + 1e-12) + 1e-300
        x, y = points[:, self.axes[0]], points[:, self.axes[1]]
        low, high = (np.searchsorted(self.first, x + d, side="right") for d in (-radius, radius))
        row, strip = _spans(low, high)
        rows, boxes = [], []
        for s in np.unique(strip):
            own = row[strip == s]
            low, high = (np.searchsorted(self.second[s], y[own] + d * radius[own], side="right") for d in (-1, 1))
            at, box = _spans(low, high)
            rows.append(own[at])
            boxes.append(self.offset[s] + box)
        return (np.concatenate(rows), np.concatenate(boxes)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every value from low to high of each row."""
    n = high - low + 1
    row = np.repeat(np.arange(len(low)), n)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


class Donors:
    """Donor vectors with, for each replicate, the first unit that it counts there: id (or none) and outcome."""

    def __init__(self, frame: pd.DataFrame, dims: list[str], replicates: int):
        self.at = frame[dims].to_numpy(float)
        n = len(frame)
        self.ids, self.y = np.full((n, replicates), np.iinfo(np.int64).max), np.zeros((n, replicates))
        lists = list(frame["units"])
        for rank in range(max((len(u) for u in lists), default=0) - 1, -1, -1):  # from the last to the first of each
            own = [i for i, u in enumerate(lists) if len(u) > rank]
            counted = np.array([lists[i][rank]["w"] for i in own], dtype=np.int8).reshape(len(own), replicates) > 0
            ids, y = np.array([lists[i][rank]["unit_id"] for i in own]), np.array([lists[i][rank]["y"] for i in own], float)
            self.ids[own] = np.where(counted, ids[:, None], self.ids[own])
            self.y[own] = np.where(counted, y[:, None], self.y[own])
        self.some = self.ids < np.iinfo(np.int64).max

    def search(self, points: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """(squared distance, outcome) of the nearest counted donor of each point and replicate, lowest id first; infinite where there is none."""
        replicates = self.some.shape[1]
        best, out = np.full((len(points), replicates), np.inf), np.full((len(points), replicates), np.nan)
        if not len(self.at):
            return best, out
        for s in range(0, len(points), TOGETHER):
            q = points[s : s + TOGETHER]
            dist = np.zeros((len(q), len(self.at)))
            for k in range(q.shape[1]):
                diff = q[:, k, None] - self.at[None, :, k]
                dist += diff * diff
            todo, t = np.arange(len(q)), min(near, len(self.at))
            while len(todo):
                order = np.argpartition(dist[todo], t - 1, axis=1)[:, :t] if t < len(self.at) else np.tile(np.arange(len(self.at)), (len(todo), 1))
                d = np.take_along_axis(dist[todo], order, axis=1)
                reach = np.where(self.some[order], d[:, :, None], np.inf)
                least = reach.min(axis=1)
                ids = np.where(reach == least[:, None, :], self.ids[order], np.iinfo(np.int64).max)
                pick = ids.argmin(axis=1)
                got = np.take_along_axis(self.y[order], pick[:, None, :], axis=1)[:, 0, :]
                # a donor left out is at least as far as the farthest one ordered
                done = np.ones(len(todo), bool) if t == len(self.at) else (least < d.max(axis=1)[:, None]).all(axis=1)
                best[s + todo[done]], out[s + todo[done]] = least[done], np.where(np.isfinite(least[done]), got[done], np.nan)
                todo, t = todo[~done], min(4 * t, len(self.at))
        return best, out


def counts(replicates: int, salt: str = "match"):
    """ARRAY<TINYINT>: 1 for replicate 0, then Poisson(1) counts by inverse distribution function."""
    bounds, p, total = [], 2.718281828459045**-1, 0.0
    for k in range(12):
        total += p
        bounds.append(total)
        p /= k + 1
    one = F.array(F.lit(1).cast("tinyint"))
    if not replicates:
        return one
    draws = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col("unit_id"), r), 11) / F.lit(float(1 << 53)))
    table = F.array(*[F.lit(b) for b in bounds])
    return F.concat(one, F.transform(draws, lambda u: F.size(F.filter(table, lambda b: b <= u)).cast("tinyint")))


def donor_lists(units: DataFrame, dims: list[str], first: int) -> DataFrame:
    """(dims, units): for each vector its first donors by id, as many as it takes until every replicate counts one of them or all are there."""
    def lists(rows: DataFrame, n: int) -> DataFrame:
        place = rows.withColumn("__p", F.row_number().over(W.partitionBy(*dims).orderBy("unit_id"))).where(F.col("__p") <= n)
        return place.groupBy(*dims).agg(F.array_sort(F.collect_list(F.struct("unit_id", "y", "w"))).alias("units"))

    covered = F.forall(F.aggregate(F.slice("units", 2, 1_000_000), F.transform(F.get(F.col("units"), F.lit(0))["w"], lambda x: x > 0), lambda a, u: F.zip_with(a, u["w"], lambda b, x: b | (x > 0))), lambda b: b)
    parts, rows, n = [], units, first
    while True:
        got = materialise(lists(rows, n), "donors")
        open_ = (F.size("units") == n) & ~covered
        parts.append(got.where(~open_))
        left = got.where(open_).select(*dims)
        if left.isEmpty():
            return union_all(parts)
        rows, n = rows.join(left, dims, "left_semi"), 8 * n


def matched_sums(units: DataFrame, donors: DataFrame, dims: list[str], replicates: int, leaf: int = LEAF) -> DataFrame:
    """(rep, s): the counted sum over units (dims, w) of the outcome of their nearest donor. donors as from ``donor_lists``."""
    boxes = Boxes.over(donors.select(*dims), dims, leaf)

    def tag(batches):
        for pdf in batches:
            pdf["box"] = boxes.home(pdf[dims].to_numpy(float))
            yield pdf

    def tagged(df):
        return df.mapInPandas(tag, ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, ("box", "bigint")]))

    d = materialise(tagged(donors), "donor_boxes")
    all_ = materialise(tagged(units), "unit_boxes")
    vectors = all_.select(*dims, "box").distinct()

    def reach(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The boxes that the vectors of one box have to look into."""
        if not len(left):
            return pd.DataFrame({"box": [], "other": []})
        points = left[dims].to_numpy(float)
        far = np.sqrt(Donors(right, dims, replicates).search(points)[0].max(axis=1))
        other = np.unique(boxes.within(points, far)[1])
        return pd.DataFrame({"box": int(left["box"].iloc[0]), "other": other})

    def parted(df, n):  # a box's rows in as many parts as they need
        return df.withColumn("__p", F.pmod(F.xxhash64(*[c for c in df.columns if c != "w"]), n).cast("int"))

    sizes = materialise(all_.groupBy("box").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / UNITS).cast("int")), "box_sizes")
    q = parted(vectors.join(sizes.select("box", "parts"), "box"), F.col("parts")).select(*dims, "box", "__p")
    sent = d.join(sizes.select("box", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("__p")), "box")
    look = q.groupBy("box", "__p").cogroup(sent.groupBy("box", "__p")).applyInPandas(reach, "box bigint, other bigint").distinct()
    look = materialise(look, "reach")

    u = parted(all_.join(sizes.select("box", "parts"), "box").withColumn("__id", F.monotonically_increasing_id()), F.col("parts")).select(*dims, "w", "box", "__p")
    goal = look.join(sizes.select("box", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("__p")), "box")
    sent = goal.join(d.withColumnRenamed("box", "other"), "other").select(*dims, "units", "box", "__p")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"rep": [], "s": []})
        points, at = np.unique(left[dims].to_numpy(float), axis=0, return_inverse=True)
        w = np.zeros((len(points), replicates))
        np.add.at(w, at.ravel(), np.stack(list(left["w"])).astype(float))
        _, y = Donors(right, dims, replicates).search(points)
        with np.errstate(invalid="ignore"):
            s = np.where(w > 0, w * y, 0.0).sum(axis=0)
        return pd.DataFrame({"rep": np.arange(replicates), "s": s})

    got = u.groupBy("box", "__p").cogroup(sent.groupBy("box", "__p")).applyInPandas(match, "rep int, s double")
    return got.groupBy("rep").agg(F.sum("s").alias("s"))


def matched_means(units: DataFrame, arms=cfg.ARMS, replicates: int = 0, leaf: int = LEAF, first: int = FIRST) -> DataFrame:
    """Mean outcome per arm after 1-nearest-neighbour matching on log e_<arm>: (rep, arm, value, n).

    Own outcome for the arm received, nearest donor's outcome otherwise. Replicate 0 is the sample itself. A replicate
    that counts no donor of an arm has no value there.
    """
    dims = [f"__l{i}" for i in range(len(arms))]
    base = units.select("unit_id", "arm", "y", *[F.log(f"e_{a}").alias(d) for a, d in zip(arms, dims)], counts(replicates).alias("w"))
    base = materialise(base, "match_units")
    own = base.select("arm", "y", F.posexplode("w").alias("rep", "n")).groupBy("rep", "arm").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("y")).alias("sy"))
    own = materialise(own, "own_sums")
    total = own.groupBy("rep").agg(F.sum("n").alias("n"))
    sides = []
    for a in arms:
        donors = donor_lists(base.where(F.col("arm") == a).select("unit_id", "y", "w", *dims), dims, first)
        got = matched_sums(base.where(F.col("arm") != a).select(*dims, "w"), donors, dims, replicates + 1, leaf)
        mine = own.where(F.col("arm") == a).select("rep", "sy")
        sides.append(total.join(mine, "rep", "left").join(got, "rep", "left").select("rep", F.lit(a).alias("arm"), ((F.coalesce("sy", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))) / F.col("n")).alias("value"), "n"))
    return union_all(sides)


def matching(units: DataFrame, arms=cfg.ARMS, replicates: int = 0, z: float = cfg.CI_Z) -> DataFrame:
    """Matching estimate of every arm and contrast; with replicates, a bootstrap interval (Poisson(1) weights)."""
    means = materialise(matched_means(units, arms, replicates), "matched").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    means = means.withColumn("outcome", F.lit("y")).withColumn("var", F.lit(None).cast("double"))
    out = arms_to_targets(means.where("rep = 0").drop("rep"), arms).withColumn("method", F.lit("matching")).select("method", "target", "value")
    if not replicates:
        return out
    spread = arms_to_targets(means.where("rep > 0"), arms, by=("rep",)).groupBy("target").agg(F.stddev_samp("value").alias("se"))
    return with_interval(out.join(spread, "target"), z)
