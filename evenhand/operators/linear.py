"""Linear models by normal equations: sums on Spark, a p-by-p solve on the driver, scoring as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand import config as cfg
from evenhand.functions.stats import fsum

MODEL_ROWS = "k int, target string, pos int, covariate string, beta double, mean double, scale double, cov array<double>, z double"
CODEGEN_LIMIT = 200  # more sums than this in one aggregate go through Arrow batches instead


def _sums(df: DataFrame, columns: list[str], combos, by=()) -> dict[tuple, np.ndarray]:
    """Σ of products of columns per group. ``combos`` are tuples of column positions; groups must be few."""
    by = list(by)
    if len(combos) <= CODEGEN_LIMIT or by:
        aggs = []
        for k, combo in enumerate(combos):
            term = F.col(columns[combo[0]])
            for i in combo[1:]:
                term = term * F.col(columns[i])
            aggs.append(F.sum(term).alias(f"__{k}"))
        rows = df.groupBy(*by).agg(*aggs).collect()
        return {tuple(r[b] for b in by): np.array([r[f"__{k}"] or 0.0 for k in range(len(combos))]) for r in rows}
    index = [np.array([c[j] if j < len(c) else -1 for c in combos]) for j in range(max(map(len, combos)))]

    def partial(batches):
        for batch in batches:
            m = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            m = np.column_stack([m, np.ones(len(m))])
            out = np.ones((len(m), len(combos)))
            for ix in index:
                out *= m[:, ix]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(combos)), pa.int32()), pa.array(out.sum(axis=0))], ["pos", "v"])

    parts = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(partial, "pos int, v double")
    got = parts.groupBy("pos").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(combos))
    for r in got:
        out[r["pos"]] = r["v"]
    return {(): out}


def gram(df: DataFrame, basis: list[str], ys: list[str], by=()) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """(B'B, B'Y) per group from one aggregate."""
    p, columns = len(basis), [*basis, *ys]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    cross = [(i, p + k) for i in range(p) for k in range(len(ys))]
    out = {}
    for key, v in _sums(df, columns, pairs + cross, by).items():
        g = np.zeros((p, p))
        for (i, j), s in zip(pairs, v):
            g[i, j] = g[j, i] = s
        out[key] = (g, v[len(pairs):].reshape(p, len(ys)))
    return out


@dataclass
class LinearEffect:
    """A fitted second stage: standardised covariates, coefficients and sandwich covariance per target."""

    covariates: list[str]
    targets: list[str]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray  # (1 + covariates, targets)
    cov: np.ndarray  # (targets, p, p)
    z: float = cfg.CI_Z
    extra: dict = field(default_factory=dict)

    def basis(self) -> list[Column]:
        return [F.lit(1.0)] + [(F.col(c) - F.lit(float(m))) / F.lit(float(s))
                               for c, m, s in zip(self.covariates, self.mean, self.scale)]

    def value(self, k: int) -> Column:
        return fsum(F.lit(float(b)) * x for b, x in zip(self.beta[:, k], self.basis()))

    def variance(self, k: int) -> Column:
        b, v = self.basis(), self.cov[k]
        return fsum(F.lit(float(v[i, j] * (1 if i == j else 2))) * b[i] * b[j] for i in range(len(b)) for j in range(i, len(b)))

    def score(self, df: DataFrame, keys=("unit_id",)) -> DataFrame:
        """(keys, target, value, se, ci_low, ci_high) for every row and target: column arithmetic only."""
        rows = [F.struct(F.lit(t).alias("target"), self.value(k).alias("value"), F.sqrt(self.variance(k)).alias("se"))
                for k, t in enumerate(self.targets)]
        out = df.select(*keys, F.explode(F.array(*rows)).alias("__t")).select(*keys, "__t.target", "__t.value", "__t.se")
        return out.withColumn("ci_low", F.col("value") - self.z * F.col("se")).withColumn("ci_high", F.col("value") + self.z * F.col("se"))

    def score_wide(self, df: DataFrame, only=None) -> DataFrame:
        """Columns value_<target>, se_<target> on the rows themselves."""
        cols = []
        for k, t in enumerate(self.targets):
            if only is None or t in only:
                cols += [self.value(k).alias(f"value_{t}"), F.sqrt(self.variance(k)).alias(f"se_{t}")]
        return df.select("*", *cols)

    def coefficients(self, spark) -> DataFrame:
        """One row per target and term: position, covariate ('1' is the constant), beta, its variance, mean, scale."""
        rows = []
        for k, t in enumerate(self.targets):
            for j, c in enumerate(["1", *self.covariates]):
                rows.append((t, j, c, float(self.beta[j, k]), float(self.cov[k][j, j]),
                             float(self.mean[j - 1]) if j else 0.0, float(self.scale[j - 1]) if j else 1.0))
        return spark.createDataFrame(rows, "target string, pos int, covariate string, beta double, var double, mean double, scale double")

    def covariance(self, spark) -> DataFrame:
        p = len(self.covariates) + 1
        rows = [(t, i, j, float(self.cov[k][i, j])) for k, t in enumerate(self.targets) for i in range(p) for j in range(p)]
        return spark.createDataFrame(rows, "target string, i int, j int, v double")

    def publish(self, spark, path: str, version: int) -> None:
        """Write the model as one more version of the table at path: a row per target and term with its row of the covariance.

        A version is one file in a folder of its own, so readers see it whole or not at all; writing it again replaces it.
        """
        rows = [(k, t, j, c, float(self.beta[j, k]), float(self.mean[j - 1]) if j else 0.0, float(self.scale[j - 1]) if j else 1.0, self.cov[k][j].tolist(), self.z)
                for k, t in enumerate(self.targets) for j, c in enumerate(["1", *self.covariates])]
        spark.createDataFrame(rows, MODEL_ROWS).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")

    @staticmethod
    def published(spark, path: str, version: int | None = None) -> tuple[int, LinearEffect]:
        """(version, model): the newest version of the table at path, or the one asked for. A model has targets x terms rows, whatever the data."""
        table = spark.read.schema(MODEL_ROWS + ", version int").parquet(path)
        wanted = F.lit(version) if version is not None else table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == wanted).orderBy("k", "pos").collect()
        if not rows:
            raise ValueError(f"no version {version} of a model at {path}")
        first = [r for r in rows if r["k"] == 0]
        targets = [r["target"] for r in rows if r["pos"] == 0]
        p = len(first)
        beta = np.array([r["beta"] for r in rows]).reshape(len(targets), p).T
        cov = np.array([r["cov"] for r in rows]).reshape(len(targets), p, p)
        model = LinearEffect([r["covariate"] for r in first[1:]], targets, np.array([r["mean"] for r in first[1:]]), np.array([r["scale"] for r in first[1:]]), beta, cov, first[0]["z"])
        return rows[0]["version"], model


def fit_effect(scored: DataFrame, covariates, pseudo: list[tuple[str, Column]], z: float = cfg.CI_Z) -> LinearEffect:
    """Regress each pseudo-outcome on standardised covariates with leverage-adjusted (HC3) covariance.

    Three passes of sums: means and sds, normal equations, sandwich middle. Only p-by-p matrices reach the driver.
    """
    covariates = list(covariates)
    stats = scored.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(covariates)
                         for n, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()[0]
    mean = np.array([stats[f"m_{i}"] for i in range(len(covariates))])
    scale = np.array([stats[f"s_{i}"] or 1.0 for i in range(len(covariates))])
    names = [t for t, _ in pseudo]
    p, basis = len(covariates) + 1, [f"__b{i}" for i in range(len(covariates) + 1)]
    ys = [f"__y{k}" for k in range(len(names))]
    shell = LinearEffect(covariates, names, mean, scale, np.zeros((p, len(names))), np.zeros((len(names), p, p)), z)
    rows = scored.select(*[b.alias(n) for b, n in zip(shell.basis(), basis)], *[c.alias(n) for (_, c), n in zip(pseudo, ys)])
    g, by_y = gram(rows, basis, ys)[()]
    bread = np.linalg.pinv(g)
    shell.beta = bread @ by_y
    lev = fsum(F.lit(float(bread[i, j] * (1 if i == j else 2))) * F.col(basis[i]) * F.col(basis[j])
               for i in range(p) for j in range(i, p))
    adj = []
    for k in range(len(names)):
        fit = fsum(F.lit(float(b)) * F.col(n) for b, n in zip(shell.beta[:, k], basis))
        r = (F.col(ys[k]) - fit) / (1 - F.least(F.greatest(F.col("__h"), F.lit(0.0)), F.lit(0.99)))
        adj.append((r * r).alias(f"__r{k}"))
    mid = rows.withColumn("__h", lev).select(*basis, *adj)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    combos = [(i, j, p + k) for k in range(len(names)) for i, j in pairs]
    v = _sums(mid, [*basis, *[f"__r{k}" for k in range(len(names))]], combos)[()].reshape(len(names), len(pairs))
    for k in range(len(names)):
        meat = np.zeros((p, p))
        for (i, j), s in zip(pairs, v[k]):
            meat[i, j] = meat[j, i] = s
        shell.cov[k] = bread @ meat @ bread
    return shell


def crossfit_linear_outcomes(folded: DataFrame, covariates, arms=cfg.ARMS) -> DataFrame:
    """mu_<arm> for every unit from per-arm least squares that leave the unit's fold out.

    One aggregate gives the normal equations of every (fold, arm); the other folds' equations are their differences.
    """
    basis = ["__one", *covariates]
    rows = folded.withColumn("__one", F.lit(1.0))
    parts = gram(rows, basis, ["y"], by=("fold", "arm"))
    folds = sorted({k[0] for k in parts})
    out = folded
    zero = (np.zeros((len(basis),) * 2), np.zeros((len(basis), 1)))
    for a in arms:
        total = [sum((parts.get((f, a), zero)[i] for f in folds)) for i in (0, 1)]
        choice = F.lit(None).cast("double")
        for f in folds:
            own = parts.get((f, a), zero)
            beta = np.linalg.pinv(total[0] - own[0]) @ (total[1] - own[1])
            pred = fsum(F.lit(float(b)) * (F.lit(1.0) if c == "__one" else F.col(c)) for b, c in zip(beta[:, 0], basis))
            choice = F.when(F.col("fold") == f, pred).otherwise(choice)
        out = out.withColumn(f"mu_{a}", choice)
    return out


def g_computation(units: DataFrame, covariates, first: str, second: str, replicates: int = 0) -> DataFrame:
    """One linear model with the treatment as a feature; the effect is the mean difference of the two predictions.

    With replicates, Poisson(1) bootstrap weights turn each replicate into its own sums in the same aggregate.
    """
    from evenhand.functions.hashing import poisson_one

    spark = units.sparkSession
    two = units.where(F.col("arm").isin(first, second)).withColumn("__t", F.when(F.col("arm") == first, 1.0).otherwise(0.0))
    basis = ["__one", *covariates, "__t"]
    rows = two.withColumn("__one", F.lit(1.0))
    g, b = gram(rows, basis, ["y"])[()]
    value, se = float((np.linalg.pinv(g) @ b)[-1, 0]), None
    if replicates:
        rep = two.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        rep = rep.withColumn("__w", F.sqrt(poisson_one("unit_id", F.lit("boot"), F.col("__rep")).cast("double"))).where("__w > 0")
        weighted = rep.select("__rep", F.col("__w").alias("__one"), *[(F.col(c) * F.col("__w")).alias(c) for c in [*covariates, "__t", "y"]])
        boots = [float((np.linalg.pinv(gg) @ bb)[-1, 0]) for gg, bb in gram(weighted, basis, ["y"], by=("__rep",)).values()]
        se = float(np.std(boots, ddof=1))
    return spark.createDataFrame([(f"{first}-{second}", value, se, replicates)], "target string, value double, se double, replicates int")
