"""Model-based nuisances and learners (MLlib)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand import config as cfg
from evenhand.functions.ranking import exact_quantiles
from evenhand.functions.stats import rnd, union_all
from evenhand.session import materialise


def _label(arms):
    out = F.lit(None).cast("double")
    for i, a in enumerate(arms):
        out = F.when(F.col("arm") == a, F.lit(float(i))).otherwise(out)
    return out


def _fit_logistic(train: DataFrame, covariates, arms, n: int):
    stages = [
        VectorAssembler(inputCols=list(covariates), outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
        # an inverse strength of 1 on a summed loss is 1/n on Spark's mean loss
        LogisticRegression(featuresCol="__x", labelCol="__t", family="multinomial", regParam=1.0 / n, elasticNetParam=0.0,
                           standardization=False, probabilityCol="__p", rawPredictionCol="__rp", predictionCol="__pred"),
    ]
    return Pipeline(stages=stages).fit(train)


def _score(model, df: DataFrame, arms) -> DataFrame:
    got = model.transform(df).withColumn("__pa", vector_to_array("__p"))
    return got.select(*df.columns, *[F.col("__pa")[i].alias(f"e_{a}") for i, a in enumerate(arms)])


def logistic_propensity(units: DataFrame, covariates, arms=cfg.ARMS, folds: int = 0,
                        new_units: DataFrame | None = None) -> DataFrame:
    """Standardised multinomial logistic propensities e_<arm>.

    With ``folds`` each fold is scored by the model of the other folds (``units`` must carry ``fold``); otherwise one
    model scores ``new_units`` (or the units themselves).
    """
    data = units.withColumn("__t", _label(arms)).persist()
    if not folds:
        model = _fit_logistic(data, covariates, arms, data.count())
        return _score(model, new_units if new_units is not None else units, arms)
    parts = []
    for f in range(folds):
        train = data.where(F.col("fold") != f)
        parts.append(_score(_fit_logistic(train, covariates, arms, train.count()), units.where(F.col("fold") == f), arms))
    return union_all(parts)


def _gbt(target: str, trees: int):
    return GBTRegressor(featuresCol="__raw", labelCol=target, predictionCol="__pred", maxDepth=3, maxIter=trees, stepSize=0.05, seed=7)


def tree_outcomes(folded: DataFrame, covariates, arms=cfg.ARMS, trees: int = 200) -> DataFrame:
    """mu_<arm> from boosted trees per arm and fold, each fold predicted by models of the other folds."""
    data = VectorAssembler(inputCols=list(covariates), outputCol="__raw").transform(folded).persist()
    folds = [r[0] for r in data.select("fold").distinct().collect()]
    parts = []
    for f in folds:
        got = data.where(F.col("fold") == f)
        for a in arms:
            model = _gbt("y", trees).fit(data.where((F.col("fold") != f) & (F.col("arm") == a)))
            got = model.transform(got).withColumnRenamed("__pred", f"mu_{a}")
        parts.append(got.drop("__raw"))
    return union_all(parts)


def bin_edges(df: DataFrame, covariates, bins: int = 32) -> dict[str, list[float]]:
    """At most ``bins - 1`` thresholds a covariate, as trees consider: between its values if these are few, else its exact quantiles."""
    out = {}
    for c in covariates:
        x = df.select(F.col(c).cast("double").alias("x")).where(F.col("x").isNotNull())
        few = sorted(r[0] for r in x.distinct().limit(bins + 1).collect())
        if len(few) <= bins:
            out[c] = [(a + b) / 2 for a, b in zip(few, few[1:])]
        else:
            out[c] = sorted({r["value"] for r in exact_quantiles(x, "x", [i / bins for i in range(1, bins)]).collect()})
    return out


def binned(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Adds __bin_<covariate>, the number of thresholds below the value; empty if the value is, so that assembling ends with an error."""
    def bin_of(c):
        x = F.col(c).cast("double")
        n = F.size(F.filter(F.array(*[F.lit(e) for e in edges[c]]), lambda e: e < x)) if edges[c] else F.lit(0)
        return F.when(x.isNotNull() & ~F.isnan(x), n.cast("double"))

    return df.select("*", *[bin_of(c).alias(f"__bin_{c}") for c in edges])


def tree_groups(data: DataFrame, covariates, target) -> DataFrame:
    """Binned units as a row for each set of bins that occurs: mean of ``target`` as __ps, number of units as __n."""
    keys = [f"__bin_{c}" for c in covariates]
    return materialise(data.groupBy(*keys).agg(F.avg(target).alias("__ps"), F.count(F.lit(1)).cast("double").alias("__n")), "tree_groups")


def tree_effect(scored: DataFrame, covariates, first: str, second: str, trees: int = 200) -> DataFrame:
    """Flexible second stage: boosted trees of the score difference on the covariates; adds ``tau``.

    A tree sees a covariate only by the thresholds between its bins, so units of the same bins always share a leaf: their mean,
    weighted by their number, gives the same trees as the units do, and the rounds read this table instead of them."""
    target = (F.col(first) - F.col(second)).cast("double")
    data = binned(scored, bin_edges(scored, covariates))
    keys = [f"__bin_{c}" for c in covariates]
    to_vector = VectorAssembler(inputCols=keys, outputCol="__raw")
    model = _gbt("__ps", trees).setWeightCol("__n").fit(to_vector.transform(tree_groups(data, covariates, target)))
    return model.transform(to_vector.transform(data)).withColumnRenamed("__pred", "tau").drop("__raw", *keys)


def grade_levels(pred: DataFrame, prefix: str, arms=cfg.ARMS) -> DataFrame:
    """Mean prediction and RMSE against the truth for every arm and contrast of level predictions ``prefix_<arm>``."""
    def diff(p, a, b):
        return F.col(f"{p}_{a}") - F.col(f"{p}_{b}") if b else F.col(f"{p}_{a}")

    rows = F.array(*[F.struct(F.lit(t).alias("target"), diff(prefix, a, b).alias("v"), diff("mu_true", a, b).alias("tr"))
                     for t, a, b in cfg.targets(arms)])
    out = pred.select(F.explode(rows).alias("r")).groupBy("r.target").agg(
        F.avg("r.v").alias("mean_pred"), F.sqrt(F.avg((F.col("r.v") - F.col("r.tr")) ** 2)).alias("pehe"),
        F.count(F.lit(1)).alias("n"))
    return rnd(out)
