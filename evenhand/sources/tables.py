"""The given tables, the views derived from them and small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions.hashing import noise, uniform


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Text work is all in the scan's tasks, so a table with fewer splits than cores is dealt out; a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table written in code (rules, registers, word lists), with an explicit schema."""
    return spark.createDataFrame(rows, schema)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has line items: arm, covariates, a 25-value cell and three outcomes.

    Lines are summed by order before the join, so the shuffle carries one row per order.
    """
    amount = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("x2"),
        (F.sum(amount).cast("double") / 1000).alias("y"),
        (F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double") / F.count("l_discount") * 100).alias("y2"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y3"),
        F.max("l_shipdate").alias("last_ship"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderpriority").alias("prio"),
        F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").otherwise("C").alias("arm"),
    )
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("seg"))
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("unit_id"), "arm",
            ((F.col("c_acctbal") - 4500) / 3200).alias("x1"), "x2",
            F.col("seg").isin("BUILDING", "MACHINERY").cast("int").alias("b1"),
            F.col("prio").isin("1-URGENT", "2-HIGH").cast("int").alias("b2"),
            "seg", "prio", F.concat_ws("|", "seg", "prio").alias("cell"), "y", "y2", "y3",
            (F.col("last_ship") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).cast("int").alias("m1"),
        )
    )


def planted_from(units: DataFrame, multiplier=1.0, replicate=None) -> DataFrame:
    """The units of ``cohort`` with arms and outcomes drawn from a known model.

    ``multiplier`` scales confounding and may be a column; ``replicate`` (a column) appends ``:r`` to every salt.
    """
    s = multiplier if not isinstance(multiplier, (int, float)) else F.lit(float(multiplier))
    extra = [] if replicate is None else [replicate]
    x1, b1, b2 = F.col("x1"), F.col("b1"), F.col("b2")
    out = units.withColumn("__a", F.exp(s * (0.8 * x1 + 0.5 * b1))).withColumn("__c", F.exp(s * (-0.3 * x1 + 0.8 * b2)))
    total = F.col("__a") + 1 + F.col("__c")
    out = out.select(
        "*", (F.col("__a") / total).alias("e_true_A"), (1 / total).alias("e_true_B"),
        (F.col("__c") / total).alias("e_true_C"),
        (-1.05 - 0.20 * x1 + 0.10 * b1).alias("mu_true_A"),
        (-0.85 - 0.12 * x1).alias("mu_true_B"),
        (-1.15 - 0.25 * x1 + 0.15 * b2).alias("mu_true_C"),
        uniform("unit_id", "t", *extra).alias("__u"),
        (0.6 * noise("unit_id", *extra)).alias("__eps"),
    )
    arm = (
        F.when(F.col("__u") < F.col("e_true_A"), "A")
        .when(F.col("__u") < F.col("e_true_A") + F.col("e_true_B"), "B").otherwise("C")
    )
    out = out.withColumn("arm", arm)
    mean = F.when(F.col("arm") == "A", F.col("mu_true_A")).when(F.col("arm") == "B", F.col("mu_true_B")).otherwise(
        F.col("mu_true_C"))
    return out.withColumn("y", mean + F.col("__eps")).drop("__a", "__c", "__u", "__eps")


def planted_cell() -> "F.Column":
    """Eight bands of x1 by b1 by b2: 32 cells."""
    band = F.least(F.lit(7), F.greatest(F.lit(0), F.floor((F.col("x1") + 1.75) / 0.4375)))
    return (band * 4 + F.col("b1") * 2 + F.col("b2")).cast("int")


def planted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, x1, b1, b2 and the cell of every unit, before arms are drawn."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("unit_id"), ((F.col("c_acctbal") - 4500) / 3200).alias("x1"),
            F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("b1"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("b2"),
        )
        .withColumn("cell", planted_cell())
    )


def planted(spark: SparkSession, sf_dir: str, multiplier: float = 1.0) -> DataFrame:
    return planted_from(planted_units(spark, sf_dir), multiplier)
