"""Means, standard errors and paired comparisons, for many comparisons at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.operators.metrics import same_group

Z95 = 1.96

# The four outcomes.
BELIEVE = "信じる差"
NOISE = "差は揺れの中"
NO_NOISE_BAND = "A/Aなし(判定保留)"
TOO_FEW = "判定不能(n<2)"


def _exact_mean() -> Column:
    """Mean of x; of equal values, that value, without the rounding of sum and division."""
    return F.when(F.min("x") == F.max("x"), F.min("x")).otherwise(F.avg("x"))


def mean_and_error(scores: DataFrame, by: list[str], value: str = "value", cluster: str | None = None) -> DataFrame:
    """n, mean, variance, plain and clustered standard error per group.

    Clustered: SE^2 + (1/n^2) * sum over clusters of (sum a)^2 - sum a^2, with a
    the deviation from the mean, floor 0. Deviations are taken from the finished
    mean rather than by expanding squares, so equal values give exactly 0; sums per
    cluster are built before the shuffle, so a cluster's size does not matter.
    """
    rows = scores.filter(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("x"), *([F.col(cluster).alias("_c")] if cluster else [])
    )
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), _exact_mean().alias("mean"))
    centred = same_group(rows, base, by).withColumn("a", F.col("x") - F.col("mean"))
    groups = [*by, "n", "mean"]
    per = centred.groupBy(*groups, *(["_c"] if cluster else [])).agg(
        F.sum("a").alias("s"), F.sum(F.col("a") * F.col("a")).alias("q")
    )
    total = per.groupBy(*groups).agg(
        F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("cross")
    )
    n = F.col("n")
    variance = F.when(n >= 2, F.col("q") / (n - 1))
    out = total.withColumn("variance", variance).withColumn("se_clt", F.sqrt(F.col("variance") / n))
    clustered = F.sqrt(F.greatest(F.col("variance") / n + F.col("cross") / (n * n), F.lit(0.0)))
    out = out.withColumn("se_cluster", F.when(n >= 2, clustered) if cluster else F.lit(None).cast("double"))
    return out.select(*by, "n", "mean", "variance", "se_clt", "se_cluster")


def interval(mean: Column, se: Column) -> tuple[Column, Column]:
    """95 % interval; null where there is no standard error."""
    return mean - Z95 * se, mean + Z95 * se


def paired_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, cluster and d = b - a for the ids both sides have."""
    left = a.select("qid", F.col("score").alias("score_a"), "cluster")
    right = b.select("qid", F.col("score").alias("score_b"))
    return left.join(right, "qid").withColumn("d", F.col("score_b") - F.col("score_a"))


def compare(differences: DataFrame, by: list[str], use_cluster: bool = True) -> DataFrame:
    """n, mean difference, both errors and intervals; the main one is clustered when clusters are given."""
    out = mean_and_error(differences, by, "d", "cluster" if use_cluster else None).withColumnRenamed("mean", "dbar")
    for kind in ("clt", "cluster"):
        low, high = interval(F.col("dbar"), F.col(f"se_{kind}"))
        out = out.withColumns({f"{kind}_low": low, f"{kind}_high": high})
    main = "cluster" if use_cluster else "clt"
    return out.withColumns(
        {"main": F.lit(main), "se": F.col(f"se_{main}"), "low": F.col(f"{main}_low"), "high": F.col(f"{main}_high")}
    )


def noise_width(low: Column, high: Column) -> Column:
    """Width of the same-setting band: the larger end of its interval."""
    return F.greatest(F.abs(low), F.abs(high))


def verdict(n: Column, dbar: Column, low: Column, high: Column, width: Column) -> Column:
    excludes_zero = ~((low <= 0) & (high >= 0))
    return (
        F.when((n < 2) | low.isNull(), TOO_FEW)
        .when(width.isNull(), NO_NOISE_BAND)
        .when(excludes_zero & (F.abs(dbar) > width), BELIEVE)
        .otherwise(NOISE)
    )
