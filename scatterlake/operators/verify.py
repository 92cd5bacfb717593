"""Comparison of two results within tolerances, as one join and one aggregate over long rows (artifact, key, pos, re, im)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterlake.functions.phase import TAU, wrapped_difference


@dataclass(frozen=True)
class Policy:
    rtol: float = 1e-5
    atol: float = 1e-7
    wrap: bool = False
    outliers: float = 0.0


# Keys that the scientific profile compares as wrapped phase, and by default.
SCIENTIFIC_WRAP = ("C_ps", "C_ps2", "ph_res", "ph_res2")
DEFAULT_WRAP = ("dph_noise",)


@dataclass(frozen=True)
class Policies:
    default: Policy = Policy()
    by_key: dict[str, Policy] = field(default_factory=dict)
    wrap_keys: tuple[str, ...] = DEFAULT_WRAP

    def table(self, spark) -> DataFrame:
        known = {k: Policy(self.default.rtol, self.default.atol, True) for k in self.wrap_keys} | self.by_key
        rows = [("", self.default.rtol, self.default.atol, self.default.wrap, self.default.outliers), *((k, p.rtol, p.atol, p.wrap, p.outliers) for k, p in known.items())]
        return spark.createDataFrame(rows, "suffix string, rtol double, atol double, wrap boolean, outliers double")


def resolved(keys: DataFrame, policies: DataFrame) -> DataFrame:
    """The policy of each key: that of its longest suffix. Both tables name keys, not values, and stay small."""
    fits = keys.join(F.broadcast(policies), F.col("key").endswith(F.col("suffix")))
    best = F.max_by(F.struct("rtol", "atol", "wrap", "outliers"), F.length("suffix"))
    return fits.groupBy("artifact", "key").agg(best.alias("p")).select("artifact", "key", "p.*")


def deviation(wrap: Column) -> Column:
    """Size of the difference of (re, im) and (gre, gim); wrapped: of real phases modulo 2 pi, of complex ones by angle."""
    both_zero = (F.col("im") == 0) & (F.col("gim") == 0)
    angle = wrapped_difference(F.atan2("im", "re"), F.atan2("gim", "gre"))
    empty = (F.hypot("re", "im") == 0) != (F.hypot("gre", "gim") == 0)
    turned = F.when(empty, float("inf")).otherwise(F.greatest(angle, F.abs(F.hypot("re", "im") - F.hypot("gre", "gim"))))
    return F.when(wrap, F.when(both_zero, wrapped_difference(F.col("re"), F.col("gre"), TAU)).otherwise(turned)).otherwise(F.hypot(F.col("re") - F.col("gre"), F.col("im") - F.col("gim")))


def compared(run: DataFrame, golden: DataFrame, policies: DataFrame) -> DataFrame:
    """Per artifact and key: how many values, are missing, deviate at most, are outliers, and pass."""
    keys = golden.select("artifact", "key").distinct()
    g = golden.select("artifact", "key", "pos", F.col("re").alias("gre"), F.col("im").alias("gim")).join(F.broadcast(resolved(keys, policies)), ["artifact", "key"])
    r = run.select("artifact", "key", "pos", "re", "im", F.lit(True).alias("here"))
    joined = g.join(r, ["artifact", "key", "pos"], "left")
    nan = lambda a, b: F.isnan(a) | F.isnan(b)
    both_nan = (F.isnan("re") | F.isnan("im")) & nan("gre", "gim")
    one_nan = nan("re", "im") != nan("gre", "gim")
    d = F.when(both_nan, 0.0).when(one_nan, float("inf")).when((F.col("re") == F.col("gre")) & (F.col("im") == F.col("gim")), 0.0).otherwise(deviation(F.col("wrap")))
    limit = F.col("atol") + F.when(F.col("wrap"), 0.0).otherwise(F.col("rtol") * F.hypot("gre", "gim"))
    out = F.col("here").isNotNull() & (d > limit)
    stats = joined.groupBy("artifact", "key").agg(F.count("*").alias("n"), F.sum(F.col("here").isNull().cast("long")).alias("missing"), F.max(F.when(F.col("here").isNotNull(), d)).alias("max_abs"), F.sum(out.cast("long")).alias("n_out"), F.first("outliers").alias("allowed"))
    return stats.withColumn("passed", (F.col("missing") == 0) & (F.col("n_out") <= F.col("allowed") * F.col("n"))).drop("allowed")


def exact(run: DataFrame, golden: DataFrame) -> DataFrame:
    """Values that must agree as they stand."""
    g = golden.select("artifact", "key", "pos", F.struct("re", "im").alias("g"))
    joined = g.join(run.select("artifact", "key", "pos", F.struct("re", "im").alias("r")), ["artifact", "key", "pos"], "left")
    return joined.groupBy("artifact", "key").agg(F.bool_and(F.col("r").eqNullSafe(F.col("g"))).alias("passed"))


def classified(report: DataFrame) -> DataFrame:
    """Why a comparison failed, and how many of each kind."""
    kind = F.when(F.col("passed"), "passed").when(F.col("missing") == F.col("n"), "key missing").when(F.col("missing") > 0, "shape").when(F.col("max_abs") == float("inf"), "not finite").when(F.col("n_out") < 0.01 * F.col("n"), "outliers").otherwise("numeric")
    return report.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
