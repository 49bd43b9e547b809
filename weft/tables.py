"""Tensors that live in ordinary tables: the same operators as columns, without files or Python.

A table of values has (tensor, row, pos, x), a table of arrays has (tensor, row, x) with one array per row. What concerns a row, a block of a row or a
pair of rows is folded in the row's array, so only one result per row is shuffled, if any; sums over tensors are combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.codecs import f16_rounded
from weft.operators.diff import SUMS
from weft.operators.health import Thresholds, row_summary
from weft.operators.stats import bin_of

BLOCK = 32


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def exploded(arrays: DataFrame) -> DataFrame:
    """The values of a table of arrays."""
    return arrays.select("tensor", "row", F.posexplode("x").alias("pos", "x"))


def summary(values: DataFrame, *by: str) -> DataFrame:
    """count, finite, nan, inf, zeros, min, max, mean, std, rms, l2_norm, abs_max, zero_fraction by group."""
    x = F.col("x")
    own = F.when(finite(x), x)
    wide = own.cast("double")
    some = lambda c, none=0.0: F.coalesce(c, F.lit(none))
    out = values.groupBy(*by).agg(
        F.count("*").alias("count"), F.count(own).alias("finite"), F.count_if(F.isnan(x)).alias("nan"), F.count_if(F.abs(x) == float("inf")).alias("inf"), F.count_if(own == 0).alias("zeros"),
        F.min(own).alias("min"), F.max(own).alias("max"), some(F.avg(wide)).alias("mean"), some(F.stddev_pop(wide)).alias("std"), some(F.sqrt(F.avg(wide * wide))).alias("rms"),
    )
    top = F.coalesce(F.greatest(F.abs("min"), F.abs("max")), F.lit(0.0)).cast("float")
    return out.withColumns({"l2_norm": F.col("rms") * F.sqrt("finite"), "abs_max": top, "zero_fraction": F.when(F.col("count") > 0, F.col("zeros") / F.col("count")).otherwise(0.0)})


def histogram(values: DataFrame, bins: int) -> DataFrame:
    """tensor, bin, count; empty bins too."""
    own = values.where(finite(F.col("x")))
    range_ = own.groupBy("tensor").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    counts = own.join(range_, "tensor").groupBy("tensor", bin_of(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("count"))
    every = range_.select("tensor", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(counts, ["tensor", "bin"], "left").select("tensor", "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def rows(arrays: DataFrame) -> DataFrame:
    """tensor, row, dead, norm."""
    squares = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + F.when(finite(v), v.cast("double") * v.cast("double")).otherwise(F.lit(0.0)))
    return arrays.select("tensor", "row", F.forall("x", lambda v: v == 0).alias("dead"), F.sqrt(squares).alias("norm"))


def pairs(arrays: DataFrame, other: DataFrame) -> DataFrame:
    """The accumulators of a comparison by tensor, over the rows that both have."""
    both = arrays.join(other.withColumnRenamed("x", "y"), ["tensor", "row"])
    zero = F.struct(*[F.lit(0).cast("long" if k < 4 else "double").alias(n) for k, n in enumerate(SUMS)])

    def step(acc: Column, v: Column) -> Column:
        x, y = v["x"].cast("double"), v["y"].cast("double")
        fine, same, d = finite(x) & finite(y), x == y, x - y  # NaN equals NaN here
        one = lambda on: on.cast("long")
        more = {"elements": F.lit(1).cast("long"), "equal": one(same), "finite_pairs": one(fine), "nonfinite_mismatch": one(~fine & ~same), "sum_abs": F.abs(d), "sum_sq": d * d, "sum_aa": x * x, "sum_bb": y * y, "sum_ab": x * y}
        cell = lambda n: acc[n] + (F.when(fine, more[n]).otherwise(F.lit(0.0)) if n.startswith("sum") else more[n])
        return F.struct(*[(F.greatest(acc[n], F.when(fine, F.abs(d)).otherwise(F.lit(0.0))) if n == "max_abs_diff" else cell(n)).alias(n) for n in SUMS])

    own = both.select("tensor", F.aggregate(F.arrays_zip("x", "y"), zero, step).alias("s")).select("tensor", "s.*")
    return own.groupBy("tensor").agg(*merged())


def merged() -> list[Column]:
    """Accumulators of several parts as one."""
    return [(F.max(n) if n == "max_abs_diff" else F.sum(n)).alias(n) for n in SUMS]


def quantized(arrays: DataFrame, kind: str) -> DataFrame:
    """tensor, row, pos, x, code and y, what comes back from blocks of 32 of a row (the last may be shorter)."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("x") - 1) / BLOCK), F.lit(0)).cast("int"))
    real = lambda b: F.filter(b, lambda v: ~F.isnan(v))

    def scale(b: Column) -> Column:
        if kind == "Q8_0":
            return (F.coalesce(F.array_max(F.transform(real(b), lambda v: F.abs(v))), F.lit(0.0)).cast("double") / 127).cast("float")
        # The first of the largest, with its sign.
        top = F.aggregate(real(b), F.lit(0.0).cast("float"), lambda acc, v: F.when(F.abs(v) > F.abs(acc), v).otherwise(acc))
        return (top.cast("double") / -8).cast("float")

    def one(v: Column, d: Column, inverse: Column) -> Column:
        scaled = (v * inverse).cast("float")
        if kind == "Q8_0":
            code = F.signum(scaled.cast("double")) * F.floor(F.abs(scaled.cast("double")) + 0.5)
            code = F.when(F.isnan(scaled), F.lit(0.0)).otherwise(F.least(F.greatest(code, F.lit(-128.0)), F.lit(127.0)))
            return F.struct(v.alias("x"), code.cast("long").alias("code"), (code.cast("float") * f16_rounded(d)).cast("float").alias("y"))
        code = F.when(F.isnan(scaled), F.lit(0.0)).otherwise(F.least(F.floor((scaled + F.lit(8.5).cast("float")).cast("float").cast("double")).cast("double"), F.lit(15.0)))
        return F.struct(v.alias("x"), code.cast("long").alias("code"), ((code - 8).cast("float") * f16_rounded(d)).cast("float").alias("y"))

    blocks = F.transform(starts, lambda k: F.slice("x", k * BLOCK + 1, BLOCK))
    sized = F.transform(blocks, lambda b: F.struct(b.alias("b"), scale(b).alias("d")))
    ready = F.transform(sized, lambda s: F.struct(s["b"].alias("b"), s["d"].alias("d"), F.when(s["d"] == 0, F.lit(0.0)).otherwise(F.lit(1.0) / F.when(s["d"] == 0, F.lit(1.0)).otherwise(s["d"].cast("double"))).cast("float").alias("i")))
    cells = F.flatten(F.transform(ready, lambda s: F.transform(s["b"], lambda v: one(v, s["d"], s["i"]))))
    return arrays.select("tensor", "row", F.posexplode(cells).alias("pos", "c")).select("tensor", "row", "pos", "c.*")


def checked(arrays: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Summaries with what health.findings() needs of their rows."""
    own = row_summary(rows(arrays), ["tensor"], t.row_norm_ratio).withColumnRenamed("n_rows", "n_rows_seen")
    return summary(exploded(arrays), "tensor").withColumn("dtype", F.lit("F32")).join(own, "tensor")
