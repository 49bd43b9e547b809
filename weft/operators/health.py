"""Health rules over summaries and rows of tensors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.stats import KEY, fold, summarize
from weft.sources.tensors import JOB, Payload, spans

F16_MAX, LISTED = 65504.0, 5
#: Of the sketch that bounds a median's place.
ACCURACY = 10_000
SEVERITIES = ("INFO", "WARN", "ERROR")


@dataclass(frozen=True)
class Thresholds:
    max_abs: float = 1e4
    max_zero_fraction: float = 0.5
    max_dead_row_fraction: float = 0.01
    row_norm_ratio: float = 10.0


def _row_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = Payload()
    for batch in batches:
        for path, pos, dtype, offset, size, changed, length, start, n in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
            dead, norm = np.zeros(n, bool), np.zeros(n)
            if length <= 4096:
                x = files.values(path, dtype, offset, size, changed, start * length, n * length).reshape(n, length)
                fine = np.isfinite(x)
                wide = np.where(fine, x, 0).astype(np.float64)
                dead, norm = (x == 0).all(axis=1), np.sqrt(np.einsum("ij,ij->i", wide, wide))
            else:
                for k in range(n):
                    parts = []
                    for at in range(0, length, JOB):
                        parts += summarize(files.values(path, dtype, offset, size, changed, (start + k) * length + at, min(JOB, length - at)))
                    s = fold(parts)
                    dead[k] = s[4] == s[0]
                    norm[k] = np.sqrt(s[8] / s[1] + s[7] ** 2) * np.sqrt(s[1]) if s[1] else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, pos, np.int32)), pa.array(np.arange(start, start + n)), pa.array(dead), pa.array(norm)], names=[*KEY, "row", "dead", "norm"])
    files.close()


def row_facts(tensors: DataFrame) -> DataFrame:
    """path, tensor_pos, row, dead, norm for tensors of two axes or more."""
    return spans(tensors, "rows").mapInArrow(_row_facts, "path string, tensor_pos int, row long, dead boolean, norm double")


def medians(rows: DataFrame, by: list[str], accuracy: int = ACCURACY) -> DataFrame:
    """by, n_rows, n_dead, n_live and the exact median norm of live rows (null without any).

    A sketch of fixed size bounds the median's place to within 2 / accuracy of the rows; of the norms between the bounds the distinct ones are counted, those below are
    only counted, so no buffer holds all norms of a tensor."""
    live, edge = F.when(~F.col("dead"), F.col("norm")), 2.0 / accuracy
    base = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if("dead").alias("n_dead"), F.count(live).alias("n_live"), F.percentile_approx(live, [0.5 - edge, 0.5 + edge], accuracy).alias("cut"))
    low, high = F.col("cut")[0], F.col("cut")[1]
    near = rows.where("not dead").join(base.select(*by, "cut"), by).where(F.col("norm") <= high)
    counted = near.groupBy(*by, F.when(F.col("norm") >= low, F.col("norm")).alias("value")).agg(F.count("*").alias("n"))
    steps = counted.groupBy(*by).agg(F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("below"), F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "n")))).alias("steps"))

    def ranked(rank: Column) -> Column:
        """The norm of a rank (from 0): the first step whose running count goes beyond it."""
        start = F.struct(F.coalesce("below", F.lit(0)).cast("long").alias("seen"), F.lit(None).cast("double").alias("value"))
        return F.aggregate("steps", start, lambda acc, s: F.struct((acc["seen"] + s["n"]).alias("seen"), F.when(acc["seen"] <= rank, s["value"]).otherwise(acc["value"]).alias("value")))["value"]

    last = F.col("n_live") - 1
    middle = (ranked(F.floor(last / 2)) + ranked(F.ceil(last / 2))) / 2
    return base.join(steps, by, "left").withColumn("median", middle).drop("cut", "below", "steps")


def row_summary(rows: DataFrame, by: list[str], ratio: float) -> DataFrame:
    """n_rows, n_dead, first dead rows, median norm of live rows, outliers and the first of them with their ratio. rows: by, row, dead, norm.

    Only the first LISTED rows of a list are gathered, so a tensor's rows never meet in one value."""
    base = medians(rows, by)
    joined = rows.join(base.select(*by, "n_live", "median"), by)
    low = F.col("median") / ratio if ratio else F.lit(float("inf"))
    out = ~F.col("dead") & (F.col("n_live") >= 2) & (F.col("median") > 0) & ((F.col("norm") < low) | (F.col("norm") > F.col("median") * ratio))
    marked = joined.withColumn("out", out).where(F.col("dead") | F.col("out"))
    first = lambda kind: F.expr(f"array_agg(cell) FILTER (WHERE {kind} AND place <= {LISTED})")
    from pyspark.sql import Window

    ranked = marked.withColumn("place", F.row_number().over(Window.partitionBy(*by, "out").orderBy("row"))).where(F.col("place") <= LISTED)
    ranked = ranked.withColumn("cell", F.struct("row", F.when(F.col("out"), F.col("norm") / F.col("median")).alias("ratio")))
    lists = ranked.groupBy(*by).agg(F.array_sort(first("dead")).alias("dead_rows"), F.array_sort(first("out")).alias("out_rows"))
    many = marked.groupBy(*by).agg(F.count_if("out").alias("n_out"))
    return base.join(many, by, "left").join(lists, by, "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)))


def _rule(ord_: int, check: str, severity, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(ord_).alias("ord"), F.lit(check).alias("check"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity")))


def findings(checked: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row per finding: the columns of checked, then ord, check, severity. checked: summaries with the columns of row_summary (null where a tensor has no rows)."""
    some = F.col("count") > 0
    zero, constant = F.col("zeros") == F.col("count"), (F.col("finite") == F.col("count")) & (F.col("count") > 1) & (F.col("min") == F.col("max"))
    dead = (F.col("n_dead") > 0) & (F.col("n_dead") < F.col("n_rows_seen"))
    level = F.when(F.col("n_dead") / F.col("n_rows_seen") > t.max_dead_row_fraction, "WARN").otherwise("INFO")
    rules = [
        _rule(1, "non-finite", "ERROR", F.col("nan") + F.col("inf") > 0),
        _rule(2, "all-zero", "WARN", zero),
        _rule(2, "constant", "WARN", ~zero & constant),
        _rule(2, "sparse", "WARN", ~zero & ~constant & (F.col("zero_fraction") > t.max_zero_fraction)),
        _rule(3, "large-magnitude", "WARN", F.col("abs_max") > F.lit(t.max_abs).cast("float")),
        _rule(4, "f16-range", "INFO", F.col("dtype").isin("F32", "BF16") & (F.col("abs_max") > F.lit(F16_MAX).cast("float"))),
        _rule(5, "dead-rows", level, dead),
        _rule(6, "row-norm", "WARN", F.col("n_out") > 0),
    ]
    return checked.where(some).select("*", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("*", "f.*").drop("f")


def check(summaries_: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Findings of all decoded tensors, in the order of the report."""
    rows = row_summary(row_facts(summaries_), KEY, t.row_norm_ratio).withColumnRenamed("n_rows", "n_rows_seen")
    return findings(summaries_.where("dtype is not null").join(rows, KEY, "left"), t).orderBy("path", "tensor_pos", "ord")


def status(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos, and the exit status without and with --strict."""
    many = [F.count_if(F.col("severity") == s) for s in ("ERROR", "WARN", "INFO")]
    out = found.agg(*[m.alias(n) for m, n in zip(many, ("errors", "warnings", "infos"), strict=True)])
    bad = lambda on: F.when(on, 2).otherwise(0).cast("long")
    return out.withColumn("status", bad(F.col("errors") > 0)).withColumn("strict_status", bad(F.col("errors") + F.col("warnings") > 0))


def counts(found: DataFrame) -> DataFrame:
    """severity, n for all severities."""
    return found.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string").join(found.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
