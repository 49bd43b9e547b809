"""Comparison of two models: tensors matched by name, values compared in lockstep."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.stats import NODE, tree
from weft.sources.tensors import SPAN, Payload, dealt

#: Values of both sides that are compared at once.
PIECE = 1 << 15
SUMS = ["elements", "equal", "finite_pairs", "nonfinite_mismatch", "max_abs_diff", "sum_abs", "sum_sq", "sum_aa", "sum_bb", "sum_ab"]


def normal_name(name: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """The name without the first of the prefixes that it starts with; one at most."""
    if not prefixes:
        return name
    return reduce(lambda acc, p: F.when(F.startswith(name, F.lit(p)), F.substring(name, len(p) + 1, 2147483647)).otherwise(acc), reversed(prefixes), name)


def collisions(tensors: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Names of one side that become the same."""
    return tensors.groupBy(normal_name(F.col("name"), prefixes).alias("norm")).agg(F.sort_array(F.collect_list("name")).alias("names")).where(F.size("names") > 1)


def matched(a: DataFrame, b: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join by name: outcome (compared, shape_mismatch, not_decoded, only_a, only_b), norm, a_* and b_* columns."""
    for side in (a, b):
        clash = collisions(side, prefixes).first()
        if clash:
            raise ValueError(f"{clash['names'][0]!r} and {clash['names'][1]!r} both become {clash['norm']!r} after prefix stripping")
    own = lambda df, s: df.select(normal_name(F.col("name"), prefixes).alias(f"{s}_norm"), *[F.col(c).alias(f"{s}_{c}") for c in df.columns])
    out = own(a, "a").join(own(b, "b"), F.col("a_norm") == F.col("b_norm"), "full_outer")
    kind = F.when(F.col("b_norm").isNull(), "only_a").when(F.col("a_norm").isNull(), "only_b").when(F.col("a_shape") != F.col("b_shape"), "shape_mismatch")
    kind = kind.when(F.col("a_dtype").isNull() | F.col("b_dtype").isNull(), "not_decoded").otherwise("compared")
    return out.withColumn("outcome", kind).withColumn("norm", F.coalesce("a_norm", "b_norm")).drop("a_norm", "b_norm")


def sums(x: np.ndarray, y: np.ndarray) -> tuple:
    """The accumulators of SUMS over two equal runs of values."""
    fine = np.isfinite(x) & np.isfinite(y)
    whole = bool(fine.all())
    same = x == y
    p, q = (x, y) if whole else (x[fine], y[fine])
    a, b = p.astype(np.float64), q.astype(np.float64)
    d = a - b
    both = 0 if whole else int((np.isnan(x) & np.isnan(y)).sum())
    equal = int(same.sum()) + both
    odd = 0 if whole else int((~fine).sum() - (same & ~fine).sum() - both)
    size = np.abs(d)
    return (len(x), equal, len(a), odd, float(size.max()) if len(d) else 0.0, float(size.sum()), float(np.dot(d, d)), float(np.dot(a, a)), float(np.dot(b, b)), float(np.dot(a, b)))


def _merge(p: tuple, q: tuple) -> tuple:
    return (*[x + y for x, y in zip(p[:4], q[:4], strict=True)], max(p[4], q[4]), *[x + y for x, y in zip(p[5:], q[5:], strict=True)])


_ZERO = (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = Payload()
    types = [pa.string(), pa.int64(), *[pa.int64()] * 4, *[pa.float64()] * 6]
    for batch in batches:
        rows = []
        for norm, pa_, da, oa, sa, ca, pb, db, ob, sb, cb, start, n in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
            acc = _ZERO
            for at in range(0, n, PIECE):
                m = min(PIECE, n - at)
                acc = _merge(acc, sums(files.values(pa_, da, oa, sa, ca, start + at, m), files.values(pb, db, ob, sb, cb, start + at, m)))
            rows.append((norm, start // SPAN, *acc))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["norm", "span", *SUMS])
    files.close()


def folded(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Accumulators of groups, their parts added in order."""
    start = F.struct(*[F.lit(v).cast("long" if k < 4 else "double").alias(n) for k, (n, v) in enumerate(zip(SUMS, _ZERO, strict=True))])
    step = lambda acc, x: F.struct(*[(F.greatest(acc[n], x[n]) if n == "max_abs_diff" else acc[n] + x[n]).alias(n) for n in SUMS])
    return tree(parts, by, order, SUMS, start, step)


def metrics(df: DataFrame) -> DataFrame:
    """identical, changed_fraction, mean_abs, rmse, rel_l2 and cosine (null without a direction)."""
    n = F.greatest(F.col("finite_pairs"), F.lit(1))
    norms = F.col("sum_aa") * F.col("sum_bb")
    rel = F.when(F.col("sum_aa") > 0, F.sqrt(F.col("sum_sq") / F.when(F.col("sum_aa") > 0, F.col("sum_aa")))).when(F.col("sum_sq") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    changed = F.when(F.col("elements") > 0, 1 - F.col("equal") / F.when(F.col("elements") > 0, F.col("elements"))).otherwise(F.lit(0.0))
    return df.withColumns({
        "identical": F.col("equal") == F.col("elements"), "changed_fraction": changed, "mean_abs": F.col("sum_abs") / n, "rmse": F.sqrt(F.col("sum_sq") / n),
        "rel_l2": rel, "cosine": F.when(norms > 0, F.col("sum_ab") / F.sqrt(F.when(norms > 0, norms))),
    })


def compare(a: DataFrame, b: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """matched() with the accumulators and metrics of the compared pairs. a, b: tensors of one file each."""
    pairs = matched(a, b, prefixes)
    some = pairs.where("outcome = 'compared' and a_elements > 0")
    cut = some.select("norm", *[f"{s}_{c}" for s in "ab" for c in ("path", "dtype", "file_offset", "file_size", "changed")], "a_elements", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a_elements") - 1, F.lit(SPAN).cast("long"))).alias("start"))
    cut = cut.withColumn("n", F.least(F.lit(SPAN).cast("long"), F.col("a_elements") - F.col("start"))).drop("a_elements")
    cut = dealt(cut, a)
    kinds = ", ".join(f"{n} {'long' if k < 4 else 'double'}" for k, n in enumerate(SUMS))
    got = folded(cut.mapInArrow(_pairs, f"norm string, span long, {kinds}"), ["norm"], "span")
    out = pairs.join(got, "norm", "left")
    for n in SUMS:
        out = out.withColumn(n, F.when(F.col("outcome") == "compared", F.coalesce(n, F.lit(0))))
    return metrics(out)


def overall(compared: DataFrame) -> DataFrame:
    """Metrics of all compared pairs together: by groups of names, in the order of names, so the bits are the same for one file and for many shards."""
    own = compared.where("outcome = 'compared'").select(F.pmod(F.xxhash64("norm"), F.lit(NODE)).alias("group"), "norm", *SUMS)
    start = F.struct(*[F.lit(v).cast("long" if k < 4 else "double").alias(n) for k, (n, v) in enumerate(zip(SUMS, _ZERO, strict=True))])
    step = lambda acc, x: F.struct(*[(F.greatest(acc[n], x[n]) if n == "max_abs_diff" else acc[n] + x[n]).alias(n) for n in SUMS])
    groups = own.groupBy("group").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("norm", *SUMS))), start, step).alias("s")).select("group", "s.*")
    return metrics(folded(groups.withColumn("all", F.lit(1)), ["all"], "group").drop("all"))


def top_changed(compared: DataFrame, top: int = 20) -> DataFrame:
    """The changed pairs, largest relative change first, then by name; 0: all."""
    out = compared.where("outcome = 'compared' and not identical").orderBy(F.desc("rel_l2"), F.asc("norm"))
    return out.limit(top) if top else out
