"""Mergeable summaries of tensors, and histograms.

Tasks fold the chunks of a job in order and the jobs of a span; spans are folded in order per tensor, by nodes of NODE, tensors in order to the total.
So results carry the same bits for any number of tasks and partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.tensors import CHUNK, JOB, SPAN, Payload, spans

#: Parts that are folded at once.
NODE = 1024
KEY = ["path", "tensor_pos"]
STATE = "count long, finite long, nan long, inf long, zeros long, min float, max float, mean double, m2 double"
_NAMES = [x.split()[0] for x in STATE.split(", ")]
_START = (0, 0, 0, 0, 0, float("inf"), float("-inf"), 0.0, 0.0)


def merge(a: tuple, b: tuple) -> tuple:
    """Two summaries as one; moments by their counts of finite values."""
    n, m = a[1], b[1]
    mean, m2 = a[7], a[8]
    if m:
        delta = b[7] - mean
        mean, m2 = mean + delta * m / (n + m), m2 + (b[8] + delta * delta * n * m / (n + m))
    return (a[0] + b[0], n + m, a[2] + b[2], a[3] + b[3], a[4] + b[4], min(a[5], b[5]), max(a[6], b[6]), mean, m2)


def _chunks(x: np.ndarray) -> list[tuple]:
    """A summary of each row of x."""
    k, m = x.shape
    wide = x.astype(np.float64)
    total = wide.sum(axis=1)
    n, nan, inf = np.full(k, m), np.zeros(k, np.int64), np.zeros(k, np.int64)
    if np.isfinite(total).all():  # so is every value: sums of floats don't overflow a double
        low, high = x.min(axis=1), x.max(axis=1)
        mean = total / m
        wide -= mean[:, None]
    else:
        fine = np.isfinite(x)
        n, nan = fine.sum(axis=1), np.isnan(x).sum(axis=1)
        inf = m - n - nan
        low, high = np.where(fine, x, np.inf).min(axis=1), np.where(fine, x, -np.inf).max(axis=1)
        wide = np.where(fine, wide, 0.0)
        mean = wide.sum(axis=1) / np.maximum(n, 1)
        wide = np.where(fine, wide - mean[:, None], 0.0)
    m2 = np.einsum("ij,ij->i", wide, wide)
    zeros = np.zeros(k, np.int64) if np.count_nonzero(x) == x.size else (x == 0).sum(axis=1)
    return list(zip([m] * k, n.tolist(), nan.tolist(), inf.tolist(), zeros.tolist(), low.tolist(), high.tolist(), mean.tolist(), m2.tolist(), strict=True))


def summarize(x: np.ndarray) -> list[tuple]:
    """A summary of each CHUNK of values, in order."""
    whole = len(x) // CHUNK * CHUNK
    out = _chunks(x[:whole].reshape(-1, CHUNK)) if whole else []
    return out + (_chunks(x[whole:].reshape(1, -1)) if whole < len(x) else [])


def fold(parts: list[tuple]) -> tuple:
    state = _START
    for p in parts:
        state = merge(state, p)
    return state


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary per span: its chunks are folded by job, and its jobs in order."""
    types = [pa.string(), pa.int32(), pa.int64(), *[pa.int64()] * 5, pa.float32(), pa.float32(), pa.float64(), pa.float64()]
    files = Payload()
    for batch in batches:
        rows = []
        for path, pos, dtype, offset, size, changed, start, n in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
            jobs = []
            for at in range(0, n, JOB):  # decoded by job, so that the values stay in the processor's cache
                jobs.append(fold(summarize(files.values(path, dtype, offset, size, changed, start + at, min(JOB, n - at)))))
            rows.append((path, pos, start // SPAN, *fold(jobs)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[*KEY, "span", *_NAMES])
    files.close()


def _merged(acc: Column, x: Column) -> Column:
    n, m = acc["finite"], x["finite"]
    delta = x["mean"] - acc["mean"]
    both = n + m
    add = lambda c: (acc[c] + x[c]).alias(c)
    return F.struct(
        *[add(c) for c in _NAMES[:5]], F.least(acc["min"], x["min"]).alias("min"), F.greatest(acc["max"], x["max"]).alias("max"),
        F.when(m == 0, acc["mean"]).otherwise(acc["mean"] + delta * m / both).alias("mean"),
        F.when(m == 0, acc["m2"]).otherwise(acc["m2"] + (x["m2"] + delta * delta * n * m / both)).alias("m2"),
    )


def tree(parts: DataFrame, by: list[str], order: str, names: list[str], start: Column, step) -> DataFrame:
    """One row per group, its parts folded by their order: first NODE neighbours at a time, then the nodes, so no array holds more parts than a node or a group's nodes."""

    def level(df: DataFrame, keys: list[str], at: str) -> DataFrame:
        got = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at, *names))).alias("parts"))
        return got.select(*keys, F.aggregate("parts", start, step).alias("s")).select(*keys, "s.*")

    return level(level(parts.withColumn("node", F.floor(F.col(order) / NODE)), [*by, "node"], order), by, "node")


def folded(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """One summary per group, its parts folded by their order."""
    start = F.struct(*[F.lit(v).cast(x.split()[1]).alias(x.split()[0]) for v, x in zip(_START, STATE.split(", "), strict=True)])
    return tree(parts, by, order, _NAMES, start, _merged)


def derived(df: DataFrame) -> DataFrame:
    """std (population), rms, l2_norm, abs_max and zero_fraction of summaries; 0 where there is nothing."""
    n = F.col("finite")
    std = F.when(n > 0, F.sqrt(F.col("m2") / n)).otherwise(F.lit(0.0))
    rms = F.when(n > 0, F.sqrt(F.col("m2") / n + F.col("mean") * F.col("mean"))).otherwise(F.lit(0.0))
    out = df.withColumn("std", std).withColumn("rms", rms).withColumn("l2_norm", F.col("rms") * F.sqrt(n.cast("double")))
    top = F.when(n > 0, F.greatest(F.abs("min"), F.abs("max"))).otherwise(F.lit(0.0)).cast("float")
    return out.withColumn("abs_max", top).withColumn("zero_fraction", F.when(F.col("count") > 0, F.col("zeros") / F.col("count")).otherwise(F.lit(0.0)))


def summaries(tensors: DataFrame) -> DataFrame:
    """tensors with their summaries; null ones where a type is not decoded, empty ones for empty tensors."""
    parts = spans(tensors).mapInArrow(_spans, f"path string, tensor_pos int, span long, {STATE}")
    got = tensors.join(folded(parts, KEY, "span"), KEY, "left")
    for v, x in zip(_START, STATE.split(", "), strict=True):
        name, kind = x.split()
        got = got.withColumn(name, F.when(F.col("dtype").isNotNull(), F.coalesce(name, F.lit(v).cast(kind))))
    return derived(got)


def total(summaries_: DataFrame) -> DataFrame:
    """One summary of all decoded tensors of a file, in their order."""
    return derived(folded(summaries_.where("dtype is not null"), ["path"], "tensor_pos"))


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of a finite value in `bins` equal ones over [low, high]."""
    x, low, high = x.cast("double"), low.cast("double"), high.cast("double")
    width = high - low
    return F.when(width > 0, F.least(F.floor((x - low) / F.when(width > 0, width) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def histograms(summaries_: DataFrame, bins: int = 16) -> DataFrame:
    """path, tensor_pos, name, bin, low, high, count: all bins of each tensor with finite values."""
    if bins < 1:
        raise ValueError("a histogram needs a bin at least")
    own = summaries_.where("finite > 0").select(*KEY, "name", "min", "max")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Payload()
        for batch in batches:
            for path, pos, dtype, offset, size, changed, start, n, low, high in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                x = files.values(path, dtype, offset, size, changed, start, n)
                x = x[np.isfinite(x)].astype(np.float64)
                at = np.minimum(((x - low) / (high - low) * bins).astype(np.int64), bins - 1) if high > low else np.zeros(len(x), np.int64)
                many = np.bincount(at, minlength=bins)
                some = np.flatnonzero(many)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(np.full(len(some), pos, np.int32)), pa.array(some), pa.array(many[some])], names=[*KEY, "bin", "count"])
        files.close()

    read = spans(summaries_).join(own.select(*KEY, "min", "max"), KEY).select(*KEY, "dtype", "file_offset", "file_size", "changed", "start", "n", "min", "max")
    counts = read.mapInArrow(run, "path string, tensor_pos int, bin long, count long").groupBy(*KEY, "bin").agg(F.sum("count").alias("count"))
    every = own.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    low, width = F.col("min").cast("double"), (F.col("max").cast("double") - F.col("min").cast("double")) / bins
    return every.join(counts, [*KEY, "bin"], "left").select(*KEY, "name", "bin", (low + width * F.col("bin")).alias("low"), (low + width * (F.col("bin") + 1)).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
