"""Distributed sinks: rows of float arrays become a model in shards, files of one [rows, width] tensor each; decoded values become raw files with a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.stats import summaries
from weft.sources.storage import opened
from weft.sources.tensors import JOB, Payload, spans
from weft.sources.writers import gguf, safetensors, tensor

#: Rows of a shard; a task writes as many shards as it needs.
ROWS = 1 << 16


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Arrays of one length as a matrix; ValueError for a null row, a null value or another length."""
    if column.null_count:
        raise ValueError("a row without values can't be written")
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes[0]) if width is None and len(sizes) else width
    if (sizes != width).any():
        raise ValueError(f"rows of {sorted(set(sizes.tolist()))} values can't make a tensor of width {width}")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a null within a row can't be written")
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(sizes), width or 0)


def _put(folder: str, kind: str, metadata: list[tuple[str, str, Any]], tensors: list[dict]) -> str:
    files, inner = opened(folder)
    files.create_dir(inner, recursive=True)
    leaf = f"{uuid.uuid4().hex}.{kind}"
    with files.open_output_stream(f"{inner}/{leaf}") as f:
        f.write(safetensors({k: v if t == "string" else str(v) for k, t, v in metadata}, tensors) if kind == "safetensors" else gguf(metadata, tensors))
    return f"{folder}/{leaf}"


def _manifest(paths: DataFrame, folder: str) -> DataFrame:
    spark, table = paths.sparkSession, f"{folder}/manifest"
    paths.write.parquet(table)
    return spark.read.schema("path string").parquet(table).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def write_shards(rows: DataFrame, folder: str, kind: str = "safetensors", dtype: str = "F32", name: str = "emb") -> DataFrame:
    """Write the column `values` (arrays of one length, else ValueError) below folder, as the rows lie in tasks; a table of the paths of finished tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        paths: list[str] = []

        def out() -> None:
            x = np.concatenate(held)
            paths.append(_put(folder, kind, [("general.name", "string", name)], [tensor(f"{name}.{uuid.uuid4().hex[:8]}", dtype, list(x.shape), x)]))
            held.clear()

        width = None
        for batch in batches:
            column = batch.column("values")
            if len(column):
                held.append(matrix(column, width))
                width = held[-1].shape[1]
                if sum(map(len, held)) >= ROWS:
                    out()
        if held:
            out()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return _manifest(rows.select("values").mapInArrow(run, "path string"), folder)


def write_numbered(rows: DataFrame, folder: str, kind: str = "safetensors", dtype: str = "F32", name: str = "emb") -> DataFrame:
    """Write shards that are given: rows of shard (long), at (long, the order within it) and values. Tensor `name.shard`, with metadata of its number and rows.

    A shard is written by one task from memory, so shards must be small; repeated or null places of a shard are a ValueError."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at").combine_chunks()
        at, number = table.column("at"), table.column("shard")[0].as_py()
        if at.null_count or number is None or len(set(at.to_pylist())) < len(at):
            raise ValueError(f"shard {number}: places must be there and differ")
        x = matrix(table.column("values").chunk(0))
        about = [("general.name", "string", name), ("shard.number", "u32", number), ("shard.rows", "u64", len(x)), ("shard.whole", "bool", True), ("shard.first", "array", ("i64", at.to_pylist()[:10]))]
        return pa.table({"path": pa.array([_put(folder, kind, about, [tensor(f"{name}.{number}", dtype, list(x.shape), x)])])})

    return _manifest(rows.select("shard", "at", "values").groupBy("shard").applyInArrow(run, "path string"), folder)


def dump(tensors: DataFrame, folder: str) -> DataFrame:
    """Decode tensors to raw little-endian float32 files below folder, one per span of values; their manifest, also written there as Parquet.

    Manifest: a row for each tensor with its place in its file, its summary, and `parts` (first element, values, file) in order; tensors that are not decoded have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out = Payload(), []
        for batch in batches:
            for path, pos, dtype, offset, size, changed, start, n in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                store, inner = opened(folder)
                store.create_dir(inner, recursive=True)
                leaf = f"{uuid.uuid4().hex}.f32"
                with store.open_output_stream(f"{inner}/{leaf}") as f:
                    for at in range(0, n, JOB):
                        f.write(files.values(path, dtype, offset, size, changed, start + at, min(JOB, n - at)).astype("<f4").tobytes())
                out.append((path, pos, start, n, f"{folder}/{leaf}"))
        files.close()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["path", "tensor_pos", "start", "n", "file"])

    written = spans(tensors).mapInArrow(run, "path string, tensor_pos int, start long, n long, file string")
    parts = written.groupBy("path", "tensor_pos").agg(F.sort_array(F.collect_list(F.struct("start", "n", "file"))).alias("parts"))
    own = ["path", "tensor_pos", "name", "type_name", "shape", "elements", "file_offset", "byte_len", "count", "finite", "nan", "inf", "zeros", "min", "max", "mean", "std"]
    out = summaries(tensors).select(*own, F.col("dtype").isNotNull().alias("decoded")).join(parts, ["path", "tensor_pos"], "left")
    table = f"{folder}/manifest"
    out.write.parquet(table)
    return tensors.sparkSession.read.parquet(table)

