"""Tables over tensor files: headers by one task per file, payloads as byte ranges of spans of values.

Headers and payload are separate scans, so a query over names and shapes reads no values, and a filter on the tensors table
prunes the byte ranges that are read at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.functions.codecs import BLOCKS, byte_range, decode
from weft.sources.headers import FormatError
from weft.sources.storage import opened, read_header, stamp

#: Values of a partial, of a job (what a task decodes at once), and of a span (the unit that is dealt to tasks); bytes that a task reads.
CHUNK, JOB, SPAN, TASK = 4096, 65536, 1 << 20, 256 << 20

_SHAPE = "array<decimal(20,0)>"
TENSORS = f"path string, format string, tensor_pos int, name string, type_name string, dtype string, shape {_SHAPE}, dims {_SHAPE}, elements long, data_offset long, file_offset long, byte_len long, row_len long, n_rows long, file_size long, changed long"
FILES = "path string, format string, file_size long, version int, header_len long, data_start long, alignment long, n_tensors int, total_elements decimal(38,0)"
METADATA = "path string, pos int, key string, value_type string, value_repr string, element_type string, arr_len long, preview array<string>"


def tensor_rows(path: str) -> list[tuple]:
    header, size, changed = read_header(path)
    out = []
    for k, t in enumerate(header.tensors):
        row = int(np.prod([int(d) for d in t.shape[1:]], dtype=object)) if len(t.shape) > 1 else None
        row = row if row is None or row < 2**63 else None
        rows = min(t.shape[0], 2**63 - 1) if t.shape else 1
        dims = [[Decimal(d) for d in x] if x is not None else None for x in (t.shape, t.dims)]
        out.append((path, header.format, k, t.name, t.type_name, t.dtype, *dims, t.elements, t.data_offset, t.file_offset, t.byte_len, row, rows, size, changed))
    return out


def file_rows(path: str) -> list[tuple]:
    h, size, _ = read_header(path)
    return [(path, h.format, size, h.version, h.header_len, h.data_start, h.alignment, len(h.tensors), Decimal(sum(t.elements for t in h.tensors)))]


def metadata_rows(path: str) -> list[tuple]:
    from weft.plans.render import described

    out = []
    for k, (key, kind, value) in enumerate(read_header(path)[0].metadata):
        inner = value if kind == "array" else (None, None, [])
        out.append((path, k, key, kind, described(kind, value), inner[0], inner[1], [described(t, v) for t, v in inner[2]]))
    return out


def _table(rows, schema: str):
    def scan(spark: SparkSession, paths: list[str] | str) -> DataFrame:
        paths = [paths] if isinstance(paths, str) else list(paths)
        listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 1024)))
        return from_paths(listed)

    def from_paths(listed: DataFrame) -> DataFrame:
        import pandas as pd

        names = [x.split()[0] for x in schema.replace("decimal(20,0)", "d").replace("decimal(38,0)", "d").split(", ")]

        def run(frames: Iterator[Any]) -> Iterator[Any]:
            for frame in frames:
                for path in frame["path"]:
                    yield pd.DataFrame(rows(path), columns=names, dtype=object)

        return listed.select("path").mapInPandas(run, schema)

    scan.from_paths = from_paths
    return scan


#: scan(spark, paths), or scan.from_paths(table with a column path): one row per tensor, per file, per metadata entry.
scan_tensors, scan_files, scan_metadata = _table(tensor_rows, TENSORS), _table(file_rows, FILES), _table(metadata_rows, METADATA)


def dealt(ranges: DataFrame, tensors: DataFrame) -> DataFrame:
    """Rows that stand for byte ranges of tensors, in turn over so many tasks that each reads about TASK bytes; merged by their own small size few tasks would read all of them."""
    size = tensors.agg(F.sum("byte_len")).first()[0] or 0
    return ranges.repartition(max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // TASK)))


def spans(tensors: DataFrame, unit: str = "elements") -> DataFrame:
    """Payload units of the decodable, non-empty tensors: path, tensor_pos, dtype, file_offset, file_size, changed, start, n. unit rows: whole rows, so that start and n count rows."""
    own = ["path", "tensor_pos", "dtype", "file_offset", "file_size", "changed"]
    some = tensors.where("dtype is not null and elements > 0")
    if unit == "elements":
        some = some.select(*own, "elements", F.explode(F.sequence(F.lit(0).cast("long"), F.col("elements") - 1, F.lit(SPAN).cast("long"))).alias("start"))
        out = some.select(*own, "start", F.least(F.lit(SPAN).cast("long"), F.col("elements") - F.col("start")).alias("n"))
    else:
        some = some.where("row_len > 0").withColumn("step", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(SPAN) / F.col("row_len"))))
        some = some.select(*own, "row_len", "n_rows", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.col("step"))).alias("start"))
        out = some.select(*own, "row_len", "start", F.least("step", F.col("n_rows") - F.col("start")).alias("n"))
    return dealt(out, tensors)


class Payload:
    """Ranges of one task's files; a file that changed since its header was read is refused."""

    def __init__(self) -> None:
        self.open: dict[str, Any] = {}

    def raw(self, path: str, dtype: str, file_offset: int, size: int, changed: int, start: int, n: int) -> bytes:
        if path not in self.open:
            if stamp(path) != (size, changed):
                raise FormatError(f"{path} changed between its header and its payload")
            files, inner = opened(path)
            self.open[path] = files.open_input_file(inner)
        at, length = byte_range(dtype, start, n)
        return self.open[path].read_at(length, file_offset + at)

    def values(self, *span) -> np.ndarray:
        return decode(span[1], self.raw(*span))

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def chunks_of(tensors: DataFrame) -> DataFrame:
    """path, tensor_pos, job, chunk, elem_start, vals: decoded values, CHUNK to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Payload()
        for batch in batches:
            for path, pos, dtype, offset, size, changed, start, n in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                for at in range(start, start + n, JOB):
                    x = files.values(path, dtype, offset, size, changed, at, min(JOB, start + n - at))
                    firsts = np.arange(0, len(x), CHUNK)
                    vals = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(x)).astype(np.int32)), pa.array(x, pa.float32(), from_pandas=False))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(firsts)), pa.array(np.full(len(firsts), pos, np.int32)), pa.array(np.full(len(firsts), at // JOB)), pa.array((firsts + at) // CHUNK), pa.array(firsts + at), vals], names=["path", "tensor_pos", "job", "chunk", "elem_start", "vals"])
        files.close()

    return spans(tensors).mapInArrow(run, "path string, tensor_pos int, job long, chunk long, elem_start long, vals array<float>")


def type_totals(tensors: DataFrame) -> DataFrame:
    """type_name, tensors, elements, bytes of the tensors of each type."""
    return tensors.groupBy("type_name").agg(F.count("*").alias("tensors"), F.sum("elements").alias("elements"), F.sum("byte_len").alias("bytes"))


def metadata_value(metadata: DataFrame, key: str) -> DataFrame:
    """path, value_type, value_repr, element_type, arr_len, preview of one key of each file (a key stands once in a file)."""
    return metadata.where(F.col("key") == key).select("path", "value_type", "value_repr", "element_type", "arr_len", "preview")


class _Part(InputPartition):
    """Files, or one run of spans of a tensor (its row, first element and end)."""

    def __init__(self, paths: list[str], row: tuple | None = None, start: int = 0, end: int = 0):
        self.paths, self.row, self.start, self.end = paths, row, start, end


class _Reader(DataSourceReader):
    """Tensors or raw chunks of files; the options name, contains and prefix prune what is read by a tensor's name. Arrow batches, in partitions of files or of TASK bytes of a tensor.

    Filters aren't taken over from a query: Spark keeps a reader with them for later queries over the same DataFrame, which would miss rows."""

    def __init__(self, options: dict[str, str]):
        self.paths, self.mode, tests = options["path"].split(","), options.get("mode", "tensors"), []
        if "name" in options:
            tests.append(lambda n, own=options["name"]: n == own)
        if "contains" in options:
            tests.append(lambda n, own=options["contains"]: own in n)
        if "prefix" in options:
            tests.append(lambda n, own=options["prefix"]: n.startswith(own))
        self.tests = tests

    def partitions(self):
        if self.mode == "tensors":
            return [_Part([p]) for p in self.paths]
        out = []
        with ThreadPoolExecutor(16) as pool:
            for rows in pool.map(tensor_rows, self.paths):
                for t in rows:
                    if t[5] and t[8] and all(test(t[3]) for test in self.tests):
                        per, width = BLOCKS[t[5]]
                        step = max(SPAN, TASK // width * per // SPAN * SPAN)
                        out += [_Part([t[0]], t, at, min(at + step, t[8])) for at in range(0, t[8], step)]
        return out or [_Part([])]

    def read(self, partition):
        if self.mode == "tensors":
            for path in partition.paths:
                yield from (t for t in tensor_rows(path) if all(test(t[3]) for test in self.tests))
            return
        if partition.row is None:
            return
        path, _, pos, name, _, dtype, _, _, _, _, offset, _, _, _, size, changed = partition.row
        per, width = BLOCKS[dtype]
        files = Payload()
        for at in range(partition.start, partition.end, JOB):
            n = min(JOB, partition.end - at)
            raw = files.raw(path, dtype, offset, size, changed, at, n)
            firsts = np.arange(0, n, CHUNK)
            many = np.minimum(CHUNK, n - firsts)
            k = len(firsts)
            cells = [raw[a // per * width : (a + m) // per * width] for a, m in zip(firsts.tolist(), many.tolist(), strict=True)]
            columns = [pa.array([path] * k), pa.array(np.full(k, pos, np.int32)), pa.array([name] * k), pa.array(np.full(k, at // JOB)), pa.array((firsts + at) // CHUNK), pa.array(firsts + at), pa.array(many.astype(np.int32)), pa.array([dtype] * k), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "tensor_pos", "name", "job_id", "chunk_id", "elem_start", "n", "dtype", "raw"])
        files.close()


class TensorFileSource(DataSource):
    """spark.read.format("tensorfile").option("path", "a,b").option("mode", "tensors" or "chunks").option("contains", part of a name)."""

    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def schema(self) -> str:
        return TENSORS if self.options.get("mode", "tensors") == "tensors" else "path string, tensor_pos int, name string, job_id long, chunk_id long, elem_start long, n int, dtype string, raw binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TensorFileSource)
