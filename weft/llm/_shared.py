"""What several operators of this subpackage use: the shared folder, materialized tables, places of rows, Arrow chunks, byte-level words."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Where tables go in local mode (driver and executors are one process there) if spark.checkpoint.dir is unset.
LOCAL_DIR = "/tmp/checkpoints"


def _hadoop(spark: SparkSession, folder: str):
    """A folder's Hadoop path and file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The URI of a new folder below spark.checkpoint.dir, which driver and executors share; it goes when the driver ends. Only local mode can do without the setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_DIR
    path, files = _hadoop(spark, f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}")
    files.mkdirs(path)
    files.deleteOnExit(path)
    return re.sub(r"^file:/(?!/)", "file:///", files.makeQualified(path).toString())


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/weft-" in f}:
            path, files = _hadoop(df.sparkSession, folder)
            files.delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def own(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with what an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def salts(n: int) -> Column:
    """One row for each of 0..n-1, as long."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


#: Rows of texts that pass between Spark and Python at once, and their bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches held to BATCH_ROWS rows and BATCH_BYTES bytes in its session: rows of whole texts are large, and each worker holds a batch or two."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the system: workers are kept and reused, and what they hold adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `most` bytes of text (one row at least), so that memory doesn't follow the batch size."""
    for batch in batches:
        size = np.diff(text_buffer(batch.column(text))[1])
        at = 0
        total = np.concatenate([[0], np.cumsum(size)])
        while at < batch.num_rows:
            end = max(at + 1, min(at + rows, int(np.searchsorted(total, total[at] + most, "right")) - 1))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def byte_table(gaps: list[tuple[int, int]]) -> np.ndarray:
    """A 256-entry mask of word bytes: all but the given inclusive ranges. Bytes of non-ASCII characters are all over 0x7F."""
    table = np.ones(256, bool)
    for low, high in gaps:
        table[low : high + 1] = False
    return table


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
SPACED, ALNUM = byte_table([(0x20, 0x20), (0x09, 0x0D)]), byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 19


def word_spans(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words; no word crosses a row."""
    inside = table[raw]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offs[:-1][offs[:-1] < len(raw)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer on 64 bits (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_MULT, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, m, np.uint64)])) for m in (_MULT, inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of raw[start:end], by differences of prefix sums; blocks of words bound the memory."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        power, inverse = _powers(max(high - low, _BLOCK))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of `width` words within a row, and the index of the first word of each."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = hashes[:n].copy()
    for k in range(1, width):
        acc = acc * np.uint64(_MULT) + hashes[k : k + n]
    keep = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(acc[keep] + np.uint64(width)), keep


def numbered(make, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run make(batch, first row number) over batches with row numbers that are unique over all partitions; stable once the table is written."""
    from pyspark import TaskContext

    at = (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0
    for batch in batches:
        yield make(batch, at)
        at += batch.num_rows


def _is_files(df: DataFrame) -> bool:
    """Whether df is Parquet files with columns and rows picked out of them, so that each row stands at a place of its own that another scan finds again."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return kind == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet"


def located(df: DataFrame) -> tuple[DataFrame, str, str]:
    """df with two longs more that say where a row stands, its file and its number in it, and their names. What isn't read from Parquet files alone is written first."""
    df = df if _is_files(df) else materialize(df)
    file, row, place = free_name(df, "_file"), free_name(df, "_row"), df.metadataColumn("_metadata")
    return df.select(*own(df), F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row)), file, row


#: Rows of a file whose places lie together, as a power of two, and places that lie in one part.
NEAR, PART = 20, 1 << 17


Found = tuple[pa.RecordBatch, np.ndarray, pa.Table | None]


class Places:
    """Rows to find again in a scan, by their places (two longs, file and row) and with columns of their own.

    They are written in parts, by file and runs of rows, and a task of the scan reads the parts of its own rows: neither the
    scanned rows nor a table of all places move, and memory doesn't grow with either. One place may have several entries."""

    def __init__(self, rows: DataFrame, file: str = "file", row: str = "row"):
        self.spark, self.names = rows.sparkSession, [c for c in rows.columns if c not in (file, row)] or ["row"]
        held = materialize(rows.withColumnsRenamed({file: "file", row: "row"}))
        self.parts = 1 + held.count() // PART
        self.folder = f"{shared_dir(self.spark)}/places"
        held.withColumn("part", self._part("file", "row")).repartition("part").write.partitionBy("part").parquet(self.folder)
        drop_shared(held)

    def drop(self) -> None:
        """Delete the files, when all that was found is written."""
        path, files = _hadoop(self.spark, self.folder)
        files.delete(path, True)

    def _part(self, file: str, row: str) -> Column:
        return F.pmod(F.xxhash64(F.col(file), F.shiftright(F.col(row), NEAR)), F.lit(self.parts)).cast("long")

    def find(self, scan: DataFrame, file: str, row: str, make: Callable[[Iterator[Found]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
        """make() over (rows, found, entries) of all batches of the scan: entries[k] is one of rows[found[k]], found in order; rows are without file and row."""
        part, folder, names = free_name(scan, "_part"), self.folder, self.names

        def load(number: int) -> tuple[np.ndarray, pa.Table]:
            files, base = fs.FileSystem.from_uri(folder)
            listed = files.get_file_info(fs.FileSelector(f"{base}/part={number}", allow_not_found=True))
            tables = [pq.read_table(f.path, filesystem=files, partitioning=None) for f in listed if f.path.endswith(".parquet")]
            if not tables:
                return np.zeros(0, np.uint64), None
            table = pa.concat_tables(tables)
            keys = _place(table.column("file").to_numpy(), table.column("row").to_numpy())
            order = np.argsort(keys, kind="stable")
            return keys[order], table.take(pa.array(order)).select(names).combine_chunks()

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[Found]:
            held: dict[int, tuple[np.ndarray, pa.Table]] = {}
            for batch in batches:
                keys, numbers = _place(batch.column(file).to_numpy(), batch.column(row).to_numpy()), batch.column(part).to_numpy()
                rows, entries = [np.zeros(0, np.int64)], []
                for number in np.unique(numbers).tolist():
                    if number not in held:
                        while len(held) >= 4:
                            held.pop(next(iter(held)))
                        held[number] = load(number)
                    known, table = held[number]
                    here = np.flatnonzero(numbers == number)
                    low, high = np.searchsorted(known, keys[here], "left"), np.searchsorted(known, keys[here], "right")
                    many = high - low
                    if many.any():
                        first = np.repeat(low - (np.cumsum(many) - many), many)
                        rows.append(np.repeat(here, many))
                        entries.append(table.take(pa.array(np.arange(many.sum()) + first)))
                found = np.concatenate(rows)
                order = np.argsort(found, kind="stable")
                table = pa.concat_tables(entries).take(pa.array(order)) if entries else None
                yield batch.select([n for n in batch.schema.names if n not in (file, row, part)]), found[order], table

        return scan.withColumn(part, self._part(f"`{file}`", f"`{row}`")).mapInArrow(lambda batches: make(looked_up(batches)), schema)


def each(make: Callable[..., pa.RecordBatch]) -> Callable[[Iterator[Found]], Iterator[pa.RecordBatch]]:
    return lambda triples: (make(*t) for t in triples)


def _place(file: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for a file's hash and a row's number."""
    return mix(file.view(np.uint64)) + row.view(np.uint64)


def without(df: DataFrame, file: str, row: str, gone: DataFrame) -> DataFrame:
    """The rows of a located table whose places are not in gone (columns file, row), without these two columns."""
    schema = StructType([f for f in df.schema.fields if f.name not in (file, row)])

    def rest(batch: pa.RecordBatch, found: np.ndarray, _: pa.Table) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, bool)
        keep[found] = False
        return batch.filter(pa.array(keep))

    return Places(gone).find(small_batches(df), file, row, each(rest), schema)
