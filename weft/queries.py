"""Registered queries over the driver's tables, with their SQL.

Embeddings are one F32 tensor per label, rows by vec_id; planted() puts the same faults into them everywhere:
a zero row where vec_id % 97 = 0, a NaN at position 3 where vec_id % 101 = 5, an infinity at position 7 where vec_id % 113 = 9,
and 100-fold rows where vec_id % 89 = 1.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft import tables
from weft.functions import codecs
from weft.functions.codecs import bf16_value, f16_value
from weft.operators import diff, health, stats
from weft.sources import shards
from weft.sources.storage import opened
from weft.sources.tensors import metadata_value, scan_metadata, scan_tensors, type_totals

NAN, INF = float("nan"), float("inf")


def arrays(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/embeddings.parquet")
    return own.select(F.concat(F.lit("emb.label_"), F.col("label").cast("string")).alias("tensor"), F.col("vec_id").alias("row"), F.col("embedding").alias("x"))


def values(spark: SparkSession, d: str) -> DataFrame:
    return tables.exploded(arrays(spark, d))


def _changed(df: DataFrame, cell) -> DataFrame:
    """The arrays with cell(value, row, pos) for each value."""
    return df.withColumn("x", F.transform("x", lambda v, p: cell(v, F.col("row"), p).cast("float")))


def planted_arrays(spark: SparkSession, d: str) -> DataFrame:
    return _changed(arrays(spark, d), lambda v, r, p: F.when(r % 97 == 0, 0.0).when((r % 101 == 5) & (p == 3), NAN).when((r % 113 == 9) & (p == 7), INF).when(r % 89 == 1, v * 100).otherwise(v))


def planted(spark: SparkSession, d: str) -> DataFrame:
    return tables.exploded(planted_arrays(spark, d))


def _tuned(df: DataFrame) -> DataFrame:
    return _changed(df, lambda v, r, p: F.when((r % 3 == 0) & (p % 2 == 0), v + 0.0625).otherwise(v))


def tuned_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The planted values with every third row changed a little, and label 9 gone."""
    return _tuned(planted_arrays(spark, d).where("tensor <> 'emb.label_9'"))


def sick_arrays(spark: SparkSession, d: str) -> DataFrame:
    """A tensor of each 64 rows, with one fault of eight by its number: all zero, constant, sparse, a large value, one beyond F16, zero rows, a row 100-fold, a NaN."""
    own = arrays(spark, d).withColumn("tensor", F.concat(F.lit("emb."), F.floor(F.col("row") / 64).cast("string")))
    kind, r = F.floor(F.col("row") / 64) % 8, F.col("row") % 64
    return _changed(own, lambda v, _, p: F.when(kind == 0, 0.0).when(kind == 1, 1.0).when((kind == 2) & (p % 4 != 0), 0.0).when((kind == 3) & (r == 5) & (p == 0), 20000.0).when((kind == 4) & (r == 5) & (p == 1), 100000.0).when((kind == 5) & (r % 16 == 3), 0.0).when((kind == 6) & (r == 9), v * 100).when((kind == 7) & (r == 1) & (p == 3), NAN).otherwise(v))


RELAXED = health.Thresholds(max_abs=5e4, max_zero_fraction=0.8, max_dead_row_fraction=0.2, row_norm_ratio=1000.0)


_VALUES = "v AS (SELECT 'emb.label_' || label AS tensor, vec_id AS row, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)"
_PLANTED = _VALUES + ", p AS (SELECT tensor, row, pos, (CASE WHEN row % 97 = 0 THEN 0 WHEN row % 101 = 5 AND pos = 3 THEN 'nan'::FLOAT WHEN row % 113 = 9 AND pos = 7 THEN 'inf'::FLOAT WHEN row % 89 = 1 THEN x * 100::FLOAT ELSE x END)::FLOAT AS x FROM v)"
_TUNED = _PLANTED + ", t AS (SELECT tensor, row, pos, (CASE WHEN row % 3 = 0 AND pos % 2 = 0 THEN x::DOUBLE + 0.0625::DOUBLE ELSE x END)::FLOAT AS x FROM p WHERE tensor <> 'emb.label_9')"
_SUMMARY = "count(*)::BIGINT AS count, count(*) FILTER (isfinite(x))::BIGINT AS finite, count(*) FILTER (isnan(x))::BIGINT AS nan, count(*) FILTER (isinf(x))::BIGINT AS inf, count(*) FILTER (x = 0)::BIGINT AS zeros, min(x) FILTER (isfinite(x)) AS min, max(x) FILTER (isfinite(x)) AS max, round(avg(x::DOUBLE) FILTER (isfinite(x)), 6) AS mean, round(stddev_pop(x::DOUBLE) FILTER (isfinite(x)), 6) AS std"


def _shown() -> list:
    return ["count", "finite", "nan", "inf", "zeros", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")]


def stats_per_tensor(spark, d):
    return tables.summary(values(spark, d), "tensor").select("tensor", *_shown())


def stats_total_row(spark, d):
    return tables.summary(values(spark, d)).select(*_shown())


def stats_nonfinite(spark, d):
    return tables.summary(planted(spark, d), "tensor").select("tensor", *_shown())


def stats_name_filter(spark, d):
    return tables.summary(values(spark, d).where(F.col("tensor").contains("label_1")), "tensor").select("tensor", *_shown())


def stats_derived(spark, d):
    return tables.summary(planted(spark, d), "tensor").select("tensor", F.round("rms", 6).alias("rms"), F.round("l2_norm", 4).alias("l2_norm"), "abs_max", F.round("zero_fraction", 9).alias("zero_fraction"))


def histogram_16(spark, d):
    return tables.histogram(planted(spark, d), 16)


def histogram_constant(spark, d):
    return tables.histogram(values(spark, d).withColumn("x", F.lit(2.0).cast("float")), 3)


def row_norms(spark, d):
    return tables.rows(planted_arrays(spark, d)).select("tensor", "row", "dead", F.round("norm", 5).alias("norm"))


def row_outliers(spark, d):
    return health.row_summary(tables.rows(planted_arrays(spark, d)), ["tensor"], 10.0).select("tensor", "n_rows", F.col("n_dead").cast("long").alias("n_dead"), F.round("median", 6).alias("median"), F.col("n_out").cast("long").alias("n_out"))


def health_findings(spark, d):
    return health.findings(tables.checked(planted_arrays(spark, d))).select("tensor", "ord", "check", "severity")


def health_counts(spark, d):
    return health.counts(health_findings(spark, d))


def decode_f16_all(spark, d):
    return spark.range(65536).select(F.col("id").alias("bits"), f16_value(F.col("id")).alias("value"))


def decode_bf16_all(spark, d):
    return spark.range(65536).select(F.col("id").alias("bits"), bf16_value(F.col("id")).alias("value"))


def _encoded(kind: str, bits, rounded):
    def query(spark, d):
        return planted(spark, d).select("tensor", "row", F.col("pos").cast("long").alias("pos"), bits(F.col("x")).alias("bits"), rounded(F.col("x")).alias("value"))

    query.__name__ = f"encode_{kind}_roundtrip"
    return query


def _dequantized(dtype: str):
    """1,000 blocks of bytes by a rule, decoded as a file's would be."""

    def query(spark, d):
        def run(batches):
            for batch in batches:
                n = batch.column("id").to_numpy()
                scale = (n * 37 % 31744 + 32768 * (n % 2)).astype("<u2")
                many = 32 if dtype == "Q8_0" else 16
                codes = ((n[:, None] * 31 + np.arange(many) * 17) % 256).astype(np.int64)
                own = (codes - 128).astype(np.int8).view(np.uint8) if dtype == "Q8_0" else codes.astype(np.uint8)
                raw = np.concatenate([scale.view(np.uint8).reshape(-1, 2), own], axis=1).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(n, 32)), pa.array(np.tile(np.arange(32), len(n))), pa.array(codecs.decode(dtype, raw), from_pandas=False)], names=["block", "pos", "value"])

        return spark.range(1000).mapInArrow(run, "block long, pos long, value float")

    query.__name__ = f"dequant_{dtype.lower()}"
    return query


def _error(kind: str):
    def query(spark, d):
        own = tables.quantized(planted_arrays(spark, d), kind)
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        fine = tables.finite(F.col("x")) & tables.finite(F.col("y"))
        on = lambda v: F.when(fine, v)
        return own.groupBy("tensor").agg(F.sum("code").alias("codes"), F.count_if(~fine).alias("nonfinite"), F.round(F.max(on(F.abs(x - y))), 8).alias("max_error"), F.round(F.sqrt(F.sum(on((x - y) * (x - y))) / F.sum(on(x * x))), 8).alias("rel_l2"))

    query.__name__ = f"quant_{kind.lower()}_error"
    return query


def _metrics(got: DataFrame, *by) -> DataFrame:
    return got.select(*by, "elements", "equal", "finite_pairs", "nonfinite_mismatch", F.round("max_abs_diff", 6).alias("max_abs_diff"), F.round("changed_fraction", 9).alias("changed_fraction"), F.round("mean_abs", 7).alias("mean_abs"), F.round("rmse", 7).alias("rmse"), F.round("rel_l2", 7).alias("rel_l2"), F.round("cosine", 7).alias("cosine"), "identical")


def diff_metrics(spark, d):
    return _metrics(diff.metrics(tables.pairs(planted_arrays(spark, d), tuned_arrays(spark, d))), "tensor")


def diff_overall(spark, d):
    return _metrics(diff.metrics(tables.pairs(planted_arrays(spark, d), tuned_arrays(spark, d)).agg(*tables.merged())))


def diff_top_k(spark, d):
    got = diff.metrics(tables.pairs(planted_arrays(spark, d), tuned_arrays(spark, d))).where("not identical").orderBy(F.desc(F.round("rel_l2", 9)), "tensor").limit(3)
    return got.select("tensor", F.round("rel_l2", 7).alias("rel_l2"))


def _heads(df: DataFrame, prefix: str = "") -> DataFrame:
    """Header rows of table tensors."""
    own = df.groupBy("tensor").agg(F.countDistinct("row").alias("rows"), F.count("*").alias("elements"))
    return own.select(F.concat(F.lit(prefix), F.col("tensor")).alias("name"), F.array("rows", F.floor(F.col("elements") / F.col("rows"))).alias("shape"), F.lit("F32").alias("dtype"))


def diff_categories(spark, d):
    a = _heads(values(spark, d).where("tensor <> 'emb.label_0'"), "model.")
    b = _heads(values(spark, d).where("tensor <> 'emb.label_9' and not (tensor = 'emb.label_3' and row % 2 = 0)"))
    got = diff.matched(a, b, ("model.",))
    return got.groupBy("outcome").agg(F.count("*").alias("n"), F.min("norm").alias("first"), F.max("norm").alias("last"))


def layout_cursor(spark, d):
    """Where each tensor of a file of one tensor per label begins: the bytes of those before it, in the order of names."""
    heads = _heads(values(spark, d)).withColumn("byte_len", F.aggregate("shape", F.lit(4).cast("long"), lambda acc, n: acc * n))
    at = F.sum("byte_len").over(Window.partitionBy("path").orderBy("name").rowsBetween(Window.unboundedPreceding, -1))
    return heads.withColumn("path", F.lit("one file")).select("name", "byte_len", F.coalesce(at, F.lit(0)).alias("data_offset"))


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for a query's files; it goes when the driver ends. Only local mode can do without spark.checkpoint.dir."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{(base or '/tmp/checkpoints').rstrip('/')}/weft-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{path.toString()}/model"


def _file_stats(kind: str, dtype: str):
    """Write the embeddings as a sharded model, read it back by headers and ranges, and summarize all of it."""

    def query(spark, d):
        own = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("embedding").alias("values"))
        written = shards.write_shards(own, _folder(spark), kind, dtype)
        sums = stats.summaries(scan_tensors.from_paths(written))
        got = sums.agg(F.sum("count").alias("count"), F.sum("finite").alias("finite"), F.sum("zeros").alias("zeros"), F.min("min").alias("min"), F.max("max").alias("max"), F.round(F.sum(F.col("mean") * F.col("finite")) / F.sum("finite"), 6).alias("mean"), F.sum("byte_len").alias("byte_len"))
        return got

    query.__name__ = f"{kind}_{dtype.lower()}_stats"
    return query


def _model(spark, rows: DataFrame, kind: str = "safetensors", dtype: str = "F32") -> DataFrame:
    """The paths of a model with a file and tensor `emb.n` for each 64 rows of arrays."""
    own = rows.select(F.floor(F.col("row") / 64).alias("shard"), F.col("row").alias("at"), F.col("x").alias("values"))
    return shards.write_numbered(own, _folder(spark), kind, dtype)


def _inspected(spark, d) -> DataFrame:
    own = [_model(spark, arrays(spark, d), *kind) for kind in (("safetensors", "F16"), ("gguf", "Q8_0"))]
    return scan_tensors.from_paths(own[0].union(own[1]))


def inspect_tensors(spark, d):
    return _inspected(spark, d).select("format", "name", "type_name", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "elements", "data_offset", "byte_len")


def inspect_type_totals(spark, d):
    return type_totals(_inspected(spark, d))


def inspect_metadata(spark, d):
    own = scan_metadata.from_paths(_model(spark, arrays(spark, d), "gguf", "F32"))
    number = metadata_value(own, "shard.number").select("path", F.col("value_repr").cast("long").alias("shard"))
    return own.join(number, "path").select("shard", F.col("pos").cast("long").alias("pos"), "key", "value_type", "value_repr")


def _compared(spark, d) -> DataFrame:
    a, b = (scan_tensors.from_paths(_model(spark, x)) for x in (planted_arrays(spark, d), _tuned(planted_arrays(spark, d))))
    return diff.compare(a, b)


def diff_files(spark, d):
    """The metrics of two sharded models, by the file engine."""
    return _metrics(_compared(spark, d), F.col("norm").alias("tensor"))


def diff_files_overall(spark, d):
    return _metrics(diff.overall(_compared(spark, d)))


def diff_files_top(spark, d):
    got = diff.top_changed(_compared(spark, d), 3)
    return got.select(F.col("norm").alias("tensor"), F.round("rel_l2", 7).alias("rel_l2"))


_FINDING = ("tensor", "ord", "check", "severity")


def health_all_rules(spark, d):
    return health.findings(tables.checked(sick_arrays(spark, d))).select(*_FINDING)


def health_relaxed(spark, d):
    return health.findings(tables.checked(sick_arrays(spark, d), RELAXED), RELAXED).select(*_FINDING)


def health_strict_status(spark, d):
    return health.status(health_all_rules(spark, d))


def health_files(spark, d):
    """The findings of a sharded model, by the file engine."""
    sums = stats.summaries(scan_tensors.from_paths(_model(spark, sick_arrays(spark, d))))
    return health.check(sums).select(F.col("name").alias("tensor"), "ord", "check", "severity")


def stats_files(spark, d):
    """The summaries of a sharded model with every fault, by the file engine."""
    sums = stats.summaries(scan_tensors.from_paths(_model(spark, sick_arrays(spark, d))))
    return sums.select(F.col("name").alias("tensor"), *_shown())


def histogram_files(spark, d):
    sums = stats.summaries(scan_tensors.from_paths(_model(spark, sick_arrays(spark, d))))
    return stats.histograms(sums, 16).select(F.col("name").alias("tensor"), "bin", "count")


def dump_values(spark, d):
    """Decoded values as raw files with a manifest, read back: what each tensor's parts hold, each row at its place among the 64 of its shard, of which some may be missing."""
    own = planted_arrays(spark, d)
    manifest = shards.dump(scan_tensors.from_paths(_model(spark, own, "gguf", "F16")), _folder(spark))
    places = own.groupBy(F.concat(F.lit("emb."), F.floor(F.col("row") / 64).cast("string")).alias("name")).agg(F.sort_array(F.collect_list(F.col("row") % 64)).alias("places"))

    def run(batches):
        for batch in batches:
            for name, parts, rows in zip(*[batch.column(c).to_pylist() for c in ("name", "parts", "places")], strict=True):
                x = np.concatenate([np.frombuffer(_bytes(p["file"]), "<f4") for p in parts])
                at = np.array(rows)[:, None] * 64 + np.arange(len(x) // len(rows))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(at.reshape(-1)), pa.array(x, from_pandas=False)], names=["tensor", "at", "value"])

    dumped = manifest.where("decoded").select("name", "parts").join(places, "name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return dumped.mapInArrow(run, "tensor string, at long, value float")


def _bytes(path: str) -> bytes:
    files, inner = opened(path)
    with files.open_input_file(inner) as f:
        return f.readall()


_BIN = "CASE WHEN hi > lo THEN least(floor((x::DOUBLE - lo) / (hi::DOUBLE - lo) * {n}), {m}) ELSE 0 END::BIGINT"
_HIST = "r AS (SELECT tensor, min(x) AS lo, max(x) AS hi FROM {src} WHERE isfinite(x) GROUP BY 1), c AS (SELECT tensor, {bin} AS bin, count(*) AS n FROM {src} JOIN r USING (tensor) WHERE isfinite(x) GROUP BY ALL) SELECT tensor, k AS bin, coalesce(n, 0)::BIGINT AS count FROM (SELECT tensor, unnest(range({n})) AS k FROM r) e LEFT JOIN c USING (tensor) WHERE TRUE"
_ROWS = "rn AS (SELECT tensor, row, count(*) FILTER (x = 0) = count(*) AS dead, coalesce(sqrt(sum(x::DOUBLE * x::DOUBLE) FILTER (isfinite(x))), 0) AS norm FROM p GROUP BY 1, 2)"
_MED = _ROWS + ", md AS (SELECT tensor, count(*)::BIGINT AS n_rows, count(*) FILTER (dead)::BIGINT AS n_dead, count(*) FILTER (NOT dead) AS n_live, median(norm) FILTER (NOT dead) AS med FROM rn GROUP BY 1), ro AS (SELECT tensor, n_rows, n_dead, med, count(*) FILTER (NOT dead AND n_live >= 2 AND med > 0 AND (norm < med / 10 OR norm > med * 10))::BIGINT AS n_out FROM rn JOIN md USING (tensor) GROUP BY ALL)"


def _find(t: health.Thresholds = health.Thresholds()) -> str:
    med = _MED.replace("med / 10 ", f"med / {t.row_norm_ratio} ").replace("med * 10)", f"med * {t.row_norm_ratio})")
    return med + f", s AS (SELECT tensor, {_SUMMARY}, greatest(abs(min(x) FILTER (isfinite(x))), abs(max(x) FILTER (isfinite(x)))) AS abs_max FROM p GROUP BY 1), j AS (SELECT * FROM s JOIN ro USING (tensor))" + f""", f AS (
  SELECT tensor, 1 AS ord, 'non-finite' AS "check", 'ERROR' AS severity FROM j WHERE nan + inf > 0
  UNION ALL SELECT tensor, 2, CASE WHEN zeros = count THEN 'all-zero' WHEN finite = count AND count > 1 AND min = max THEN 'constant' ELSE 'sparse' END, 'WARN' FROM j WHERE zeros = count OR (finite = count AND count > 1 AND min = max) OR zeros / count > {t.max_zero_fraction}
  UNION ALL SELECT tensor, 3, 'large-magnitude', 'WARN' FROM j WHERE abs_max > {t.max_abs} UNION ALL SELECT tensor, 4, 'f16-range', 'INFO' FROM j WHERE abs_max > 65504
  UNION ALL SELECT tensor, 5, 'dead-rows', CASE WHEN n_dead / n_rows > {t.max_dead_row_fraction} THEN 'WARN' ELSE 'INFO' END FROM j WHERE n_dead > 0 AND n_dead < n_rows
  UNION ALL SELECT tensor, 6, 'row-norm', 'WARN' FROM j WHERE n_out > 0)"""


_FIND = _find()
_HALF = "SELECT i AS bits, (CASE WHEN e = {top} AND m = 0 THEN s * 'inf'::DOUBLE WHEN e = {top} THEN 'nan'::DOUBLE WHEN e = 0 THEN s * m * pow(2::DOUBLE, {sub}) ELSE s * (1 + m / {one}::DOUBLE) * pow(2::DOUBLE, e - {bias}) END)::FLOAT AS value FROM (SELECT i, CASE WHEN i & 32768 <> 0 THEN -1::DOUBLE ELSE 1::DOUBLE END AS s, (i >> {bits}) & {top} AS e, i & ({one} - 1) AS m FROM range(65536) t(i))"
_STEP = "pow(2::DOUBLE, greatest(floor(log2(CASE WHEN {s} > 0 AND isfinite({s}) THEN {s} ELSE 1 END)), {least}) - {digits})"
_NEAR = "(CASE WHEN NOT isfinite({x}) OR {x} = 0 THEN {x}::DOUBLE ELSE sign({x}) * (CASE WHEN round_even({s} / {step}, 0) * {step} > {most} THEN 'inf'::DOUBLE ELSE round_even({s} / {step}, 0) * {step} END) END)::FLOAT"


def _rounded(x: str, digits: int, least: int, most: float) -> str:
    """A number of fewer binary digits next to x, ties to even."""
    s = f"abs({x}::DOUBLE)"
    return _NEAR.format(x=x, s=s, most=repr(most), step=_STEP.format(s=s, least=least, digits=digits))


_F16, _BF16 = (10, -14, 65504.0), (7, -126, 3.3895313892515355e38)


def _encode_sql(digits: int, least: int, most: float) -> str:
    one, bias, top = 1 << digits, 1 - least, 2 * (1 - least) + 1
    power = "floor(log2(CASE WHEN r > 0 AND isfinite(r) THEN r ELSE 1 END))"
    bits = f"CASE WHEN isnan(x) THEN {top * one + one // 2} WHEN isinf(r) THEN {top * one} WHEN r = 0 THEN 0 WHEN {power} < {least} THEN round(r / pow(2::DOUBLE, {least - digits})) ELSE ({power} + {bias}) * {one} + round((r / pow(2::DOUBLE, {power}) - 1) * {one}) END"
    return f"WITH {_PLANTED}, y AS (SELECT *, {_rounded('x', digits, least, most)} AS value FROM p), z AS (SELECT *, abs(value::DOUBLE) AS r FROM y) SELECT tensor, row, pos, ({bits})::BIGINT + CASE WHEN x < 0 THEN {(top + 1) * one} ELSE 0 END AS bits, value FROM z"


_BLOCKS = "b AS (SELECT *, {d} AS d FROM {src}), i AS (SELECT *, (CASE WHEN d = 0 THEN 0 ELSE 1 / d::DOUBLE END)::FLOAT AS inv, {near} AS sc FROM b), w AS (SELECT *, (x * inv)::FLOAT AS z FROM i), c AS (SELECT *, {code} AS code FROM w), y AS (SELECT *, ({back} * sc)::FLOAT AS y FROM c)"
_W = "OVER (PARTITION BY tensor, row, pos // 32)"


def _blocks(kind: str, src: str) -> str:
    if kind == "Q8_0":
        d, code, back = f"(coalesce(max(abs(x)) FILTER (NOT isnan(x)) {_W}, 0)::DOUBLE / 127)::FLOAT", "(CASE WHEN isnan(z) THEN 0 ELSE least(greatest(sign(z) * floor(abs(z::DOUBLE) + 0.5), -128), 127) END)::BIGINT", "code::FLOAT"
    else:
        d, code, back = f"(arg_max(x, {{'a': abs(x), 'p': -pos}}) FILTER (NOT isnan(x)) {_W}::DOUBLE / -8)::FLOAT", "(CASE WHEN isnan(z) THEN 0 ELSE least(floor((z + 8.5::FLOAT)::FLOAT), 15) END)::BIGINT", "(code - 8)::FLOAT"
    return _BLOCKS.format(d=d, src=src, near=_rounded("d", *_F16), code=code, back=back)


def _error_sql(kind: str) -> str:
    fine = "FILTER (isfinite(x) AND isfinite(y))"
    return f"WITH {_PLANTED}, {_blocks(kind, 'p')} SELECT tensor, sum(code)::BIGINT AS codes, count(*) FILTER (NOT (isfinite(x) AND isfinite(y)))::BIGINT AS nonfinite, round(max(abs(x::DOUBLE - y::DOUBLE)) {fine}, 8) AS max_error, round(sqrt(sum((x::DOUBLE - y) * (x::DOUBLE - y)) {fine} / sum(x::DOUBLE * x) {fine}), 8) AS rel_l2 FROM y GROUP BY 1"


def _dequant_sql(kind: str) -> str:
    byte = "((id * 31 + {j} * 17) % 256)"
    code = byte.format(j="pos") + " - 128" if kind == "Q8_0" else f"(CASE WHEN pos < 16 THEN {byte.format(j='pos')} & 15 ELSE {byte.format(j='(pos - 16)')} >> 4 END) - 8"
    half = "CASE WHEN e = 0 THEN s * m * pow(2::DOUBLE, -24) ELSE s * (1 + m / 1024::DOUBLE) * pow(2::DOUBLE, e - 15) END"
    return f"WITH h AS (SELECT id, CASE WHEN id % 2 = 1 THEN -1::DOUBLE ELSE 1::DOUBLE END AS s, ((id * 37 % 31744) >> 10) AS e, (id * 37 % 31744) & 1023 AS m FROM range(1000) t(id)), d AS (SELECT id, ({half})::FLOAT AS d FROM h) SELECT id AS block, pos, (({code})::FLOAT * d)::FLOAT AS value FROM d, range(32) u(pos)"


_SICK = _VALUES + """, q AS (SELECT 'emb.' || (row // 64) AS tensor, row, pos, x, (row // 64) % 8 AS kind, row % 64 AS r FROM v), p AS (SELECT tensor, row, pos, (CASE WHEN kind = 0 THEN 0 WHEN kind = 1 THEN 1 WHEN kind = 2 AND pos % 4 <> 0 THEN 0 WHEN kind = 3 AND r = 5 AND pos = 0 THEN 20000
  WHEN kind = 4 AND r = 5 AND pos = 1 THEN 100000 WHEN kind = 5 AND r % 16 = 3 THEN 0 WHEN kind = 6 AND r = 9 THEN x * 100::FLOAT WHEN kind = 7 AND r = 1 AND pos = 3 THEN 'nan'::FLOAT ELSE x END)::FLOAT AS x FROM q)"""
_ZIPPED = ", z AS (SELECT tensor, p.x::DOUBLE AS x, t.x::DOUBLE AS y, isfinite(p.x) AND isfinite(t.x) AS fine FROM p JOIN t USING (tensor, row, pos))"
_SUMS = ", m AS (SELECT tensor, count(*)::BIGINT AS elements, count(*) FILTER (x = y)::BIGINT AS equal, count(*) FILTER (fine)::BIGINT AS finite_pairs, count(*) FILTER (NOT fine AND x <> y)::BIGINT AS nonfinite_mismatch, max(abs(x - y)) FILTER (fine) AS mx, sum(abs(x - y)) FILTER (fine) AS sa, sum((x - y) * (x - y)) FILTER (fine) AS sq, sum(x * x) FILTER (fine) AS aa, sum(y * y) FILTER (fine) AS bb, sum(x * y) FILTER (fine) AS ab FROM z GROUP BY 1)"
_PAIR = _TUNED + _ZIPPED + _SUMS
_SHARDED = _PLANTED.replace("p AS (SELECT tensor, row", "p AS (SELECT 'emb.' || (row // 64) AS tensor, row")
_SHARDED_PAIR = _SHARDED + _TUNED[len(_PLANTED) :].replace(" WHERE tensor <> 'emb.label_9'", "") + _ZIPPED + _SUMS
_METRICS = "elements, equal, finite_pairs, nonfinite_mismatch, round(mx, 6) AS max_abs_diff, round(1 - equal / elements, 9) AS changed_fraction, round(sa / finite_pairs, 7) AS mean_abs, round(sqrt(sq / finite_pairs), 7) AS rmse, round(sqrt(sq / aa), 7) AS rel_l2, round(ab / sqrt(aa * bb), 7) AS cosine, equal = elements AS identical"
_ALL = ", m1 AS (SELECT sum(elements)::BIGINT AS elements, sum(equal)::BIGINT AS equal, sum(finite_pairs)::BIGINT AS finite_pairs, sum(nonfinite_mismatch)::BIGINT AS nonfinite_mismatch, max(mx) AS mx, sum(sa) AS sa, sum(sq) AS sq, sum(aa) AS aa, sum(bb) AS bb, sum(ab) AS ab FROM m)"
_MODEL = "t AS (SELECT vec_id // 64 AS shard, vec_id AS place, len(embedding) AS width FROM embeddings), k AS (SELECT shard, count(*) AS n, max(width) AS width, list(place ORDER BY place)[:10] AS firsts FROM t GROUP BY 1)"
_INSPECT = f"WITH {_MODEL}, i AS (SELECT 'safetensors' AS format, 'emb.' || shard AS name, 'F16' AS type_name, n || 'x' || width AS shape, (n * width)::BIGINT AS elements, 0::BIGINT AS data_offset, (2 * n * width)::BIGINT AS byte_len FROM k UNION ALL SELECT 'GGUF', 'emb.' || shard, 'Q8_0', n || 'x' || width, n * width, 0, n * width // 32 * 34 FROM k)"
_KEYS = """ SELECT shard, 0::BIGINT AS pos, 'general.name' AS key, 'string' AS value_type, '"emb"' AS value_repr FROM k UNION ALL SELECT shard, 1, 'shard.number', 'u32', shard::VARCHAR FROM k UNION ALL SELECT shard, 2, 'shard.rows', 'u64', n::VARCHAR FROM k UNION ALL SELECT shard, 3, 'shard.whole', 'bool', 'true' FROM k
  UNION ALL SELECT shard, 4, 'shard.first', 'array', '[i64 x ' || len(firsts) || '] [' || array_to_string(firsts[:8], ', ') || CASE WHEN len(firsts) > 8 THEN ', ...' ELSE '' END || ']' FROM k"""
_OF_FILE = "SELECT count(*)::BIGINT AS count, count(*)::BIGINT AS finite, count(*) FILTER (y = 0)::BIGINT AS zeros, min(y) AS min, max(y) AS max, round(avg(y::DOUBLE), 6) AS mean, {size}::BIGINT AS byte_len FROM y"
_FILE = "WITH e AS (SELECT unnest(embedding) AS x FROM embeddings) SELECT count(*)::BIGINT AS count, count(*)::BIGINT AS finite, count(*) FILTER (x = 0)::BIGINT AS zeros, min(x) AS min, max(x) AS max, round(avg(x::DOUBLE), 6) AS mean, (4 * count(*))::BIGINT AS byte_len FROM e"

_ENCODED = (_encoded("f16", codecs.f16_bits, codecs.f16_rounded), _encoded("bf16", codecs.bf16_bits, codecs.bf16_rounded))
_FILES = (_file_stats("safetensors", "F32"), _file_stats("gguf", "F32"), _file_stats("safetensors", "BF16"), _file_stats("gguf", "Q8_0"))
_STATS = (stats_per_tensor, stats_total_row, stats_nonfinite, stats_name_filter, stats_derived, histogram_16, histogram_constant, row_norms, row_outliers, stats_files, histogram_files)
_HEALTH = (health_findings, health_counts, health_all_rules, health_relaxed, health_strict_status, health_files)
_CODECS = (decode_f16_all, decode_bf16_all, *_ENCODED, _dequantized("Q8_0"), _dequantized("Q4_0"), _error("Q8_0"), _error("Q4_0"))
_DIFF = (diff_metrics, diff_overall, diff_top_k, diff_categories, diff_files, diff_files_overall, diff_files_top)
_INSPECTED = (inspect_tensors, inspect_type_totals, inspect_metadata, layout_cursor, dump_values)
QUERIES = {f.__name__: f for f in (*_STATS, *_HEALTH, *_CODECS, *_DIFF, *_INSPECTED, *_FILES)}


def _histogram_sql(ctes: str, src: str, n: int) -> str:
    body = _HIST.format(src=src, bin=_BIN.format(n=n, m=n - 1), n=n).replace("e LEFT JOIN c USING (tensor) WHERE TRUE", "e LEFT JOIN c ON c.tensor = e.tensor AND c.bin = e.k").replace("SELECT tensor, k AS bin", "SELECT e.tensor, k AS bin")
    return f"WITH {ctes}, {body}"



SQL = {
    "stats_per_tensor": f"WITH {_VALUES} SELECT tensor, {_SUMMARY} FROM v GROUP BY 1",
    "stats_total_row": f"WITH {_VALUES} SELECT {_SUMMARY} FROM v",
    "stats_nonfinite": f"WITH {_PLANTED} SELECT tensor, {_SUMMARY} FROM p GROUP BY 1",
    "stats_name_filter": f"WITH {_VALUES} SELECT tensor, {_SUMMARY} FROM v WHERE contains(tensor, 'label_1') GROUP BY 1",
    "stats_derived": f"WITH {_PLANTED} SELECT tensor, round(sqrt(avg(x::DOUBLE * x) FILTER (isfinite(x))), 6) AS rms, round(sqrt(sum(x::DOUBLE * x) FILTER (isfinite(x))), 4) AS l2_norm, greatest(abs(min(x) FILTER (isfinite(x))), abs(max(x) FILTER (isfinite(x)))) AS abs_max, round(count(*) FILTER (x = 0) / count(*), 9) AS zero_fraction FROM p GROUP BY 1",
    "histogram_16": f"WITH {_PLANTED}, " + _HIST.format(src="p", bin=_BIN.format(n=16, m=15), n=16).replace("e LEFT JOIN c USING (tensor) WHERE TRUE", "e LEFT JOIN c ON c.tensor = e.tensor AND c.bin = e.k").replace("SELECT tensor, k AS bin", "SELECT e.tensor, k AS bin"),
    "histogram_constant": f"WITH {_VALUES}, q AS (SELECT tensor, 2::FLOAT AS x FROM v), " + _HIST.format(src="q", bin=_BIN.format(n=3, m=2), n=3).replace("e LEFT JOIN c USING (tensor) WHERE TRUE", "e LEFT JOIN c ON c.tensor = e.tensor AND c.bin = e.k").replace("SELECT tensor, k AS bin", "SELECT e.tensor, k AS bin"),
    "row_norms": f"WITH {_PLANTED}, {_ROWS} SELECT tensor, row, dead, round(norm, 5) AS norm FROM rn",
    "row_outliers": f"WITH {_PLANTED}, {_MED} SELECT tensor, n_rows, n_dead, round(med, 6) AS median, n_out FROM ro",
    "health_findings": f'WITH {_PLANTED}, {_FIND} SELECT tensor, ord, "check", severity FROM f',
    "health_counts": f"WITH {_PLANTED}, {_FIND} SELECT severity, count(ord)::BIGINT AS n FROM (SELECT unnest(['INFO', 'WARN', 'ERROR']) AS severity) LEFT JOIN f USING (severity) GROUP BY 1",
    "decode_f16_all": _HALF.format(top=31, bits=10, one=1024, sub=-24, bias=15),
    "decode_bf16_all": _HALF.format(top=255, bits=7, one=128, sub=-133, bias=127),
    "quant_q8_0_error": _error_sql("Q8_0"),
    "quant_q4_0_error": _error_sql("Q4_0"),
    "encode_f16_roundtrip": _encode_sql(*_F16),
    "encode_bf16_roundtrip": _encode_sql(*_BF16),
    "dequant_q8_0": _dequant_sql("Q8_0"),
    "dequant_q4_0": _dequant_sql("Q4_0"),
    "health_all_rules": f'WITH {_SICK}, {_FIND} SELECT tensor, ord, "check", severity FROM f',
    "health_relaxed": f'WITH {_SICK}, {_find(RELAXED)} SELECT tensor, ord, "check", severity FROM f',
    "health_files": f'WITH {_SICK}, {_FIND} SELECT tensor, ord, "check", severity FROM f',
    "health_strict_status": f"WITH {_SICK}, {_FIND}, n AS (SELECT count(*) FILTER (severity = 'ERROR')::BIGINT AS errors, count(*) FILTER (severity = 'WARN')::BIGINT AS warnings, count(*) FILTER (severity = 'INFO')::BIGINT AS infos FROM f) SELECT *, (CASE WHEN errors > 0 THEN 2 ELSE 0 END)::BIGINT AS status, (CASE WHEN errors + warnings > 0 THEN 2 ELSE 0 END)::BIGINT AS strict_status FROM n",
    "stats_files": f"WITH {_SICK} SELECT tensor, {_SUMMARY.replace('round(avg(x::DOUBLE) FILTER (isfinite(x)), 6)', 'coalesce(round(avg(x::DOUBLE) FILTER (isfinite(x)), 6), 0)')} FROM p GROUP BY 1",
    "histogram_files": _histogram_sql(_SICK, "p", 16),
    "diff_overall": f"WITH {_PAIR}{_ALL} SELECT {_METRICS} FROM m1",
    "diff_files": f"WITH {_SHARDED_PAIR} SELECT tensor, {_METRICS} FROM m",
    "diff_files_overall": f"WITH {_SHARDED_PAIR}{_ALL} SELECT {_METRICS} FROM m1",
    "diff_files_top": f"WITH {_SHARDED_PAIR} SELECT tensor, round(sqrt(sq / aa), 7) AS rel_l2 FROM m WHERE equal <> elements ORDER BY sqrt(sq / aa) DESC, tensor LIMIT 3",
    "inspect_tensors": f"{_INSPECT} SELECT * FROM i",
    "inspect_type_totals": f"{_INSPECT} SELECT type_name, count(*)::BIGINT AS tensors, sum(elements)::BIGINT AS elements, sum(byte_len)::BIGINT AS bytes FROM i GROUP BY 1",
    "inspect_metadata": f"WITH {_MODEL}{_KEYS}",
    "dump_values": f"WITH {_SHARDED} SELECT tensor, (row % 64 * 64 + pos)::BIGINT AS at, {_rounded('x', *_F16)} AS value FROM p",
    "diff_metrics": f"WITH {_PAIR} SELECT tensor, elements, equal, finite_pairs, nonfinite_mismatch, round(mx, 6) AS max_abs_diff, round(1 - equal / elements, 9) AS changed_fraction, round(sa / finite_pairs, 7) AS mean_abs, round(sqrt(sq / finite_pairs), 7) AS rmse, round(sqrt(sq / aa), 7) AS rel_l2, round(ab / sqrt(aa * bb), 7) AS cosine, equal = elements AS identical FROM m",
    "diff_top_k": f"WITH {_PAIR} SELECT tensor, round(sqrt(sq / aa), 7) AS rel_l2 FROM m WHERE equal <> elements ORDER BY round(sqrt(sq / aa), 9) DESC, tensor LIMIT 3",
    "diff_categories": f"WITH {_VALUES}, a AS (SELECT tensor AS t, tensor AS norm, count(DISTINCT row) AS n FROM v WHERE tensor <> 'emb.label_0' GROUP BY 1), b AS (SELECT tensor AS t, tensor AS norm, count(DISTINCT row) AS n FROM v WHERE tensor <> 'emb.label_9' AND NOT (tensor = 'emb.label_3' AND row % 2 = 0) GROUP BY 1), j AS (SELECT coalesce(a.norm, b.norm) AS norm, CASE WHEN b.norm IS NULL THEN 'only_a' WHEN a.norm IS NULL THEN 'only_b' WHEN a.n <> b.n THEN 'shape_mismatch' ELSE 'compared' END AS outcome FROM a FULL JOIN b ON a.norm = b.norm) SELECT outcome, count(*)::BIGINT AS n, min(norm) AS first, max(norm) AS last FROM j GROUP BY 1",
    "layout_cursor": f"WITH {_VALUES}, h AS (SELECT tensor AS name, (4 * count(*))::BIGINT AS byte_len FROM v GROUP BY 1) SELECT name, byte_len, coalesce(sum(byte_len) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset FROM h",
    "safetensors_f32_stats": _FILE,
    "gguf_f32_stats": _FILE,
    "safetensors_bf16_stats": f"WITH {_VALUES}, y AS (SELECT {_rounded('x', *_BF16)} AS y FROM v) {_OF_FILE.format(size='(2 * count(*))')}",
    "gguf_q8_0_stats": f"WITH {_VALUES}, {_blocks('Q8_0', 'v')} {_OF_FILE.format(size='(count(*) // 32 * 34)')}",
}
