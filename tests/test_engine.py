"""Parsers, codecs, summaries, health, diff and reports of tensor files."""

import json
import struct

import numpy as np
import pytest

from weft import cli, queries, tables
from weft.functions import codecs
from weft.operators import diff, health, stats
from weft.sources import headers, shards, tensors, writers


@pytest.fixture(scope="module")
def demo(tmp_path_factory):
    top = tmp_path_factory.mktemp("demo")
    for name, data in writers.demo_files().items():
        (top / name).write_bytes(data)
    return top


def st(text: str, payload: int = 0) -> bytes:
    return struct.pack("<Q", len(text)) + text.encode() + bytes(payload)


T = '{{"x":{{"dtype":"{}","shape":{},"data_offsets":{}}}}}'


@pytest.mark.parametrize(("data", "message"), [
    (b"short", "shorter than the 8-byte"),
    (struct.pack("<Q", 10**9) + b"{}", "100 MB safety limit"),
    (struct.pack("<Q", 50) + b"{}", "truncated JSON header"),
    (st("[1]"), "must begin with '{'"),
    (st('{"a":'), "invalid header JSON"),
    (st('{"a":{},"a":{}}'), "duplicate key"),
    (st('{"__metadata__":{"a":1}}'), "string-to-string"),
    (st('{"x":{"a":"b"}}'), "missing dtype, shape, or data_offsets"),
    (st(T.format("F4", "[1]", "[0,1]"), 1), "unsupported dtype"),
    (st(T.format("F32", "[18446744073709551615,2]", "[0,4]"), 4), "shape product overflow"),
    (st(T.format("F32", "[18446744073709551615]", "[0,4]"), 4), "byte size overflow"),
    (st(T.format("F32", "[1]", "[4,0]"), 4), "reversed offsets"),
    (st(T.format("F32", "[2]", "[0,4]"), 4), "require 8 bytes, offsets describe 4"),
    (st(T.format("F32", "[2]", "[0,8]"), 4), "beyond end of file"),
    (st(T.format("U8", "[1]", "[1,2]"), 2), "gap or overlap"),
    (st(T.format("U8", "[1]", "[0,1]"), 2), "unclaimed trailing"),
])
def test_safetensors_rejects(data, message):
    with pytest.raises(headers.FormatError, match=None) as e:
        headers.parse_safetensors(data, len(data))
    assert message in str(e.value)


def test_safetensors_accepts_scalars_and_empty():
    data = st('{"s":{"dtype":"F32","shape":[],"data_offsets":[0,4]},"e":{"dtype":"F32","shape":[0,18446744073709551615],"data_offsets":[4,4]}}  ', 4)
    got = headers.parse_safetensors(data, len(data))
    assert [(t.name, t.elements) for t in got.tensors] == [("e", 0), ("s", 1)]


def kv(key: str, kind: int, raw: bytes) -> bytes:
    return struct.pack("<Q", len(key)) + key.encode() + struct.pack("<I", kind) + raw


def gg(n_tensors: int, n_meta: int, body: bytes = b"", version: int = 3) -> bytes:
    return b"GGUF" + struct.pack("<IQQ", version, n_tensors, n_meta) + body


def info(name: str, dims: list[int], kind: int, offset: int = 0) -> bytes:
    return struct.pack("<Q", len(name)) + name.encode() + struct.pack("<I", len(dims)) + b"".join(struct.pack("<Q", d) for d in dims) + struct.pack("<IQ", kind, offset)


@pytest.mark.parametrize(("data", "message"), [
    (gg(0, 0, version=1), "GGUF v1"),
    (gg(0, 0, version=0x03000000), "big-endian"),
    (gg(0, 0, version=9), "unsupported GGUF version"),
    (gg(0, 99), "metadata count 99 cannot fit"),
    (gg(0, 1, kv("a", 7, b"\x02") + bytes(9)), "bool must be 0 or 1"),
    (gg(0, 1, kv("a", 99, bytes(9))), "unknown metadata value type"),
    (gg(0, 2, kv("a", 0, b"1") * 2), "duplicate metadata key"),
    (gg(0, 1, kv("a", 8, struct.pack("<Q", 1) + b"\xff")), "not valid UTF-8"),
    (gg(0, 1, kv("a", 9, struct.pack("<IQ", 9, 1) * 9 + bytes(20))), "nested more than 8 deep"),
    (gg(0, 1, kv("general.alignment", 4, struct.pack("<I", 3))), "power of two"),
    (gg(1, 0, info("t", [1] * 5, 0) + bytes(99)), "at most 4"),
    (gg(1, 0, info("t", [32], 4) + bytes(99)), "was removed from GGUF"),
    (gg(1, 0, info("t", [32], 77) + bytes(99)), "unknown ggml type id"),
    (gg(1, 0, info("t", [31], 8) + bytes(99)), "not a multiple of the Q8_0 block size"),
    (gg(1, 0, info("t", [1], 0, 32) + bytes(99)), "data offset 32, expected 0"),
    (gg(1, 0, info("t", [9], 0)), "beyond end of file"),
    (gg(2, 0, info("t", [0], 0) * 2), "duplicate tensor name"),
])
def test_gguf_rejects(data, message):
    with pytest.raises(headers.FormatError) as e:
        headers.parse_gguf(data, len(data))
    assert message in str(e.value)


def test_truncation_and_edits_never_crash():
    rng = np.random.default_rng(5)
    for data in writers.demo_files().values():
        end = headers.parse(data, len(data)).data_start
        for n in [*range(0, min(end, 300)), *rng.integers(0, len(data), 50)]:
            with pytest.raises(headers.FormatError):
                headers.parse(data[:n], int(n))
        for _ in range(100):
            bad = bytearray(data)
            for k in rng.integers(0, 1000, rng.integers(1, 7)):
                bad[k % len(bad)] = rng.integers(0, 256)
            try:
                headers.parse(bytes(bad), len(bad))
            except headers.FormatError:
                pass


def test_half_codecs_are_exact(spark):
    bits = np.arange(65536, dtype="<u2")
    x = codecs.decode("F16", bits.tobytes())
    real = ~np.isnan(x)
    assert (np.frombuffer(codecs.encode("F16", x), "<u2")[real] == bits[real]).all()
    y = codecs.decode("BF16", bits.tobytes())
    assert (np.frombuffer(codecs.encode("BF16", y), "<u2")[~np.isnan(y)] == bits[~np.isnan(y)]).all()
    rows = spark.range(65536).select(codecs.f16_value(__import__("pyspark").sql.functions.col("id")).alias("a"), codecs.bf16_value(__import__("pyspark").sql.functions.col("id")).alias("b")).toPandas()
    assert np.array_equal(rows.a.to_numpy(np.float32), x, equal_nan=True)
    assert np.array_equal(rows.b.to_numpy(np.float32), y, equal_nan=True)


def test_block_codecs():
    x = np.random.default_rng(2).normal(0, 1, 32 * 500).astype(np.float32)
    for kind, share in (("Q8_0", 1 / 127), ("Q4_0", 1 / 8)):
        y = codecs.decode(kind, codecs.encode(kind, x))
        top = np.abs(x.reshape(-1, 32)).max(axis=1)
        assert (np.abs(x - y).reshape(-1, 32).max(axis=1) <= top * share * 1.01).all()
        assert (codecs.decode(kind, codecs.encode(kind, np.zeros(32))) == 0).all()
    assert codecs.encode("Q4_0", np.zeros(32))[2:] == b"\x88" * 16


def naive(x):
    own = x[np.isfinite(x)].astype(np.float64)
    return len(x), len(own), int(np.isnan(x).sum()), own.mean(), own.std()


def test_summaries_match_naive_and_any_partitions(spark, tmp_path):
    x = np.random.default_rng(3).normal(1000, 0.5, 3 * 65536 + 1234).astype(np.float32)
    x[10], x[70000], x[100] = np.nan, -np.inf, 0
    path = str(tmp_path / "x.safetensors")
    with open(path, "wb") as f:
        f.write(writers.safetensors({}, [writers.tensor("x", "F32", [len(x)], x), writers.tensor("none", "F32", [0, 7], []), writers.tensor("odd", "I8", [3], raw=b"abc")]))
    seen = set()
    for n in ("1", "3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = {r["name"]: r for r in stats.summaries(tensors.scan_tensors(spark, path)).collect()}
        seen.add((rows["x"]["mean"], rows["x"]["m2"]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1
    count, finite, nan, mean, std = naive(x)
    r = rows["x"]
    assert (r["count"], r["finite"], r["nan"], r["inf"], r["zeros"]) == (count, finite, nan, 1, 1)
    assert abs(r["mean"] - mean) < 1e-9 * mean and abs(r["std"] - std) < 1e-9 * std
    assert rows["none"]["count"] == 0 and rows["none"]["std"] == 0 and rows["odd"]["count"] is None
    hist = stats.histograms(stats.summaries(tensors.scan_tensors(spark, path)), 5).collect()
    assert sum(h["count"] for h in hist) == finite and len(hist) == 5


def test_health_finds_what_is_planted_and_nothing_else(spark, demo):
    def found(name, **more):
        got = health.check(stats.summaries(tensors.scan_tensors(spark, str(demo / name))), health.Thresholds(**more)).collect()
        return [(r["name"].split(".")[0], r["check"]) for r in got]

    assert found("faults.safetensors") == [("blank", "all-zero"), ("burnt", "non-finite"), ("empty", "dead-rows"), ("hot", "large-magnitude"), ("hot", "f16-range"), ("hot", "row-norm"), ("level", "constant"), ("loud", "row-norm"), ("thin", "sparse")]
    assert found("plain.safetensors") == [] and found("blocks_q4_0.gguf") == []
    assert ("thin", "sparse") not in found("faults.safetensors", max_zero_fraction=0.8)


def plain_values(path) -> dict[str, np.ndarray]:
    """The values of a safetensors file, by the format's description alone."""
    data = path.read_bytes()
    n = int.from_bytes(data[:8], "little")
    own = {"F32": "<f4", "F16": "<f2"}
    out = {}
    for name, t in json.loads(data[8 : 8 + n]).items():
        if name != "__metadata__":
            raw = data[8 + n + t["data_offsets"][0] : 8 + n + t["data_offsets"][1]]
            out[name] = np.frombuffer(raw, own[t["dtype"]]).astype(np.float64) if t["dtype"] in own else (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4").astype(np.float64)
    return out


def test_diff_categories_metrics_and_collisions(spark, demo, tmp_path):
    a, b = (tensors.scan_tensors(spark, str(demo / n)) for n in ("plain.safetensors", "spiced.safetensors"))
    got = diff.compare(a, b)
    rows = {r["norm"]: r for r in got.collect()}
    assert {k: r["outcome"] for k, r in rows.items()} == {"soup.kernel": "compared", "bread.kernel": "compared", "salt.shift": "compared", "oven.kernel": "shape_mismatch", "tray": "only_a", "rack": "only_b"}
    x, y = plain_values(demo / "plain.safetensors"), plain_values(demo / "spiced.safetensors")
    both = ("soup.kernel", "bread.kernel", "salt.shift")
    p, q = (np.concatenate([v[k] for k in both]) for v in (x, y))
    for r, u, v in [*((rows[k], x[k], y[k]) for k in both), (diff.overall(got).first(), p, q)]:
        want = [(u != v).mean(), np.abs(u - v).max(), np.abs(u - v).mean(), np.sqrt(((u - v) ** 2).mean()), np.linalg.norm(u - v) / np.linalg.norm(u), u @ v / np.linalg.norm(u) / np.linalg.norm(v)]
        assert np.allclose([r[k] for k in ("changed_fraction", "max_abs_diff", "mean_abs", "rmse", "rel_l2", "cosine")], want, rtol=1e-12)
    assert rows["soup.kernel"]["identical"] and [r["norm"] for r in diff.top_changed(got, 1).collect()] == [max(both, key=lambda k: np.linalg.norm(x[k] - y[k]) / np.linalg.norm(x[k]))]
    assert diff.sums(np.float32([1, 2, 3, 4]), np.float32([1, 2, 3, 5]))[:7] == (4, 3, 4, 0, 1.0, 1.0, 1.0)
    n = np.float32([np.nan, np.inf, np.inf, 1, np.nan])
    assert diff.sums(n, np.float32([np.nan, np.inf, -np.inf, np.nan, 2]))[:4] == (5, 2, 0, 3)
    with pytest.raises(ValueError, match="after prefix stripping"):
        diff.matched(a, b, ("soup.", "bread."))


def test_changed_file_is_refused(spark, tmp_path):
    path = tmp_path / "x.safetensors"
    path.write_bytes(writers.safetensors({}, [writers.tensor("x", "F32", [2], [1, 2])]))
    table = spark.createDataFrame(tensors.tensor_rows(str(path)), tensors.TENSORS)
    path.write_bytes(writers.safetensors({"a": "b"}, [writers.tensor("x", "F32", [2], [1, 2])]))
    with pytest.raises(Exception, match="changed between"):
        stats.summaries(table).collect()


def test_data_source_reads_names_that_are_asked_for(spark, demo):
    tensors.register(spark)
    source = lambda **more: spark.read.format("tensorfile").options(path=f"{demo / 'blocks_q8_0.gguf'},{demo / 'plate.safetensors'}", mode="chunks", **more).load()
    names = lambda df: {r["name"] for r in df.select("name").collect()}
    assert names(source(name="lid.scale")) == {"lid.scale"} and names(source(contains="l")) == {"shelf.kernel", "lid.scale", "plate", "pantry.kernel"} and names(source(prefix="s")) == {"shelf.kernel"} and names(source(name="none")) == set()
    df = source()
    assert names(df.where("name like 's%'")) == {"shelf.kernel"}
    whole = {(r["path"][-5:], r["name"]): codecs.decode(r["dtype"], bytes(r["raw"])) for r in df.collect()}
    assert {k[1] for k in whole} == {"pantry.kernel", "shelf.kernel", "lid.scale", "plate", "cup"} and whole["nsors", "plate"].tolist() == [3, -1, 0, 0.5]
    heads = spark.read.format("tensorfile").option("path", str(demo / "plate.safetensors")).load()
    assert [r["name"] for r in heads.orderBy("tensor_pos").collect()] == ["cup", "plate"]


def test_metadata_and_totals(spark, demo):
    own = tensors.scan_metadata(spark, str(demo / "blocks_q4_0.gguf"))
    assert tensors.metadata_value(own, "general.alignment").select("value_type", "value_repr").first() == ("u32", "128")
    dishes = tensors.metadata_value(own, "demo.weights").first()
    assert (dishes["element_type"], dishes["arr_len"], dishes["preview"]) == ("f32", 12, ["0", "0.5", "1", "1.5", "2", "2.5", "3", "3.5"])
    assert tensors.metadata_value(own, "none").count() == 0
    totals = {r["type_name"]: tuple(r)[1:] for r in tensors.type_totals(tensors.scan_tensors(spark, str(demo / "blocks_q4_0.gguf"))).collect()}
    assert totals == {"Q4_0": (1, 576, 576 // 32 * 18), "F16": (1, 384, 768), "Q6_K": (1, 1024, 840), "F32": (1, 32, 128)}


AWKWARD = [np.zeros(32), np.r_[1.0, np.zeros(31)], np.r_[-3.0, 3.0, np.zeros(30)], np.full(32, 1e-6), np.full(32, 1e-9), np.full(32, 3e38), np.full(32, 6.6e6), np.r_[np.nan, np.ones(31)], np.r_[np.inf, np.ones(31)], np.arange(32) - 15.5, np.r_[7.9, -8.0, np.zeros(30)], np.full(32, np.nan)]


@pytest.mark.parametrize("kind", ["Q8_0", "Q4_0"])
def test_quantized_columns_are_the_codec(spark, kind):
    r = np.random.default_rng(7)
    blocks = [np.float32(b) for b in AWKWARD] + list(r.normal(0, 1, (200, 32)).astype(np.float32)) + list((r.normal(0, 1, (50, 32)) * 10.0 ** r.integers(-12, 12, (50, 1))).astype(np.float32))
    rows = [("t", k, [float(v) for v in np.concatenate(blocks[2 * k : 2 * k + 2])]) for k in range(len(blocks) // 2)]
    got = tables.quantized(spark.createDataFrame(rows, "tensor string, row long, x array<float>"), kind).orderBy("row", "pos").collect()
    x = np.concatenate(blocks[: 2 * len(rows)])
    want = codecs.decode(kind, codecs.encode(kind, x))
    assert np.array_equal(np.float32([g["y"] for g in got]), want, equal_nan=True)


def test_encoded_columns_are_the_codec(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([codecs.decode("F16", np.arange(65536, dtype="<u2").tobytes())[::17], np.float32([0, 65504, 65519.99, 65520, 1e-8, 2.98e-8, 2.99e-8, 6e-5, 3.39e38, 3.4e38, np.inf, -np.inf, np.nan]), (r.normal(0, 1, 2000) * 10.0 ** r.integers(-40, 38, 2000)).astype(np.float32)])
    x = x[(np.abs(x) >= 2.0**-126) | (x == 0) | np.isnan(x)]
    f = __import__("pyspark").sql.functions
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, x float").select("k", codecs.f16_bits(f.col("x")).alias("a"), codecs.bf16_bits(f.col("x")).alias("b"), codecs.f16_rounded(f.col("x")).alias("c"), codecs.bf16_rounded(f.col("x")).alias("d"))
    got = df.orderBy("k").toPandas()
    for kind, bits, value in (("F16", "a", "c"), ("BF16", "b", "d")):
        want = np.frombuffer(codecs.encode(kind, x), "<u2").astype(int)
        real = ~np.isnan(x) & ~((x == 0) & np.signbit(x))
        assert np.array_equal(got[bits].to_numpy()[real] & 0x7FFF, want[real] & 0x7FFF)
        assert np.array_equal(got[value].to_numpy(np.float32), codecs.decode(kind, want.astype("<u2").tobytes()), equal_nan=True)


def test_bf16_bits_keep_the_sign_of_what_rounds_to_zero(spark):
    x = np.float32([-1e-45, 1e-45, -(2.0**-134), -(2.0**-133), -1e-40, -1e-9, -1.5, 0, 2])
    f = __import__("pyspark").sql.functions
    got = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, x float").select("k", codecs.bf16_bits(f.col("x")).alias("b")).orderBy("k").toPandas()
    assert np.array_equal(got.b.to_numpy(), np.frombuffer(codecs.encode("BF16", x), "<u2"))


def test_f16_bits_keep_the_sign_of_what_rounds_to_zero(spark):
    x = np.float32([-1e-45, -1e-9, 1e-9, -(2.0**-25), -(2.0**-25) * 1.001, -(2.0**-24), -1.5, 0, 2])
    f = __import__("pyspark").sql.functions
    got = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k long, x float").select("k", codecs.f16_bits(f.col("x")).alias("b")).orderBy("k").toPandas()
    assert np.array_equal(got.b.to_numpy(), np.frombuffer(codecs.encode("F16", x), "<u2"))


def test_encode_queries_return_the_types_of_their_sql(spark):
    for name in ("encode_bf16_roundtrip", "encode_f16_roundtrip"):
        assert [t for _, t in queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes] == ["string", "bigint", "bigint", "bigint", "float"]


def test_medians_are_exact(spark):
    r = np.random.default_rng(9)
    norms = {"a": r.normal(10, 3, 5001), "b": r.normal(10, 3, 4000), "c": np.ones(3000), "d": np.r_[1.0, 2.0], "e": np.r_[5.0], "f": r.integers(0, 4, 3000).astype(float)}
    df = spark.createDataFrame([(k, i, False, float(v)) for k, own in norms.items() for i, v in enumerate(own)] + [("g", 0, True, 0.0), ("a", -1, True, 0.0)], "t string, row long, dead boolean, norm double").repartition(5)
    for accuracy in (100, 10_000):
        got = {x["t"]: x for x in health.medians(df, ["t"], accuracy).collect()}
        assert {k: got[k]["median"] for k in norms} == {k: float(np.median(v)) for k, v in norms.items()}
        assert got["g"]["median"] is None and (got["a"]["n_rows"], got["a"]["n_dead"], got["a"]["n_live"]) == (5002, 1, 5001)


def test_shards_refuse_what_is_no_matrix(spark, tmp_path):
    pa = __import__("pyarrow")
    for bad in ([[1.0, 2.0], None, [3.0, 4.0]], [[1.0, 2.0], [1.0], [1.0, 2.0, 3.0]], [[1.0, None]]):
        with pytest.raises(ValueError, match="can't (make|be written)"):
            shards.matrix(pa.array(bad, pa.list_(pa.float32())))
        df = spark.createDataFrame([(k, 0, b) for k, b in enumerate(bad)], "at long, shard long, values array<float>").coalesce(1)
        for write in (shards.write_shards, shards.write_numbered):
            with pytest.raises(Exception):  # noqa: B017
                write(df, f"{tmp_path}/{write.__name__}{len(bad)}").count()
    with pytest.raises(ValueError, match="width 3"):
        shards.matrix(pa.array([[1.0, 2.0]], pa.list_(pa.float32())), 3)
    with pytest.raises(Exception):  # noqa: B017
        shards.write_numbered(spark.createDataFrame([(1, 0, [1.0]), (1, 0, [2.0])], "at long, shard long, values array<float>"), f"{tmp_path}/twice").count()


def test_dump_is_what_the_file_holds(spark, demo, tmp_path):
    manifest = {r["name"]: r for r in shards.dump(tensors.scan_tensors(spark, str(demo / "plain.safetensors")), f"{tmp_path}/out").collect()}
    for name, want in plain_values(demo / "plain.safetensors").items():
        got = np.concatenate([np.fromfile(p["file"].removeprefix("file:"), "<f4") for p in manifest[name]["parts"]])
        assert np.array_equal(got, want) and abs(manifest[name]["mean"] - want.mean()) < 1e-12 and manifest[name]["decoded"]
    skipped = {r["name"]: r for r in shards.dump(tensors.scan_tensors(spark, str(demo / "blocks_q8_0.gguf")), f"{tmp_path}/blocks").collect()}["jar.kernel"]
    assert not skipped["decoded"] and skipped["parts"] is None and skipped["count"] is None


def test_dumped_rows_keep_their_places_where_ids_have_gaps(spark, tmp_path):
    ids = [0, 1, 5, 63, 64, 70, 1000003, 1000012, 1000032]
    rows = [(k, [float(k % 7 + p) / 8 for p in range(64)], k % 3) for k in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["tensor"], r["at"]): r["value"] for r in queries.dump_values(spark, str(tmp_path)).where("not isnan(value)").collect()}
    want = {(r["row"], r["pos"]): r["x"] for r in queries.planted(spark, str(tmp_path)).where("not isnan(x)").collect()}
    assert got == {(f"emb.{row // 64}", row % 64 * 64 + pos): np.float32(np.float16(x)) for (row, pos), x in want.items()}


def test_cli(spark, demo, capsys):
    def said(*args, status=0):
        assert cli.main([str(x) for x in args], spark) == status
        return capsys.readouterr().out

    plate = demo / "plate.safetensors"
    assert said("inspect", plate).split("\n") == [
        f"File: {plate}", "Format: safetensors", "Header: 152 bytes; tensor data begins at byte 160", 'Metadata: {"made":"by rule"}',
        '"cup": dtype=F32 shape=[3] data_offset=16 file_offset=176 size=12 bytes elements=3', '"plate": dtype=F32 shape=[2, 2] data_offset=0 file_offset=160 size=16 bytes elements=4',
        "Tensors: 2", "Types: F32 x2 (7 elements)", "Total parameters (stored tensor elements): 7", "",
    ]
    faults = said("health", demo / "faults.safetensors", status=2)
    assert "Checked 8 tensors, skipped 0: 1 errors, 7 warnings, 1 info" in faults and 'WARN  "thin.kernel" [sparse] 66.7% of values are exactly zero (WARN above 50.0%)' in faults
    assert 'WARN  "empty.kernel" [dead-rows] 2 of 12 rows are all zero (16.7%; WARN above 1.0%): rows 1, 8' in faults
    assert "Checked 1 tensors" in said("health", demo / "faults.safetensors", "--filter", "thin") and said("health", demo / "faults.safetensors", "--filter", "thin", "--strict", status=2)
    blocks = said("health", demo / "blocks_q8_0.gguf")
    assert 'SKIP  "jar.kernel" [not-decoded] dtype Q6_K is not decoded' in blocks and "Checked 3 tensors, skipped 1: 0 errors, 0 warnings, 0 info" in blocks
    table = said("stats", plate, "--histogram", "--bins", "2")
    assert f"File: {plate} (safetensors, 2 tensors); kernels: vectorised" in table and '"plate"             F32           4   6.2500e-1    1.4737e0   -1.0000e0    3.0000e0  25.00%     0     0' in table
    assert "Histogram of \"cup\" (finite values):" in table and "(all decoded)" in table
    assert "(safetensors, 1 tensors)" in said("stats", plate, "--filter", "cup")
    out = said("diff", demo / "plain.safetensors", demo / "spiced.safetensors", "--top", 1)
    assert "Matched by name: 4; compared: 3; shape mismatches: 1; not decoded: 0; only in A: 1; only in B: 1" in out and "Identical: 1; changed: 2" in out and "(showing 1 of 2)" in out and "Overall (848 compared elements)" in out
    assert 'Shape mismatch: "kernel": [10, 6] vs [6, 10]' in said("diff", demo / "plain.safetensors", demo / "spiced.safetensors", "--strip-prefix", "oven.")
    one, two = demo / "one.safetensors", demo / "two.safetensors"
    for path, last in ((one, np.nan), (two, 2.0)):
        path.write_bytes(writers.safetensors({}, [writers.tensor("x", "F32", [3], [1, 2, last])]))
    assert "  ^ 1 positions are NaN/Inf on one side only" in said("diff", one, two)
    assert said("stats", demo / "none", status=1) == ""
    with pytest.raises(SystemExit) as e:
        cli.main(["stats", "x", "--bins", "0"])
    assert e.value.code == 2
