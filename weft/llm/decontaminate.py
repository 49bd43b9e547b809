"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

Every benchmark item gives its windows of SPAN words (a shorter item is one window). A window can only
occur where each of its word shingles occurs, so with containment 1 its necessary prefix is a single
shingle. Shingles are ordered by rarity, which is their number of documents in the corpus, and the
rarest one of a window is joined with the shingles of the documents; the place of that shingle in
the window and the lengths bound where the window can start, and the words there are compared exactly.

Scale: documents are scanned twice and never shuffled. Both scans look shingles up in a bitmap of BITS_EACH bits at least for
each shingle (1 in 200 others passes at most), so only rows that hold a benchmark shingle leave the scan: counts of
shingles (combined by task), then candidates with the few words around them. A bitmap holds MOST shingles at most (16 MB); a larger benchmark takes
more scans, each with the bitmap of another part of the shingles. Bitmaps are made of pieces by all tasks. Candidates are joined by
shingle and salt, so a passage that a third of all documents share is spread. The benchmark is never collected.

Nulls and repeats: null or empty texts have no words (not contaminated); items without words have no windows. A null doc_id
is carried; each row has a row in the result, repeated or not. Very long texts are scanned whole. An empty benchmark finds nothing; an empty table gives no rows.
Extra columns are ignored (clean keeps them); benchmark rows without item_id are not named, but their windows hit. Items that repeat an item_id count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._shared import ALNUM, LOWER, chunks, drop_shared, located, materialize, only, small_batches, text_buffer, windows, without, word_hashes, word_spans

SPAN, SHINGLE, SHARE = 13, 3, 20
BITS_EACH, MOST, PIECE = 16, 1 << 23, 1 << 15
#: A shingle sets three bits of its bitmap, at these places of its hash; the highest bits say which bitmap.
WINDOWS, WHICH = (0, 18, 36), 55
SALTS = 16


def _words(batch: pa.RecordBatch) -> tuple:
    raw, offs = text_buffer(batch.column("text"))
    raw = LOWER[raw]
    starts, ends, rows = word_spans(raw, offs, ALNUM)
    return raw, starts, ends, rows, word_hashes(raw, starts, ends)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """window_id, words, width, and the shingles of each window with their places."""
    for batch in chunks(batches, "text", most=1 << 16):
        raw, starts, ends, rows, hashes = _words(batch)
        data, out = raw.tobytes(), []
        cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        for i, item in enumerate(batch.column("item_id").to_pylist()):
            low, high = int(cut[i]), int(cut[i + 1])
            for at in range(low, max(high - SPAN, low) + 1) if high > low else ():
                end = min(at + SPAN, high)
                words = b" ".join(data[starts[k] : ends[k]] for k in range(at, end)).decode()
                width = min(SHINGLE, end - at)
                got, first = windows(hashes[at:end], rows[at:end], width)
                out.append((item, words, end - at, width, got.view(np.int64).tolist(), first.tolist()))
        names = ["item_id", "words", "len", "width", "shingles", "places"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


class Known(NamedTuple):
    """A bitmap of one part of the shingles, and the widths that occur."""

    bits: np.ndarray
    part: int
    parts: int
    widths: list[int]

    def found(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each width the shingles that the bitmap may hold, with their first words."""
        for width in self.widths:
            got, first = windows(hashes, rows, width)
            if self.parts > 1:
                own = np.flatnonzero((got >> np.uint64(WHICH)) % np.uint64(self.parts) == self.part)
                got, first = got[own], first[own]
            for low in WINDOWS:
                at = (got >> np.uint64(low) & np.uint64(8 * len(self.bits) - 1)).astype(np.int64)
                keep = np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                got, first = got[keep], first[keep]
            yield width, got, first


def known(shingles: DataFrame) -> list[Broadcast]:
    """Bitmaps of a table of shingles (width, shingle), broadcast: as many as hold all of them with BITS_EACH bits for each."""
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())
    n = shingles.count()
    parts = max(1, -(-n // MOST))
    size = max(PIECE, 1 << (BITS_EACH * -(-n // parts) - 1).bit_length()) if n else PIECE
    places = F.explode(F.array(*[F.shiftrightunsigned("shingle", low).bitwiseAND(F.lit(size - 1)) for low in WINDOWS])).alias("at")
    pieces = shingles.select(F.pmod(F.shiftrightunsigned("shingle", WHICH), F.lit(parts)).alias("part"), places)
    pieces = pieces.select("part", F.shiftright("at", PIECE.bit_length() - 1).alias("piece"), F.col("at").bitwiseAND(F.lit(PIECE - 1)).alias("at"))
    pieces = pieces.groupBy("part", "piece").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = []
    for part in range(parts):
        bits = np.zeros(size // 8, np.uint8)
        for r in pieces.where(F.col("part") == part).collect():
            bits[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(r["bits"], np.uint8)
        out.append(shingles.sparkSession.sparkContext.broadcast(Known(bits, part, parts, widths)))
    return out


def _counted(shared):
    """(shingle, n): in how many rows each benchmark shingle occurs, combined within the task and given out when many have gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            got, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

        for batch in chunks(batches, "text"):
            _, _, _, rows, hashes = _words(batch)
            for _, got, first in shared.value.found(hashes, rows):
                pairs = np.unique(np.stack([rows[first].astype(np.uint64), got]), axis=1)[1] if len(got) else got
                held.append(pairs)
                size += len(pairs)
            if size > 1 << 20:
                yield out()
                held, size = [], 0
        yield out()

    return run


_PLACES = "array<struct<shingle: long, width: int, at: long, left: int, around: array<string>>>"


def _candidates(shared):
    """Per row of documents: its place, doc_id, n_words and where a prefix shingle may stand, with the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw, starts, ends, rows, hashes = _words(batch)
            n = batch.num_rows
            counts = np.bincount(rows, minlength=n).astype(np.int64)
            base = np.concatenate([[0], np.cumsum(counts)])
            data, places = raw.tobytes(), [[] for _ in range(n)]
            for width, got, first in shared.value.found(hashes, rows):
                for h, k in zip(got.view(np.int64).tolist(), first.tolist(), strict=True):
                    i = int(rows[k])
                    low, high = max(int(base[i]), k - SPAN + 1), min(int(base[i + 1]), k + SPAN)
                    places[i].append((h, width, k - int(base[i]), k - low, [data[starts[j] : ends[j]].decode() for j in range(low, high)]))
            kind = pa.list_(pa.struct([("shingle", pa.int64()), ("width", pa.int32()), ("at", pa.int64()), ("left", pa.int32()), ("around", pa.list_(pa.string()))]))
            cells = [[dict(zip(("shingle", "width", "at", "left", "around"), p, strict=True)) for p in found] for found in places]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), batch.column("doc_id"), pa.array(counts), pa.array(cells, kind)], names=["file", "row", "doc_id", "n_words", "places"])

    return run


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated: one row per row of documents."""
    docs, file, row = located(only(documents, "doc_id", "text"))
    return _scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(file).alias("file"), F.col(row).alias("row")), benchmark).drop("file", "row")


def _scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What contamination gives, with the places of the rows."""
    docs, place = small_batches(docs), ["file", "row"]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    each = materialize(items.mapInArrow(_item_windows, "item_id long, words string, len int, width int, shingles array<long>, places array<int>"))
    windows_ = each.select("words", "len", "width", "shingles", "places").dropDuplicates(["words"])
    grams = materialize(windows_.select("words", "len", "width", F.explode(F.arrays_zip(F.col("shingles").alias("shingle"), F.col("places").alias("place"))).alias("z")).select("words", "len", "width", F.col("z.shingle").alias("shingle"), F.col("z.place").alias("place")))

    counts = [docs.select("text").mapInArrow(_counted(seen), "shingle long, n long") for seen in known(materialize(grams.select("width", "shingle").distinct()))]
    rarity = reduce(DataFrame.union, counts).groupBy("shingle").agg(F.sum("n").alias("n"))
    ranked = grams.join(rarity, "shingle", "left").select("words", "len", "width", "shingle", "place", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = materialize(ranked.groupBy("words").agg(F.min(F.struct("n", "shingle", "place", "len", "width")).alias("rarest")).where("rarest.n > 0").select("words", "rarest.shingle", "rarest.place", "rarest.len", "rarest.width"))

    found = [materialize(docs.mapInArrow(_candidates(wanted), f"file long, row long, doc_id long, n_words long, places {_PLACES}")) for wanted in known(materialize(prefix.select("width", "shingle").distinct()))]
    scanned = found[0]
    near = reduce(DataFrame.union, [x.select(*place, F.explode("places").alias("p")).select(*place, "p.*") for x in found]).withColumn("salt", F.pmod(F.hash(*place), F.lit(SALTS)))
    rare = prefix.select(F.col("shingle").alias("s"), F.col("width").alias("w"), "place", "len", "words", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_w"))
    start = F.col("left") - F.col("place")
    fits = (start >= 0) & (start + F.col("len") <= F.size("around"))
    equal = F.array_join(F.slice("around", F.when(fits, start + 1).otherwise(F.lit(1)), F.when(fits, F.col("len")).otherwise(F.lit(0))), " ") == F.col("words")
    on = (F.col("shingle") == F.col("s")) & (F.col("width") == F.col("w")) & (F.col("salt") == F.col("salt_w")) & fits & equal
    hits = materialize(near.join(rare, on).select(*place, (F.col("at") - F.col("place")).alias("start"), "len", "words").distinct())

    # Words under any window: intervals by start, each adds what lies beyond the furthest end so far.
    spans = hits.groupBy(*place).agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    step = lambda acc, x: F.struct(F.greatest(acc["far"], x["start"] + x["len"]).alias("far"), (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["far"], x["start"]))).alias("n"))
    covered = spans.select(*place, F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("n")), step)["n"].alias("n_hit"))
    owners = materialize(each.where("item_id is not null").select("words", "item_id").distinct())
    named = materialize(hits.select(*place, "words").distinct())
    own = named.join(owners, "words").groupBy(*place).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    flagged = covered.join(own, place, "left")
    out = scanned.select(*place, "doc_id", "n_words").join(flagged, place, "left")
    none = F.array().cast("array<string>")
    out = out.select(*place, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    drop_shared(grams, prefix)
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words")))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that are not contaminated, with all their columns."""
    docs, file, row = located(documents)
    found = _scanned(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(file).alias("file"), F.col(row).alias("row")), benchmark)
    return without(docs, file, row, found.where("contaminated").select("file", "row"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = contamination(docs, only(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+12], ' ') AS words, least(len(ws), 13) AS n FROM item, unnest(range(1, greatest(len(ws) - 12, 1)::BIGINT + 1)) AS t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM win),
docwin AS (SELECT doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') AS words FROM low, lens, unnest(range(1, len(ws)::BIGINT - n + 2)) AS t(i)),
hit AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM docwin d JOIN win w ON d.words = w.words AND d.n = w.n),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(k) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT low.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM low LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
