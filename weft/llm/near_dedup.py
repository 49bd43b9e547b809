"""MinHash near-dedup by fast similarity sketching.

Every document is the set of its distinct word shingles. A sketch has T bins; in round i < T each
shingle is hashed to a bin with the value (i, hash), in rounds T..2T-1 bin i - T takes every shingle,
and each bin keeps its smallest value. So all coordinates fill, with concentration bounds, after about
T log T placements for any set size. Bands of sketch coordinates propose candidates, and full
shingle sets confirm each link.

Scale: texts are scanned where they lie and never shuffled. Documents with one and the same shingle set meet in one representative first, so exact copies
never form pairs. A bucket's hub is its smallest node; only the pairs (hub, member) are confirmed first, their components leave few
buckets with members of more than one component, and only pairs across components are looked at
there. Pairs pass a test on parity bitmaps (the bits in which two differ are at most the shingles in which the sets
differ, so the test drops no link) before full sets are compared: then a second scan makes the shingle sets of the documents of some pair alone,
which it finds by their places in the files, and sends each member to its hub's group (salted, so that a hub with many members is many groups) in one shuffle, where it is compared as it streams by.
All joins are equi-joins of plain tables, so AQE splits hot keys; nothing is collected, no bucket is capped.

Links at the threshold are missed with probability (1 - s^ROWS)^BANDS, 5e-6 at s = 0.75, as any banding does.
Shingles are compared by 64-bit fingerprints.

Nulls and repeats: a null or empty text has the empty set, is linked with nothing and is kept. A row
without doc_id takes part; its component is named by the smallest doc_id in it, null if there is none
(then it is kept by the query; one_of_each keeps one row of every component, with an id or not). Rows that repeat a doc_id are rows of their own.
Very long texts are whole sets; an empty table gives no rows. Extra columns are ignored (one_of_each keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._shared import LOWER, SPACED, Places, chunks, drop_shared, each, located, materialize, mix, numbered, only, small_batches, text_buffer, windows, without, word_hashes, word_spans

WIDTH, PERCENT = 5, 75
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Longs of a parity bitmap, and of its folded form that is tried first.
LONGS, FOLDED = 32, 8
#: Members of a hub that are compared in one group, and groups of a hub at most.
GROUP, GROUPS = 32, 4096
#: Bits of a row_id that number the rows of a task of the first scan, which wrote them to one file.
TASK = 36

_SIGN = "row_id long, file long, row long, doc_id long, n_shingles long, set_hash binary, parity array<long>, bands array<long>"


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each row; rows of 1 to width - 1 words have their whole sequence as one."""
    raw = LOWER[raw]
    starts, ends, rows = word_spans(raw, offs, SPACED)
    hashes = word_hashes(raw, starts, ends)
    got, first = windows(hashes, rows, width)
    n = len(offs) - 1
    cut = np.searchsorted(rows[first], np.arange(n + 1)) if len(first) else np.zeros(n + 1, np.int64)
    sets = [np.unique(got[cut[i] : cut[i + 1]]) for i in range(n)]
    words = np.searchsorted(rows, np.arange(n + 1))
    for i in np.flatnonzero((np.diff(words) > 0) & (np.diff(words) < width)):
        sets[i] = windows(hashes[words[i] : words[i + 1]], rows[words[i] : words[i + 1]], int(words[i + 1] - words[i]))[0]
    return sets


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of `bins` values for each non-empty set: its rounds of placement go on until all its bins are filled."""
    none = np.uint64(2**64 - 1)
    out = np.full((len(sets), bins), none, np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), size)
    for turn in range(2 * bins):
        if not len(flat):
            break
        h = mix(flat ^ mix(np.full(1, turn + 1, np.uint64)))
        where = (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32) if turn < bins else np.full(len(h), turn - bins, np.uint64)
        value = (np.uint64(turn) << np.uint64(52)) | (mix(h) >> np.uint64(12))
        np.minimum.at(out.reshape(-1), owner * bins + where.astype(np.int64), value)
        if turn < 8 or turn % 4 == 0:
            short = (out == none).any(axis=1)
            keep = short[owner]
            flat, owner = flat[keep], owner[keep]
    return out


def parities(sets: list[np.ndarray], longs: int = LONGS) -> np.ndarray:
    """For each set longs * 64 bits, each the parity of the number of shingles that fall on it."""
    bits = longs * 64
    flat, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    where = (mix(flat + np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(owner * bits + where, minlength=len(sets) * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(sets), longs)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sign(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        sets = shingle_sets(*text_buffer(batch.column("text")))
        sizes = np.array([len(s) for s in sets], np.int64)
        sketch = sketches(sets)
        bands = np.zeros((len(sets), BANDS), np.uint64)
        for b in range(BANDS):
            acc = np.full(len(sets), b + 1, np.uint64)
            for k in range(ROWS):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sketch[:, b * ROWS + k])
            bands[:, b] = acc
        full = sizes > 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(bands[full].view(np.int64).reshape(-1)))
        marks = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * LONGS + 1, LONGS, dtype=np.int32)), pa.array(parities(sets).reshape(-1)))
        names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(at, at + len(sets))), batch.column("file"), batch.column("row"), batch.column("doc_id"), pa.array(sizes), pa.array(names, pa.binary()), marks, lists],
            names=["row_id", "file", "row", "doc_id", "n_shingles", "set_hash", "parity", "bands"],
        )

    return numbered(sign, chunks(batches, "text", rows=1024))


def _banded(rows: pa.RecordBatch, found: np.ndarray, _: pa.Table) -> pa.RecordBatch:
    """One row for each band of the found rows."""
    some = rows.take(pa.array(found))
    return pa.RecordBatch.from_arrays([some.column("bands").flatten(), pa.array(np.repeat(some.column("row_id").to_numpy(), BANDS))], names=["key", "node"])


def _marked(rows: pa.RecordBatch, found: np.ndarray, entries: pa.Table) -> pa.RecordBatch:
    """The entries with their rows' sizes, bitmaps and places in the documents."""
    some = rows.take(pa.array(found))
    own = [some.column(c) for c in ("n_shingles", "parity", "file", "row")]
    return _entered(entries, own, ["n", "parity", "file", "row"])


def _entered(entries: pa.Table | None, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    own = [entries.column(c).combine_chunks() if entries else pa.array([], t) for c, t in (("hub", pa.int64()), ("salt", pa.int64()), ("side", pa.int32()), ("node", pa.int64()))]
    return pa.RecordBatch.from_arrays([*own, *columns], names=["hub", "salt", "side", "node", *names])


def _shingled(rows: pa.RecordBatch, found: np.ndarray, entries: pa.Table | None) -> pa.RecordBatch:
    """The entries with their rows' shingle sets."""
    some, at = np.unique(found, return_inverse=True)
    sets: list[bytes] = []
    for part in chunks(iter([rows.select(["text"]).take(pa.array(some))]), "text"):
        sets += [s.tobytes() for s in shingle_sets(*text_buffer(part.column("text")))]
    return _entered(entries, [pa.array([sets[k] for k in at], pa.binary())], ["shingles"])


def _similar(x: pa.Scalar, y: pa.Scalar) -> bool:
    """Whether two sorted sets are similar enough."""
    p, q = sorted((np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), key=len)
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    both = int((q[at] == p).sum()) if len(q) else 0
    return both > 0 and 100 * both >= PERCENT * (len(p) + len(q) - both)


def _by_sets(hub: pa.RecordBatch, members: pa.RecordBatch) -> list[int]:
    return [i for i, y in enumerate(members.column("shingles")) if _similar(hub.column("shingles")[0], y)]


def _by_parity(hub: pa.RecordBatch, members: pa.RecordBatch) -> list[int]:
    x, y = (np.asarray(b.column("parity").flatten()).view(np.uint64).reshape(-1, LONGS) for b in (hub, members))
    n = members.column("n").to_numpy()
    near = np.minimum(n, own := hub.column("n")[0].as_py()) * 100 >= np.maximum(n, own) * PERCENT
    differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return np.flatnonzero(near & (differ * (100 + PERCENT) <= (n + own) * (100 - PERCENT))).tolist()


def _streamed(test, more: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (hub a, member b) that pass the test, of rows sorted by hub, salt and side: each group begins with its hub. more: columns that are given for both."""
    hub = None
    for batch in batches:
        cuts = [0, *np.flatnonzero(batch.column("side").to_numpy() == 0).tolist(), batch.num_rows]
        kept = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low < high:
                if batch.column("side")[low].as_py() == 0:
                    hub, low = batch.slice(low, 1), low + 1
                members = batch.slice(low, high - low)
                some = members.take(pa.array(test(hub, members), pa.int64()))
                if some.num_rows:
                    same = hub.take(pa.array(np.zeros(some.num_rows, np.int64)))
                    kept.append(pa.RecordBatch.from_arrays([x.column(c) for c in ("node", *more) for x in (same, some)], names=[f"{s}{c}" for c in ("", *(f"_{m}" for m in more)) for s in "ab"]))
        yield from kept


def _compared(pairs: DataFrame, scan: DataFrame, place, carry, kinds: str, test, more: list[str]) -> DataFrame:
    """The pairs (a, b) that pass a test on what a scan says of both. place(s): columns file and row of side s; carry: entries to rows of kinds."""
    many = materialize(pairs.groupBy("a").agg(F.count("*").alias("many")))
    groups = F.least(F.lit(GROUPS), 1 + F.floor(F.col("many") / GROUP)).cast("long")
    sent = pairs.join(many, "a")
    members = sent.select(*place("b"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), groups).alias("salt"), F.lit(1).alias("side"), F.col("b").alias("node"))
    hubs = sent.dropDuplicates(["a"]).select(*place("a"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("node"))
    places = Places(members.union(hubs))
    rows = places.find(scan, "_at_file", "_at_row", each(carry), f"hub long, salt long, side int, node long, {kinds}")
    kept = [f"{s}_{m} long" for m in more for s in "ab"]
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side")
    out = materialize(dealt.mapInArrow(partial(_streamed, test, more), ", ".join(["a long, b long", *kept])))
    places.drop()
    drop_shared(many)
    return out


def _near(a: Column, b: Column) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _folded(parity: str) -> list[Column]:
    """The bitmap of FOLDED longs: the exclusive or of its parts is the bitmap of fewer bits."""
    step = LONGS // FOLDED
    return [reduce(lambda x, y: x.bitwiseXOR(y), [F.get(parity, F.lit(k * step + i)) for i in range(step)]).alias(f"f{k}") for k in range(FOLDED)]


def _alike(differ: Column, size: Column) -> Column:
    """Whether sets of `size` shingles together can be similar enough if they differ in so many at least."""
    return differ * (100 + PERCENT) <= size * (100 - PERCENT)


def _places(rows: str, named: str = "") -> list[Column]:
    """file and row of a row_id in the table of signed rows."""
    return [F.shiftright(F.col(rows), TASK).alias(f"{named}file"), F.col(rows).bitwiseAND(F.lit((1 << TASK) - 1)).alias(f"{named}row")]


def _parity(x: str, y: str) -> Column:
    """The number of bits in which two bitmaps differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long")), F.lit(0).cast("long"), lambda acc, n: acc + n)


def confirm(docs: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough; pairs whose sizes and bitmaps rule that out aren't looked at. docs: of _texts."""
    marks = signed.select("n_shingles", "parity", "file", "row", *_places("row_id", "_at_"))
    near = _compared(pairs, marks, _places, _marked, "n long, parity array<long>, file long, row long", _by_parity, ["file", "row"])
    there = lambda s: [F.col(f"{s}_{c}").alias(c) for c in ("file", "row")]
    out = _compared(near, docs.withColumnsRenamed({"file": "_at_file", "row": "_at_row"}), there, _shingled, "shingles binary", _by_sets, [])
    drop_shared(near)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of the edges (a, b), comp the smallest node: minimum labels with pointer jumping, each round a table."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")))
    while True:
        over = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        near = label.join(over, "node").select("node", "comp", F.least("comp", "least").alias("now"))
        jump = label.select(F.col("node").alias("now"), F.col("comp").alias("far"))
        new = materialize(near.join(jump, "now").select("node", F.least("now", "far").alias("comp"), (F.least("now", "far") < F.col("comp")).alias("moved")))
        drop_shared(label)
        label = new.select("node", "comp")
        if new.where("moved").isEmpty():
            drop_shared(both)
            return label


def near_duplicates(documents: DataFrame) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id, kept: one row per row of documents (columns doc_id, text)."""
    return _grouped(*located(only(documents, "doc_id", "text"))).drop("comp", "file", "row")


def _grouped(documents: DataFrame, file: str, row: str) -> DataFrame:
    """What near_duplicates gives, with comp, the component's smallest node whether it has an id or not (null without shingles), and the place of the row."""
    docs = small_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(file).alias("file"), F.col(row).alias("row")))
    signed = materialize(docs.mapInArrow(_signed, _SIGN))
    docs = docs.select("text", "file", "row")
    classes = materialize(signed.where("n_shingles > 0").groupBy("set_hash").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("least_id")))

    # Hubs: the smallest node of each bucket with at least two.
    scan, firsts = signed.select("row_id", "bands", *_places("row_id", "_at_")), Places(classes.select(*_places("node")))
    rows = firsts.find(scan, "_at_file", "_at_row", each(_banded), "key long, node long")
    hubs = materialize(rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("many")).where("many > 1").select("key", "hub"))
    members = materialize(rows.join(hubs, "key"))
    firsts.drop()
    drop_shared(hubs)
    stars = materialize(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    edges = confirm(docs, signed, stars)
    looked, done = [stars], []

    def across() -> DataFrame:
        """Pairs that share a bucket but no component, near by size and bitmap (the folded one is tried first), and not looked at yet."""
        label = components(edges)
        now = materialize(members.join(label, "node", "left").select("key", "node", F.when(F.col("node") == F.col("hub"), 1).alias("is_hub"), F.coalesce("comp", "node").alias("comp")))
        split = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.when(F.col("is_hub") == 1, F.col("comp"))).alias("main")).where("low <> high")
        split = materialize(split.select("key", "main"))
        sizes = materialize(now.join(split, "key").select("key", "node", "comp", "main"))
        nodes = sizes.select("node").distinct().join(signed.select(F.col("row_id").alias("node"), F.col("n_shingles").alias("n"), "parity", *_folded("parity")), "node")
        open_ = materialize(sizes.join(nodes, "node"))
        done.extend((label, now, split, sizes, open_))
        one, two = (open_.select("key", *[F.col(c).alias(f"{c}_{side}") for c in open_.columns if c != "key"]) for side in "xy")
        differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"f{k}_x").bitwiseXOR(F.col(f"f{k}_y"))) for k in range(FOLDED)]).cast("long")
        whole = _parity("parity_x", "parity_y")
        apart = F.col("comp_x") != F.col("comp_y")
        once = (F.col("comp_y") == F.col("main_y")) | (F.col("node_x") < F.col("node_y"))
        pairs = one.where("comp_x <> main_x").join(two, "key").where(apart & once & _near(F.col("n_x"), F.col("n_y")) & _alike(differ, F.col("n_x") + F.col("n_y")) & _alike(whole, F.col("n_x") + F.col("n_y")))
        pairs = pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"), F.col("node_x").alias("of"), (-whole).alias("same"))
        for old in looked:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        return pairs

    # First the best partner of each member outside its bucket's main component, then all that is still apart.
    best = materialize(across().groupBy("of").agg(F.max(F.struct("same", "a", "b")).alias("best")).select("best.a", "best.b").distinct())
    drop_shared(*done)
    if not best.isEmpty():
        looked.append(best)
        edges = materialize(edges.union(confirm(docs, signed, best)))
        done.clear()
        rest = materialize(across().select("a", "b").distinct())
        drop_shared(*done)
        if not rest.isEmpty():
            edges = materialize(edges.union(confirm(docs, signed, rest)))
    drop_shared(members)
    label = components(edges)
    names = materialize(label.join(classes.select("node", "least_id"), "node").groupBy("comp").agg(F.min("least_id").alias("id")))
    named = materialize(classes.join(label, "node", "left").select("set_hash", "least_id", F.coalesce("comp", "node").alias("comp")))
    drop_shared(edges, *looked)
    # Components of one class are named by it; of the others, a table of plain rows, so that AQE splits a large one.
    named = materialize(named.join(names, "comp", "left").select("set_hash", "comp", F.when(F.col("id").isNull(), F.col("least_id")).otherwise(F.col("id")).alias("found")))
    out = signed.select("row_id", "file", "row", "doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    name = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    return out.select("row_id", "file", "row", "doc_id", "n_shingles", name.alias("component_id"), "comp").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, one of each component, with all their columns.

    Of a component stays the first row that the query keeps, if there is one, else the first. Rows without words are alike if they have the same doc_id; without one they stay."""
    docs, file, row = located(documents)
    grouped = _grouped(docs, file, row)
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    # Rows that are kept come first.
    order = F.col("row_id") + F.when(F.col("kept"), F.lit(0)).otherwise(F.lit(1 << 62))
    found = materialize(grouped.select("file", "row", F.coalesce("comp", alone).alias("of"), F.col("comp").isNull().alias("bare"), order.alias("place")).where("of is not null"))
    first = materialize(found.groupBy("of", "bare").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    gone = found.join(first, ["of", "bare"]).where("place <> first").select("file", "row")
    return without(docs, file, row, gone)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


#: Exact: all pairs that share a shingle, by counting; components by recursion.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END) AS sh
  FROM w, unnest(range(1, greatest(len(ws) - 3, 2)::BIGINT)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hit FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hit >= 75 * (x.n + y.n - hit)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
