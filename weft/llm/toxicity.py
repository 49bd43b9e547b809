"""Toxicity by subword-bag embeddings.

A window of SPAN words is the average of the vectors of its character n-grams (3 to 5 bytes, word ends marked,
hashed to BUCKETS rows), which a linear softmax reads; vectors and softmax are trained jointly, in numpy. A misspelled
insult shares most n-grams with its other forms. A document's score is its highest window, taken to a
probability of the document by a line on the logit, fitted to the training documents, each class weighted by its labels over
its sampled ones, so that the probability stands for the labels' own ratio whatever the sample. In a toxic document only the highest window counts as toxic after the first round.

Words are runs of letters, digits and non-ASCII characters after A-Z are lowered, so capitals change no score.

Scale: the fit uses a bounded sample of labelled rows: the documents with the smallest hash of their id, TOXIC and CLEAN of them and BYTES of text for each class at most
(whole texts, all their windows; of rows that repeat an id one), so what the driver gets doesn't grow with the table. Once trained, an n-gram's vector times the softmax is one number: executors
get BUCKETS floats, and scoring is one narrow scan in array operations over whole texts of any length, every window of each.

Nulls and repeats: null and empty texts get the model's score for no evidence; a null doc_id is carried (not held out, never learnt from). Repeated rows are
scored alike. Labels that contradict each other on one doc_id: toxic wins. Without labels of both classes every score is 0; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm._shared import ALNUM, LOWER, chunks, give_back, materialize, only, small_batches, text_buffer

BUCKETS, DIM, SPAN, GRAMS = 1 << 18, 8, 12, (3, 4, 5)
TOXIC, CLEAN, BYTES = 1500, 3000, 12 << 20
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.25, 7
PART = 1 << 16
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _spaced(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with all that is no word as a space, and one space before and after each row; offsets that leave these out of no row."""
    n = len(offs) - 1
    out = np.full(len(raw) + n + 1, 32, np.uint8)
    low = LOWER[raw]
    row = np.repeat(np.arange(n), np.diff(offs))
    out[np.arange(len(raw)) + row + 1] = np.where(ALNUM[low], low, 32)
    return out, offs + np.arange(n + 1)


def _words(text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = text != 32
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def _grams(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n the bucket at every place and whether an n-gram stands there: no space but at its ends. It belongs to the word of its second byte."""
    inside = text != 32
    gaps = np.concatenate([[0], np.cumsum(~inside)])
    wide = text.astype(np.uint32)
    acc = wide * np.uint32(0x01000193)
    for n in range(2, max(GRAMS) + 1):
        size = len(text) - n + 1
        if size <= 0:
            return
        acc = (acc[:size] + wide[n - 1 :]) * np.uint32(0x01000193)
        if n in GRAMS:
            fine = gaps[n - 1 : n - 1 + size] == gaps[1 : 1 + size]
            mixed = (acc ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 18), fine


def window_logits(raw: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The highest average weight of any SPAN words in a row, over the whole row; 0 for rows without words."""
    out = np.zeros(len(offs) - 1)
    text, at = _spaced(raw, offs)
    starts, ends, rows = _words(text, at)
    if not len(starts):
        return out
    total, many = np.zeros(len(text) + 1), np.zeros(len(text) + 1, np.int64)
    for bucket, fine in _grams(text):
        total[1 : len(fine) + 1] += np.where(fine, weights[bucket], 0)
        many[1 : len(fine) + 1] += fine
    total, many = np.cumsum(total), np.cumsum(many)
    # n-grams of a word start from the byte before it to its last but one
    word, count = total[ends - 1] - total[starts - 1], many[ends - 1] - many[starts - 1]
    sums, counts = np.concatenate([[0], np.cumsum(word)]), np.concatenate([[0], np.cumsum(count)])
    first = np.searchsorted(rows, np.arange(len(out) + 1))
    to = np.minimum(np.arange(len(word)) + SPAN, first[rows + 1])
    full = (to - np.arange(len(word)) == SPAN) | (np.arange(len(word)) == first[rows])
    score = (sums[to] - sums[:-1]) / np.maximum(counts[to] - counts[:-1], 1)
    score[~full] = -np.inf
    own = np.unique(rows)
    out[own] = np.maximum.reduceat(score, first[own])
    return out


def streams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all n-grams, word by word, how many each word has, and how many words each row has."""
    text, at = _spaced(raw, offs)
    starts, ends, rows = _words(text, at)
    grams = list(_grams(text))
    places = np.concatenate([np.flatnonzero(f) for _, f in grams] or [np.zeros(0, np.int64)])
    order = np.argsort(places, kind="stable")
    ids, places = np.concatenate([b[f] for b, f in grams] or [np.zeros(0, np.uint32)])[order].astype(np.int32), places[order]
    # n-grams of a word start from the byte before it to its last but one
    low, high = np.searchsorted(places, starts - 1), np.searchsorted(places, ends - 1)
    return ids, (high - low).astype(np.int32), np.bincount(rows, minlength=len(offs) - 1)


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and last word + 1 of all windows of documents of so many words that follow each other; a window begins every SPAN / 2 words."""
    step, many = SPAN // 2, np.maximum(-(-(n_words - SPAN // 2) // (SPAN // 2)), 1)
    doc = np.repeat(np.arange(len(n_words)), many)
    base = np.concatenate([[0], np.cumsum(n_words)])
    low = base[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
    return doc, low, np.minimum(low + SPAN, base[doc + 1])


def train(flat: np.ndarray, cut: np.ndarray, n_words: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the buckets and a bias, from the n-grams of all documents, where those of each word begin, and the documents' words and classes."""
    rng = np.random.default_rng(SEED)
    vectors, linear, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_v, g_l, g_b = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    docs, first, last = windows(n_words)
    toxic, size = marks[docs], cut[last] - cut[first]

    def logit() -> np.ndarray:
        w = vectors @ (linear[:, 1] - linear[:, 0])
        sums = np.zeros(len(cut))
        for k in range(0, len(cut) - 1, PART):  # so that no second array of all n-grams is held
            own = cut[k : k + PART + 1]
            sums[k + 1 : k + len(own)] = np.add.reduceat(w[flat[own[0] : own[-1]]], own[:-1] - own[0])
        np.cumsum(sums, out=sums)
        return (sums[last] - sums[first]) / size + (bias[1] - bias[0])

    live = np.ones(len(docs), bool)
    for epoch in range(EPOCHS):
        if epoch:
            score = logit()
            order = np.lexsort((-score, docs))
            top = np.ones(len(order), bool)
            top[1:] = docs[order][1:] != docs[order][:-1]
            best = np.zeros(len(docs), bool)
            best[order[top]] = True
            live = best | (toxic == 0) | (score > 2.0)
        pick = np.flatnonzero(live)
        share = (toxic[pick] == 1).sum() / max(1, (toxic[pick] == 0).sum())
        for part in np.array_split(rng.permutation(pick), max(1, len(pick) // BATCH)):
            ids = np.concatenate([flat[cut[first[k]] : cut[last[k]]] for k in part])
            n = size[part]
            own = np.repeat(np.arange(len(part)), n)
            mean = np.add.reduceat(vectors[ids], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
            z = mean @ linear + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), toxic[part]] -= 1
            p *= np.where(toxic[part] == 1, max(1.0, min(8.0, 0.5 / max(share, 1e-9))), 1.0)[:, None].astype(np.float32)
            back, d_l, d_b = (p @ linear.T) / n[:, None], mean.T @ p / len(part), p.mean(axis=0)
            some, at = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(at, weights=back[own, k], minlength=len(some)) for k in range(DIM)], axis=1).astype(np.float32)
            g_v[some] += (grad**2).mean(axis=1)
            vectors[some] -= RATE * grad / np.sqrt(g_v[some])[:, None]
            g_l += d_l**2
            g_b += d_b**2
            linear -= RATE * d_l / np.sqrt(g_l)
            bias -= RATE * d_b / np.sqrt(g_b)
    return (vectors @ (linear[:, 1] - linear[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def line(x: np.ndarray, y: np.ndarray, many: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of y on x, slightly held back; each row stands for so many."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = many * (p * (1 - p) + 1e-6)
        g = np.array([(many * (p - y) * x).sum() + 0.01 * a, (many * (p - y)).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
    return a, b


def probability(model: tuple, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    weights, bias, a, b = model
    return 1 / (1 + np.exp(-np.clip(a * (window_logits(raw, offs, weights) + bias) + b, -30, 30)))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(shared.value, *text_buffer(batch.column("text"))))], names=["doc_id", "score"])

    return run


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labels that are not held out, one row for each id."""
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("doc_id")))


def sample(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, toxic and text of the rows that the fit reads: bounded in rows and in bytes for each class, whole texts."""
    first = lambda k, n: marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = materialize(first(1, TOXIC).union(first(0, CLEAN)))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Of rows that repeat an id one, chosen on the map side.
    rows = materialize(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    held = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keep = rows.select("doc_id", "toxic", held.alias("held"), F.row_number().over(order).alias("place")).where((F.col("held") <= BYTES) | (F.col("place") == 1))
    return rows.join(F.broadcast(keep.select("doc_id")), "doc_id", "left_semi")


def fit(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float, float] | None:
    """A model from labelled rows that are not held out; None without both classes."""
    marks = learnable(labels)
    rows = sample(documents, marks).toArrow().sort_by("doc_id")
    toxic = rows.column("toxic").to_numpy()
    parts = [(batch, streams(*text_buffer(batch.column("text")))) for batch in chunks(iter(rows.to_batches()), "text")]
    n_words = np.concatenate([p[2] for _, p in parts] or [np.zeros(0, np.int64)])
    if len(set(toxic[n_words > 0].tolist())) < 2:
        return None
    flat, cut = np.concatenate([p[0] for _, p in parts]), np.concatenate([[0], *[p[1] for _, p in parts]]).cumsum(dtype=np.int64)
    parts = [batch for batch, _ in parts]
    give_back()
    weights, bias = train(flat, cut, n_words[n_words > 0], toxic[n_words > 0])
    del flat, cut
    give_back()
    x = np.concatenate([window_logits(*text_buffer(batch.column("text")), weights) for batch in parts]) + bias
    order = np.lexsort((toxic, x))
    # A class stands for all of its labels, of which some were drawn.
    all_ = dict(marks.groupBy("toxic").count().collect())
    many = np.array([all_.get(k, 0) / max(1, (toxic == k).sum()) for k in (0, 1)])
    return (weights, bias, *line(x[order], toxic[order].astype(float), many[toxic[order]]))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(small_batches(docs), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    if model is None:
        out = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        out = docs.mapInArrow(_scored(documents.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs, labels = (only(spark.read.parquet(f"{sf_dir}/{t}.parquet"), *c) for t, c in (("documents", ("doc_id", "text")), ("labels", ("doc_id", "toxic"))))
    return score(docs, labels)
