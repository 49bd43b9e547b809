"""Quality rules as a bitmask ledger.

One scan measures every text and evaluates every rule once; the ledger keeps the measurements and one
failure bit per rule. Versioned policies are masks over those bits, so a new policy or an ablation
never reads a text again: ablations group the ledger by its bits (at most 2^rules groups, combined
on the map side) and work on the groups.

Scale: one narrow scan, no shuffle; ablate() shuffles one row per task and distinct bit pattern.
Word windows are compared by 64-bit fingerprints.

Nulls and repeats: a null text has no words (it fails too_few_words); a null doc_id is carried. Each row of the
input has one row in the ledger, repeated or not. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.llm._shared import SPACED, chunks, only, small_batches, text_buffer, windows, word_hashes, word_spans

WINDOW = 5
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")
_LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURES)

#: name -> failure, as SQL over the measurements. The place in this list is the bit; append only.
RULES = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines > 3 and 100 * n_dup_lines > 30 * n_lines",
    "upper_case": "n_letters >= 40 and 100 * n_upper > 60 * n_letters",
    "too_many_words": "n_words > 1000000",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]

#: version -> (bits of which none may fail, bits that count, failures of those that reject).
POLICIES = {
    "base-1": (BASE, 0, 1),
    "web-1": (BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["upper_case"], 0, 1),
    "web-2": (BASE | BIT["symbols"] | BIT["upper_case"], BIT["short_mean_word"] | BIT["long_mean_word"] | BIT["duplicate_lines"], 2),
}
POLICY = "web-1"

_SYMBOL, _UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offs])


def measure(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of each row of a text buffer."""
    n = len(offs) - 1
    starts, ends, rows = word_spans(raw, offs, SPACED)
    out = {"n_words": np.bincount(rows, minlength=n).astype(np.int64)}
    lead = (raw & 0xC0) != 0x80
    out["word_chars"] = _per_row(lead & SPACED[raw], offs)
    out["n_symbols"] = _per_row(_SYMBOL[raw], offs)
    out["n_letters"], out["n_upper"] = _per_row(_LETTER[raw], offs), _per_row(_UPPER[raw], offs)
    lines, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    data = raw.tobytes()
    for i in np.flatnonzero(out["n_words"]):
        own = [x for x in data[offs[i] : offs[i + 1]].split(b"\n") if x.strip()]
        lines[i], repeats[i] = len(own), len(own) - len(set(own))
    out["n_lines"], out["n_dup_lines"] = lines, repeats
    got, first = windows(word_hashes(raw, starts, ends), rows, WINDOW)
    order = np.lexsort((got, rows[first]))
    same = (got[order][1:] == got[order][:-1]) & (rows[first][order][1:] == rows[first][order][:-1]) if len(order) else np.zeros(0, bool)
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(starts) + WINDOW + 1, np.int64)
    at = first[order[twice]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    covered = np.cumsum(edge)[: len(starts)] > 0
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n).astype(np.int64)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        found = measure(*text_buffer(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[m]) for m in _MEASURES]], names=["doc_id", *_MEASURES])


def verdict(policy: str, bits: str = "fail_bits") -> Column:
    """True where the policy accepts a ledger row."""
    none, some, most = POLICIES[policy]
    return (F.col(bits).bitwiseAND(F.lit(none)) == 0) & (F.bit_count(F.col(bits).bitwiseAND(F.lit(some))) < most)


def failures(named=lambda rule: rule) -> Column:
    """The failure bits; named() gives a rule the names of the measurements."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(named(rule)), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]).cast("long")


def ledger(documents: DataFrame) -> DataFrame:
    """doc_id, the measurements, fail_bits."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(docs).mapInArrow(_measured, _LEDGER).withColumn("fail_bits", failures())


def judge(of: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with base_failed and kept."""
    return of.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", ~F.col("base_failed") & verdict(policy))


def ablate(of: DataFrame) -> DataFrame:
    """policy, rule, n_failed, n_rejected, n_only: what each rule does in each policy. n_only: rows that the policy takes without that rule alone."""
    groups = of.groupBy("fail_bits").agg(F.count("*").alias("n"))
    parts = []
    for p in POLICIES:
        for r in RULES:
            if (POLICIES[p][0] | POLICIES[p][1]) & BIT[r]:
                parts.append(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), (F.col("fail_bits").bitwiseAND(F.lit(BIT[r])) != 0).alias("failed"), F.col("fail_bits").bitwiseAND(F.lit(~BIT[r])).alias("without")))
    long = groups.select("fail_bits", "n", F.explode(F.array(*parts)).alias("cell")).select("fail_bits", "n", "cell.*")
    taken = reduce(lambda acc, p: acc.when(F.col("policy") == p, verdict(p)), POLICIES, F.when(F.lit(False), F.lit(False)))
    freed = reduce(lambda acc, p: acc.when(F.col("policy") == p, verdict(p, "without")), POLICIES, F.when(F.lit(False), F.lit(False)))
    total = lambda what: F.sum(F.when(what, F.col("n")).otherwise(F.lit(0)))
    return long.groupBy("policy", "rule").agg(total(F.col("failed")).alias("n_failed"), total(~taken).alias("n_rejected"), total(~taken & freed).alias("n_only"))


def accepted(documents: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of documents that the policy keeps, with all their columns; the measurements ride along with the scan, so nothing is shuffled."""
    held = "_weft_" + "_".join(documents.columns)[:200]
    schema = StructType([*documents.schema.fields, StructField(held, StructType([StructField(m, LongType()) for m in _MEASURES]))])

    def ride(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = measure(*text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays([pa.array(found[m]) for m in _MEASURES], list(_MEASURES))], names=[*batch.schema.names, held])

    seen = small_batches(documents).mapInArrow(ride, schema)
    bits = failures(lambda rule: reduce(lambda text, m: re.sub(rf"\b{m}\b", f"`{held}`.{m}", text), _MEASURES, rule))
    none, some, most = POLICIES[policy]
    return seen.where((bits.bitwiseAND(F.lit(BASE | none)) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(some))) < most)).drop(held)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the measurements, base_failed and kept, with the ledger's bits."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return judge(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
c AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM d),
r AS (SELECT doc_id, count(*) AS n FROM c WHERE covered GROUP BY 1),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN r USING (doc_id)),
k AS (SELECT *, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM m),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END
     + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END
     + CASE WHEN n_lines > 3 AND 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END + CASE WHEN n_letters >= 40 AND 100 * n_upper > 60 * n_letters THEN 64 ELSE 0 END
     + CASE WHEN n_words > 1000000 THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (fail_bits & 115) = 0 AS kept, fail_bits FROM f
"""
