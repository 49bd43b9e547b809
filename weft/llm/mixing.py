"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). Raking scales the cells to each of the
three target marginals in turn, ROUNDS times; a cell's weight over its tokens is its
calibrated rate. One factor for all cells turns rates into repeats: a document is drawn with the probability min(1, repeats),
by a hash of its id, so a draw repeats itself on any cluster. The factor is set so that SHARE of all tokens is expected to be
drawn. A cell with too few tokens for its weight is drawn whole and says by `repeats` over 1 how often to
read it; so a rare cell doesn't thin out all others, and tokens times repeats / probability fit the targets.

The topics of the registered query are forms of a text (list, short, medium, long), by its bars and its number of words; they say nothing of its subject.

Scale: only DataFrame operations. Documents are scanned for their cell and tokens, summed on
the map side; what is raked is the cell table, by window sums if it is at most CELLS rows (counted), else by sums combined on the map side.
Documents meet their cell by broadcast if the table is that small, else by a
join on the cell and a salt, so that a source with a third of all rows is spread.

Nulls and repeats: a null source, language or topic is a value of its own (the same as the text \\N); a null or empty text has no tokens and is drawn
with its cell's rate (a cell without tokens has weight 0: rate 0). A null doc_id draws as the text "null". Repeated rows
count twice and draw alike. Targets name values; their weights are scaled to sum 1 over the values that occur,
and a dimension without targets keeps its present marginal. Very long texts are counted whole; an empty table gives no rows. Extra columns are kept by sample().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm._shared import drop_shared, free_name, materialize, only, own, salts

ROUNDS, CELLS, SALTS, DIGITS = 12, 20_000, 16, 10
DIMS = ("source", "lang", "topic")
NONE = "\\N"
SHARE = 0.5
#: Cells of one rate band (a factor of 2 in so many bands) count as one where the factor is sought: a bounded table, at most 5 % of tokens below SHARE.
BANDS = 16

#: What the registered query and the pipeline rake to. Sources: even shares; languages and topics: as stated, others even.
LANGS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}
TOPICS = {"short": 0.15, "medium": 0.45, "long": 0.30, "list": 0.10}

_WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words of a text, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def topic(text: Column, n: Column) -> Column:
    """The form of a text: list if it has a bar between spaces, else by its words. Bullets at line starts don't count, as in the SQL."""
    return F.when(F.coalesce(text.contains(" | "), F.lit(False)), "list").when(n < 100, "short").when(n < 600, "medium").otherwise("long")


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NONE))


def with_cells(documents: DataFrame, named: str = "mix") -> DataFrame:
    """documents with n_tokens and cell (source, lang, topic) in one struct column; its name must be free."""
    n = tokens(F.col("text").cast("string"))
    first = documents.withColumn(named, n)
    return first.withColumn(named, F.struct(F.col(named).alias("n_tokens"), _named("source").alias("source"), _named("lang").alias("lang"), topic(F.col("text").cast("string"), F.col(named)).alias("topic")))


def _goals(targets: dict[str, dict[str, float]], even: tuple[str, ...]) -> dict[str, Column]:
    """For each raked dimension the share of its values, up to one factor for all of them."""
    out = {}
    for dim in DIMS:
        if dim in even:
            out[dim] = F.lit(1.0)
        elif dim in targets:
            mean = sum(targets[dim].values()) / len(targets[dim])
            out[dim] = F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(targets[dim].items()) for x in pair])[F.col(dim)], F.lit(mean))
    return out


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], even: tuple[str, ...] = (), rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, n_tokens, n_docs) with weight, which fits the last raked dimension and nearly the others (see residual).

    targets: dimension -> value -> weight; a value without one gets the mean of the stated ones. even: dimensions with equal shares.
    Up to CELLS cells, all steps are window sums in one plan. Beyond, sums by value are combined on the map side and only their few rows meet the cells again, so
    that a value with most of the cells is spread over all tasks; each step is a table. Both do the same arithmetic."""
    held = materialize(cells.withColumn("weight", F.col("n_tokens").cast("double")))
    out, few = held, held.count() <= CELLS
    for _ in range(rounds):
        for dim, goal in _goals(targets, even).items():
            if few:
                total = F.sum("weight").over(Window.partitionBy(dim))
                out = out.withColumn("weight", F.when(total > 0, F.col("weight") * goal / total).otherwise(F.lit(0.0)))
                continue
            sums = out.groupBy(F.col(dim).alias("_of")).agg(F.sum("weight").alias("_total"))
            scaled = F.when(F.col("_total") > 0, F.col("weight") * goal / F.col("_total")).otherwise(F.lit(0.0))
            new = materialize(out.join(sums, out[dim] == F.col("_of")).withColumn("weight", scaled).drop("_of", "_total"))
            drop_shared(out)
            out = new
    return out


def residual(raked: DataFrame, targets: dict[str, dict[str, float]], even: tuple[str, ...] = ()) -> DataFrame:
    """dimension, residual: how far the share of any value with weight lies from its target at most."""
    parts = []
    for dim, goal in _goals(targets, even).items():
        own = raked.groupBy(dim).agg(F.sum("weight").alias("weight")).where("weight > 0").select("weight", goal.alias("goal"))
        weights, goals = own.agg(F.sum("weight"), F.sum("goal")).first()
        parts.append(own.agg(F.max(F.abs(F.col("weight") / F.lit(weights) - F.col("goal") / F.lit(goals))).alias("residual")).select(F.lit(dim).alias("dimension"), "residual"))
    return reduce(DataFrame.union, parts)


def factor(raked: DataFrame, share: float) -> DataFrame:
    """One row: factor c, so that the sum of min(n_tokens, c * weight) is share of the tokens of cells with a rate, and n, the number of cells.

    That sum is the lowest of T + c * W over all cuts by rate (T: tokens of the cells above the cut, W: weight of the others), so c is the highest (share - T) / W."""
    band = F.when(F.col("rate") > 0, F.floor(F.log2("rate") * BANDS))
    bands = raked.groupBy(band.alias("band")).agg(F.sum("n_tokens").alias("tokens"), F.sum("weight").alias("weight"), F.count("*").alias("n"))
    all_, high = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(F.desc_nulls_last("band"))
    live = F.col("band").isNotNull()
    above = F.coalesce(F.sum("tokens").over(high.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.when(live, F.col("weight"))).over(high.rowsBetween(0, Window.unboundedFollowing))
    goal = F.lit(share) * F.sum(F.when(live, F.col("tokens"))).over(all_)
    return bands.select("n", F.when(live & (rest > 0), (goal - above) / rest).alias("c")).agg(F.max("c").alias("factor"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def calibrate(documents: DataFrame, targets: dict[str, dict[str, float]], even: tuple[str, ...] = (), share: float = SHARE) -> DataFrame:
    """documents with a struct `mix` (`mix_` and so on where documents have that): n_tokens, source, lang, topic, probability, repeats and sampled."""
    return _calibrated(documents, targets, even, share)[0]


def _calibrated(documents: DataFrame, targets: dict[str, dict[str, float]], even: tuple[str, ...], share: float) -> tuple[DataFrame, str]:
    """What calibrate gives, and the name of the struct."""
    mix = free_name(documents, "mix")
    docs = with_cells(documents, mix)
    cells = docs.select(f"{mix}.*").groupBy(*DIMS).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    raked = materialize(rake(cells, targets, even).withColumn("rate", F.when(F.col("n_tokens") > 0, F.col("weight") / F.col("n_tokens")).otherwise(F.lit(0.0))))
    found = factor(raked, share).first()
    c = F.lit(found["factor"] or 0.0)
    repeats = F.round(c * F.col("rate"), DIGITS)
    # One struct with a free name, so that no column of documents clashes with a rate's.
    cell = free_name(docs, "cell")
    rates = raked.select(F.struct(*DIMS, repeats.alias("repeats")).alias(cell))
    same = [F.col(f"{mix}.{d}") == F.col(f"{cell}.{d}") for d in DIMS]
    if found["n"] <= CELLS:
        joined = docs.join(F.broadcast(rates), same, "left")
    else:
        salt = F.pmod(F.xxhash64(F.col("doc_id"), F.col(f"{mix}.n_tokens")), F.lit(SALTS))
        spread = rates.select(cell, salts(SALTS).alias(f"{cell}_salt"))
        joined = docs.join(spread, [*same, salt == F.col(f"{cell}_salt")], "left")
    r = F.coalesce(F.col(f"{cell}.repeats"), F.lit(0.0))
    p = F.least(F.lit(1.0), r)
    return joined.select(*own(documents), F.struct(f"{mix}.*", p.alias("probability"), r.alias("repeats"), (draw(F.col("doc_id")) < p).alias("sampled")).alias(mix)), mix


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from a document's id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets() -> dict[str, dict[str, float]]:
    return {"lang": LANGS, "topic": TOPICS}


def sample(documents: DataFrame, share: float = SHARE, copies: bool = False) -> DataFrame:
    """The drawn rows of documents, with their columns, n_tokens, probability and repeats (n_tokens_ and so on where documents have these columns, which stay).

    copies: a row with repeats over 1 comes that often (the fraction by the draw), so that the drawn tokens themselves fit the targets."""
    drawn, mix = _calibrated(documents, targets(), ("source",), share)
    more = [F.col(f"{mix}.{c}").alias(free_name(documents, c)) for c in ("n_tokens", "probability", "repeats")]
    if not copies:
        return drawn.where(F.col(f"{mix}.sampled")).select(*own(documents), *more)
    whole = F.floor(f"{mix}.repeats")
    often = (whole + (draw(F.col("doc_id")) < F.col(f"{mix}.repeats") - whole).cast("long")).cast("int")
    each = free_name(drawn, "copy")
    return drawn.withColumn(each, F.explode(F.array_repeat(F.lit(0), often))).select(*own(documents), *more)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, its cell, n_tokens, the calibrated probability, repeats, sampled."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang", "source")
    return calibrate(docs, targets(), ("source",)).select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens", "mix.probability", "mix.repeats", "mix.sampled")


def _sql() -> str:
    goal = {"source": "1.0"}
    for dim, own in targets().items():
        goal[dim] = "CASE " + dim + "".join(f" WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in sorted(own.items())) + f" ELSE CAST({sum(own.values()) / len(own)!r} AS DOUBLE) END"
    steps, last = [], "c0"
    for k, dim in enumerate(d for _ in range(ROUNDS) for d in DIMS):
        steps.append(f"c{k + 1} AS (SELECT source, lang, topic, n_tokens, CASE WHEN sum(weight) OVER (PARTITION BY {dim}) > 0 THEN weight * ({goal[dim]}) / sum(weight) OVER (PARTITION BY {dim}) ELSE 0 END AS weight FROM {last})")
        last = f"c{k + 1}"
    return rf"""
WITH n AS (SELECT doc_id, coalesce(source, '\N') AS source, coalesce(lang, '\N') AS lang, coalesce(text, '') AS text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
d AS (SELECT *, CASE WHEN contains(text, ' | ') THEN 'list' WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 600 THEN 'medium' ELSE 'long' END AS topic FROM n),
c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS n_tokens, sum(n_tokens)::DOUBLE AS weight FROM d GROUP BY ALL),
{", ".join(steps)},
r AS MATERIALIZED (SELECT *, CASE WHEN n_tokens > 0 THEN weight / n_tokens ELSE 0 END AS rate FROM {last}),
b AS (SELECT floor(log2(rate) * {BANDS}) AS band, sum(n_tokens) AS tokens, sum(weight) AS weight FROM r WHERE rate > 0 GROUP BY ALL),
f AS (SELECT max(({SHARE!r} * (SELECT sum(tokens) FROM b) - above) / rest) AS c FROM (SELECT coalesce(sum(tokens) OVER (ORDER BY band DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(weight) OVER (ORDER BY band DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM b)),
p AS (SELECT *, least(1.0, repeats) AS probability FROM (SELECT source, lang, topic, round(coalesce((SELECT c FROM f), 0) * rate, {DIGITS}) AS repeats FROM r) AS q)
SELECT doc_id, source, lang, topic, d.n_tokens, probability, repeats,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE < probability AS sampled
FROM d JOIN p USING (source, lang, topic)
"""


OP3_SQL = _sql()
