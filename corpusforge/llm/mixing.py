"""Mixing sources to target weights by iterative proportional fitting, in native expressions only.

Method. Token counts are aggregated into cells of (source, lang, topic). A cell's calibration x is raked: scaled in turn so
that the tokens kept, tokens * min(1, x), meet the target of each source, language and topic, `ROUNDS` times. A cell can't
give more than it has: what its bound of 1 cuts off is made up by the other cells of its group in the same step, so the
targets hold for the sample as drawn. A document is kept with probability min(1, x), drawn from a hash of its doc_id, so
the sample is the same on every run and at every cluster size.

Targets. A value's weight is its tempered token share (tokens ^ exponent) or the caller's; targets are in proportion to
the weights and sum to `rate` of all tokens. A value asked for more than it has gets all it has, and the others share the
rest in proportion; if a dimension's weights can't be met even so, all dimensions aim at the most that it can give.
`shares` lists weights, targets and what the sample is expected to give, so an unreachable wish shows.

Raking touches the cells alone. A step is one aggregation by a dimension, combined before its shuffle (no task holds a language's
cells), and an equi-join with its few factors; each round is written. Documents meet their cell in an equi-join whose small side Spark
broadcasts only after checking its size. Null sources and languages are the group ''. Documents without tokens have
probability 0. A null doc_id draws like the empty text. Repeated rows are drawn alike. An empty table gives no rows.
Results stand in one column whose name no column of the input has, or go away with it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, written

ROUNDS, RATE = 12, 0.6
#: A cell this near its bound counts as full, so that rounding errors can't decide it.
FULL = 1 - 1e-9
#: Tempering exponents of the three marginals.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
Targets = Mapping[str, Mapping[str, float]]


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A topic by the form of the text, for corpora without labels: numbers, symbols, short, prose."""
    return F.when(text.rlike("[0-9]"), "numbers").when(text.rlike("[#$%&*|<>]"), "symbols").when(tokens < 100, "short").otherwise("prose")


def described(docs: DataFrame, into: str, topic: Column | None = None) -> DataFrame:
    """docs with the struct `into` of source, lang, topic, tokens; topic: an expression on docs, else the form."""
    text, count = F.coalesce(F.col("text"), F.lit("")), free_name([*docs.columns, into], "count")
    # A column of its own, which Spark doesn't merge into the several expressions that use it: each word is looked for once.
    docs, tokens = docs.withColumn(count, n_tokens(text)), F.col(count)
    fields = F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(form_topic(text, tokens) if topic is None else topic, F.lit("")).alias("topic"), tokens.alias("tokens")
    return docs.withColumn(into, F.struct(*fields)).drop(count)


def _weighted(cells: DataFrame, d: str, targets: Targets) -> DataFrame:
    """Each value of a dimension with its tokens and its weight."""
    own = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("own"))
    if d in targets:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv]), F.col(d)), F.lit(0.0)).cast("double")
    else:
        weight = F.pow(F.col("own"), F.lit(EXPONENTS[d]))
    return written(own.withColumn("weight", weight), "margin")


def _filled(margin: DataFrame, total: float) -> DataFrame:
    """margin with target: weight times a level, at most own, summing to `total`. The level rises until no more values are full."""
    level, before = 0.0, -1.0
    while level != before:
        full = F.col("weight") * level > F.col("own")
        held, weight = margin.agg(F.coalesce(F.sum(F.when(full, F.col("own"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        before, level = level, max(level, (total - held) / weight) if weight > 0 else level
    return margin.withColumn("target", F.least(F.col("own"), F.col("weight") * level))


def margins(cells: DataFrame, rate: float = RATE, targets: Targets | None = None) -> dict[str, DataFrame]:
    """For each dimension its values with own tokens, weight and target."""
    found = {d: _weighted(cells, d, targets or {}) for d in EXPONENTS}
    reach = [df.agg(F.coalesce(F.sum("own"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("own"))), F.lit(0.0))).first() for df in found.values()]
    total = min(rate * reach[0][0], *[r[1] for r in reach])
    return {d: _filled(df, total) for d, df in found.items()}


def _step(df: DataFrame, d: str) -> DataFrame:
    """Scale x in each group of d so that the tokens kept meet the target, as long as no further cell reaches its bound."""
    bound = F.col("x") >= FULL
    sums = df.groupBy(d).agg(F.max(f"target_{d}").alias("t"), F.sum(F.when(bound, F.col("tokens")).otherwise(0)).cast("double").alias("full"), F.sum(F.when(bound, 0.0).otherwise(F.col("tokens") * F.col("x"))).alias("free"))
    ratio = F.when((F.col("free") > 0) & (F.col("t") > F.col("full")), (F.col("t") - F.col("full")) / F.col("free")).when((F.col("free") <= 0) & (F.col("t") >= F.col("full")), 1.0).otherwise(F.col("t") / (F.col("full") + F.col("free")))
    return df.join(sums.select(d, ratio.alias("ratio")), d).withColumn("x", F.col("x") * F.col("ratio")).drop("ratio")


def rake(cells: DataFrame, rate: float = RATE, targets: Targets | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with probability.

    targets: for a dimension, weights of its values (others get none); a dimension not named is tempered by EXPONENTS.
    """
    df = cells.select(*EXPONENTS, "tokens").withColumn("x", F.lit(float(rate)))
    for d, margin in margins(cells, rate, targets).items():
        df = df.join(margin.select(d, F.col("target").alias(f"target_{d}")), d)
    for _ in range(rounds):
        for d in EXPONENTS:
            df = _step(df, d)
        df = written(df, "raked")
    return df.select(*EXPONENTS, "tokens", F.least(F.lit(1.0), F.col("x")).alias("probability"))


def cells_of(described_docs: DataFrame, into: str) -> DataFrame:
    m = F.col(into)
    fields = described_docs.select(m["source"].alias("source"), m["lang"].alias("lang"), m["topic"].alias("topic"), m["tokens"].alias("tokens"))
    # Texts without tokens go after the sum: a filter before it would count the words once more.
    return written(fields.groupBy(*EXPONENTS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")


def shares(docs: DataFrame, rate: float = RATE, topic: Column | None = None, targets: Targets | None = None) -> DataFrame:
    """dimension, value, own (tokens), weight, target (tokens), expected (tokens kept in expectation) of every value."""
    cells = cells_of(described(docs.select(*docs.columns), into := free_name(docs.columns, "mix"), topic), into)
    raked, out = rake(cells, rate, targets), None
    for d, margin in margins(cells, rate, targets).items():
        kept = raked.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")).alias("expected"))
        rows = margin.join(kept, d).select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "own", "weight", "target", "expected")
        out = rows if out is None else out.unionByName(rows)
    return out


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixed(docs: DataFrame, into: str, rate: float = RATE, topic: Column | None = None, targets: Targets | None = None) -> DataFrame:
    """docs with the struct `into` (a name that docs doesn't have): source, lang, topic, tokens, probability, kept."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {into}")
    df = described(docs, into, topic)
    raked = rake(cells_of(df, into), rate, targets)
    cell = free_name([*docs.columns, into], "cell")
    raked = raked.select(F.struct(*[F.col(d).alias(f"{d}") for d in EXPONENTS]).alias(cell), F.struct("probability").alias(p := free_name([*docs.columns, into, cell], "p")))
    m = F.col(into)
    out = df.join(raked, F.struct(*[m[d].alias(d) for d in EXPONENTS]) == F.col(cell), "left")
    probability = F.when(m["tokens"] > 0, F.coalesce(F.col(p)["probability"], F.lit(0.0))).otherwise(0.0)
    out = out.withColumn(into, m.withField("probability", probability))
    return out.withColumn(into, m.withField("kept", draw(docs["doc_id"]) < m["probability"])).drop(cell, p)


def sample(docs: DataFrame, rate: float = RATE, **more) -> DataFrame:
    """The rows of docs that the draw keeps, its columns alone, whatever their names."""
    into = free_name(docs.columns, "mix")
    return mixed(docs, into, rate, **more).where(F.col(into)["kept"]).drop(into)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability (to six places; the draw uses all), kept of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    m = F.col("mix")
    return mixed(slim, "mix").select("doc_id", m["source"].alias("source"), m["lang"].alias("lang"), m["topic"].alias("topic"), m["tokens"].alias("n_tokens"), F.round(m["probability"], 6).alias("probability"), m["kept"].alias("kept"))


def judged_sql(rounds: int = ROUNDS, rate: float = RATE) -> str:
    """DuckDB SQL of `judged`. Levels come from sorted running sums; the rounds are written out as one query each."""
    fills, joins = [], []
    for d, e in EXPONENTS.items():
        fills.append(f"""m_{d} AS MATERIALIZED (SELECT {d}, sum(tokens)::DOUBLE AS own, pow(sum(tokens)::DOUBLE, {e}) AS w FROM c GROUP BY {d}),
l_{d} AS MATERIALIZED (SELECT arg_min(level, k) AS level FROM (SELECT own, w, row_number() OVER (ORDER BY own / w, {d}) AS k, ((SELECT {rate} * sum(tokens) FROM c) - coalesce(sum(own) OVER (ORDER BY own / w, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY own / w, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM m_{d}) WHERE level * w <= own)""")
        joins.append(f"(SELECT least(own, w * level) FROM m_{d}, l_{d} WHERE m_{d}.{d} = c.{d}) AS t_{d}")
    steps, last = [], "s0"
    for _ in range(rounds):
        for d in EXPONENTS:
            full, free = f"sum(CASE WHEN x >= {FULL!r} THEN tokens ELSE 0 END) OVER (PARTITION BY {d})", f"sum(CASE WHEN x >= {FULL!r} THEN 0.0 ELSE tokens * x END) OVER (PARTITION BY {d})"
            steps.append(f"""s{len(steps) + 1} AS MATERIALIZED (SELECT * EXCLUDE (a, b) REPLACE (x * CASE WHEN b > 0 AND t_{d} > a THEN (t_{d} - a) / b WHEN b <= 0 AND t_{d} >= a THEN 1.0 ELSE t_{d} / (a + b) END AS x)
  FROM (SELECT *, {full} AS a, {free} AS b FROM {last}))""")
            last = f"s{len(steps)}"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
        len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n_tokens FROM documents),
x AS (SELECT *, CASE WHEN regexp_matches(t, '[0-9]') THEN 'numbers' WHEN regexp_matches(t, '[#$%&*|<>]') THEN 'symbols' WHEN n_tokens < 100 THEN 'short' ELSE 'prose' END AS topic FROM d),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM x WHERE n_tokens > 0 GROUP BY ALL),
{", ".join(fills)},
s0 AS MATERIALIZED (SELECT source, lang, topic, tokens, {rate}::DOUBLE AS x, {", ".join(joins)} FROM c),
{", ".join(steps)},
p AS (SELECT source, lang, topic, least(1.0, x) AS p FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(CASE WHEN n_tokens > 0 THEN coalesce(p, 0.0) ELSE 0.0 END, 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < CASE WHEN n_tokens > 0 THEN coalesce(p, 0.0) ELSE 0.0 END AS kept
FROM x LEFT JOIN p USING (source, lang, topic)
"""
