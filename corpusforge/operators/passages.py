"""Which chunks contain which passages, without comparing each with each.

A passage of three blank-separated pieces or more has inner pieces, and a text that contains the passage has each of them
between blanks too. The longest inner piece is the passage's key: texts are split once, their distinct pieces are
looked up among the keys, and only where a key is met is the passage looked for. Shorter passages have no such piece; only these, if there
are any, are tried on every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many different keys are looked up inside each row; beyond that, keys and texts' pieces meet in a join.
INLINE = 20_000


def key_of(passage: Column) -> Column:
    """The longest inner piece of a passage (of equal ones the last in order), null if there is none."""
    pieces = F.split(passage, " ")
    inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    return F.when((F.size(pieces) > 2) & (longest["n"] > 0), longest["p"])


def containing(chunks: DataFrame, passages: DataFrame, text: str = "text", passage: str = "anchor", inline: int = INLINE) -> DataFrame:
    """A row for each chunk and passage that it contains: the columns of chunks without text, and of passages.

    No other column may have a name twice. Null texts and passages match nothing; an empty passage is in every text. passages
    is a stated set, whose keys the driver reads; with over `inline` keys the pieces of the texts are joined with them.
    """
    keyed = passages.where(F.col(passage).isNotNull()).withColumn("_key", key_of(F.col(passage)))
    rows = keyed.select("_key").distinct().limit(inline + 1).collect()
    keys = [r[0] for r in rows if r[0] is not None]
    pieces = F.array_distinct(F.split(F.col(text), " "))
    if len(rows) <= inline:
        met = chunks.where(F.col(text).isNotNull()).withColumn("_key", F.explode(F.filter(pieces, lambda p: p.isin(keys)) if keys else F.array().cast("array<string>")))
        found = met.join(keyed.where("_key is not null"), "_key").where(F.contains(text, passage))
        short = len(keys) < len(rows)
    else:
        # The texts themselves aren't multiplied: pairs of a row and a passage are made first, and the texts are met again.
        numbered = chunks.withColumn("_row", F.xxhash64(*chunks.columns))
        pairs = numbered.select("_row", F.explode(pieces).alias("_key")).join(keyed.where("_key is not null"), "_key").drop("_key").distinct()
        found = numbered.join(pairs, "_row").where(F.contains(text, passage)).drop("_row")
        short = not keyed.where("_key is null").isEmpty()
    columns = [*[c for c in chunks.columns if c != text], *passages.columns]
    found = found.select(*columns)
    if short:
        found = found.unionByName(chunks.join(keyed.where("_key is null"), F.contains(text, passage)).select(*columns))
    return found
