"""Quality rules as a short-circuit cascade, in native expressions only.

Method. Every rule is a boolean expression that rejects a text. On a sample each rule's cost and its rejection share are
estimated; rules run in the order of rejections per cost as the branches of one CASE, so a text that a cheap rule rejects
never reaches the dear ones. The order changes the cost, never the verdict: a text is kept if no rule rejects it. The
sample is the `SAMPLE_ROWS` rows of least hash in the whole table, texts of any length. Cost is work: how many bytes and
words of the sample a rule goes over, times its steps for each, so that every run finds the same order.

All rules share the words of a text, split once. Repeated 8-word windows are found inside one row: word hashes, window
hashes, and only where two window hashes agree a sort of (hash, position). Nothing is shuffled, so hot sources don't
matter. Two different windows count as equal if their 64-bit hashes collide, at odds below n^2 / 2^65 in a text of n words.

`judge` returns the base counts of every row, so these are worked out in any case; its cascade orders what is then left,
comparisons of counts. `keep`, the pipeline's stage, is where the order saves work. A null text has no words: it fails the base
rule on word count. Repeated rows give repeated rows, an empty table none; other columns, whatever their names, are kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SEPARATORS, WORD, let, written

WINDOW = 8
#: Fixed values of the base rules and of the symbol class.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows that steer the order of the cascade.
SAMPLE_ROWS = 400


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _without(text: Column, characters: str) -> Column:
    """text without the (ASCII) characters. Spark's replace looks for bytes, where translate looks up each character."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_chars(text: Column) -> Column:
    return F.length(_without(text, SEPARATORS)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def lines(text: Column) -> Column:
    """A struct of n_lines (lines with a word) and n_dup_lines (those equal to an earlier one)."""
    return let(_worded_lines(text), lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; a window starts at each index of `hashes`."""

    def starts(pairs: Column) -> Column:
        same = lambda p, j: F.coalesce(p["h"] == F.get(pairs, j - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get(pairs, j + 1)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, same), lambda p: p["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    reach = let(let(pairs, starts), lambda s: F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW)))))
    return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)


def n_repeat_words(word_array: Column) -> Column:
    """Words in 8-word windows that occur twice or more in the text, the first occurrence included."""

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))

    hashed = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), of)
    return let(word_array, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(hashed(w)))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_metrics(text: Column) -> Column:
    """A struct of the base counts of one text, and n_lines."""

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), lines(text).alias("lines"), n_repeat_words(w).alias("n_repeat_words"))

    flat = lambda b: F.struct(*[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")], b["lines"]["n_dup_lines"].alias("n_dup_lines"), b["lines"]["n_lines"].alias("n_lines"))
    return let(let(words(text), of), flat)


class Parts:
    """What rules look at: the text, its words, and counts, each worked out where a rule asks for it unless it is known."""

    def __init__(self, text: Column, word_array: Column, known: Column | None = None):
        self.text, self.words, self.known = text, word_array, known

    def count(self, name: str) -> Column:
        if self.known is not None:
            return self.known[name]
        if name in ("n_lines", "n_dup_lines"):
            return lines(self.text)[name]
        return {"n_words": lambda: F.size(self.words), "word_chars": lambda: word_chars(self.text), "n_symbols": lambda: n_symbols(self.text), "n_repeat_words": lambda: n_repeat_words(self.words)}[name]()

    def lines(self) -> Column:
        return lines(self.text) if self.known is None else F.struct(self.known["n_lines"].alias("n_lines"), self.known["n_dup_lines"].alias("n_dup_lines"))


@dataclass(frozen=True)
class Rule:
    """rejects(parts): true if the rule rejects a (never null) text. Its work: steps for each byte of the text and each word."""

    name: str
    rejects: Callable[[Parts], Column]
    byte_steps: float = 0.0
    word_steps: float = 0.0


#: The base rules, as rules of a cascade. Steps: a pass over the characters is one a byte; hashing words and windows forty a word.
BASE_RULES = (
    Rule("too_few_words", lambda p: p.count("n_words") < MIN_WORDS),
    Rule("repeated_windows", lambda p: 100 * p.count("n_repeat_words") > MAX_REPEAT_PERCENT * p.count("n_words"), word_steps=40),
)
#: Rules beyond the base: over a symbol in ten words; half of the lines said before; words too short or long on average.
METHOD_RULES = (
    Rule("symbol_ratio", lambda p: 10 * p.count("n_symbols") > p.count("n_words"), byte_steps=1),
    Rule("duplicate_lines", lambda p: let(p.lines(), lambda x: 2 * x["n_dup_lines"] > x["n_lines"]), byte_steps=2),
    Rule("word_length", lambda p: let(p.count("word_chars"), lambda c: (c < 2 * p.count("n_words")) | (c > 15 * p.count("n_words"))), byte_steps=1),
)


def hashable(kind: T.DataType) -> bool:
    """Whether Spark hashes values of a type: no map or variant in it, however deep."""
    if isinstance(kind, T.ArrayType):
        return hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind)
    return kind.typeName() not in ("map", "variant")


def sample_of(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The texts (null as empty) of the rows of least hash in the whole table. All columns that can be are hashed, so that copies of a text don't come all or none."""
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if hashable(f.dataType)])
    slim = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), hashed.alias("hash"))
    # Only rows below a bound on the hash are sorted, else each task would send its `rows` least. The bound is widened until enough lie below it.
    share = min(1.0, 4 * rows / max(1, docs.count()))
    while True:
        low = written(slim.where(F.col("hash") <= min(int(share * 2**64) - 2**63, 2**63 - 1)), "quality-low")
        if share >= 1 or low.count() >= rows:
            return written(low.orderBy("hash", "text").limit(rows).select("text"), "quality-sample")
        share = min(1.0, 4 * share)


def estimate(sample: DataFrame, rules: tuple[Rule, ...]) -> list[tuple[Rule, float, float]]:
    """(rule, steps of work a text, share rejected) of each rule over the sample."""
    split = sample.select("text", words(F.col("text")).alias("words"))
    parts = Parts(F.col("text"), F.col("words"))
    size, count = F.avg(F.octet_length("text")), F.avg(F.size("words"))
    found = split.agg(F.coalesce(size, F.lit(0.0)), F.coalesce(count, F.lit(0.0)), *[F.coalesce(F.avg(F.when(r.rejects(parts), 1.0).otherwise(0.0)), F.lit(0.0)) for r in rules]).first()
    return [(r, 1 + r.byte_steps * found[0] + r.word_steps * found[1], share) for r, share in zip(rules, found[2:], strict=True)]


def order(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per cost first; among rules that rejected nothing the cheap ones first."""
    return [r for r, _, _ in sorted(estimates, key=lambda e: (-(e[2] / e[1]), e[1], e[0].name))]


def verdict(rules: list[Rule], parts: Parts) -> Column:
    """True if no rule rejects: one CASE, whose branches run in order and stop at the first rejection."""
    out = F
    for r in rules:
        out = out.when(r.rejects(parts), False)
    return out.otherwise(True) if rules else F.lit(True)


def ordered(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> list[Rule]:
    return order(estimate(sample_of(docs, text), rules))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + METHOD_RULES, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, all columns kept."""
    chosen = ordered(docs, rules, text)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.where(let(words(whole), lambda w: verdict(chosen, Parts(whole, w))))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row."""
    chosen = ordered(docs, rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_metrics(text).alias("b"))
    failed = (F.col("b.n_words") < MIN_WORDS) | (100 * F.col("b.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("b.n_words"))
    kept = F.when(failed, False).otherwise(verdict(chosen, Parts(F.lit(None), F.lit(None), F.col("b"))))
    return df.select("doc_id", *[f"b.{c}" for c in BASE], failed.alias("base_failed"), kept.alias("kept"))


#: DuckDB SQL of `judge` with its default rules.
JUDGE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
v AS (SELECT rid, sum(least(8, coalesce(nx - i, 8))) AS covered FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(covered, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN v USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""
