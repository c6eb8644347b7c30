"""Personal data in texts by bootstrapped contextual extraction, in native expressions only.

Base. E-mail addresses, IP addresses, card and phone numbers by pattern, leftmost and without overlap for each kind, failing
matches dropped. Places come from the pieces between matches, whose lengths are summed in blocks, so a text with many
matches stays in proportion. The patterns are written so that Java's matcher neither recurses nor starts anew inside a run of
characters; they match what the plain patterns do (a test compares them).

Method. Every identifier-like token of a text is an instance, with the words around it as contexts: the word before, the
two words before, and the words before and after. Tokens that pass a kind's base check are that kind's seeds. A context that
`SEEDS` or more different seeds fill is a pattern of the kind that most of them have. Patterns and instances are a graph, scored in
`ROUNDS` rounds: a pattern's confidence is the sum of its instances' scores over the number of its different instances and of
the plain words that stand in the same context anywhere in the corpus; an instance's score is the chance that not all of its
patterns are wrong. Seeds keep their scores (1 for their kind, 0 for others), others start at 0. Instances whose score reaches
`LEAST` through patterns that reach it are identifiers, and every occurrence of them that no base span overlaps is a span of that kind.

Scale. Texts are read once, and once more to count plain words, where there are patterns at all. Graph tables hold
identifier-like tokens alone. Sums combine map-side, so hot contexts, values and copies don't gather; keys of contexts are 64-bit
hashes. The set of patterns is broadcast only if it has `BROADCAST_ROWS` rows at most; beyond it, counts are made first and joined.

Defined results: a null text is empty; texts without spans give empty strings (and the hash of one); repeated rows give repeated
rows; rows with equal or null ids each have their own spans; an empty table gives none; other columns, whatever their names, are ignored. Words of a context are looked for in
the `AROUND` characters beside a token, in lower case, digits as 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: The kinds in their order, and the base patterns of the contract in possessive form.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: An identifier-like token: what base patterns match, or a word of letters, digits and marks with a digit or an at sign in it. Without
#: \\G, which would go over the rest of a long run anew after each match.
TOKEN = rf"{PATTERNS['phone']}|(?<!{LOCAL}){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|(?<![0-9])[0-9]++(?:\.[0-9]++){{3}}|[0-9](?:[\x20-]?[0-9]){{11,18}}(?![0-9])|(?<![A-Za-z0-9])(?=[A-Za-z._:/%-]*+[0-9@])[A-Za-z0-9][A-Za-z0-9._@:/%+-]*+(?<=[A-Za-z0-9])"
SHORTEST, LONGEST = 5, 64
AROUND = 64
SEEDS, ROUNDS, LEAST = 3, 3, 0.7
BROADCAST_ROWS = 100_000
BLOCK = 64


def total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def running(sizes: Column) -> Column:
    """Sums of all elements up to each, by blocks: about n * (BLOCK + n / BLOCK^2) steps."""
    blocks = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda b: F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i)))
    block_of = lambda i: F.floor(i / BLOCK).cast("int")
    summed = lambda s: let(let(blocks(s), before), lambda a: F.transform(s, lambda _, i: F.get(a, block_of(i)) + total(F.slice(s, block_of(i) * BLOCK + 1, i % BLOCK + 1))))
    return F.when(F.size(sizes) > 0, summed(sizes)).otherwise(F.array().cast("array<int>"))


def placed(text: Column, pattern: str, of: Callable[[Column, Column, Column, Column, Column], Column]) -> Column:
    """of(match, its number, its end, all matches, the pieces between) of each match, in order."""

    def ends(s: Column) -> Column:
        sizes = F.transform(s["found"], lambda v, i: F.length(v) + F.length(F.get(s["gaps"], i)))
        return let(let(sizes, running), lambda e: F.transform(s["found"], lambda v, i: of(v, i, F.get(e, i), s["found"], s["gaps"])))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), ends)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits has a Luhn check digit."""
    points = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int"))))
    return total(F.transform(points, lambda x: F.coalesce(x, F.lit(0)))) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is one of the kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return let(digits(match), lambda d: F.length(d).between(13, 19) & luhn(d))
    return F.length(digits(match)).between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    """array of (kind number, start, end) of the kind's base matches, in code points, end exclusive."""
    none = F.array().cast("array<struct<k:int,a:int,b:int>>")
    # Failing matches are dropped before places are worked out no more than needed: most texts have no match at all.
    spans = placed(text, PATTERNS[kind], lambda v, i, end, *_: F.when(passes(kind, v), F.struct(F.lit(KINDS.index(kind)).alias("k"), (end - F.length(v)).alias("a"), end.alias("b"))))
    able = text.rlike("[0-9]") if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind]))
    return F.when(able, F.filter(spans, lambda s: s.isNotNull())).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, by kind and start, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(name, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")


def seed_kind(token: Column) -> Column:
    """The number of the kind whose base check a whole token passes, else null."""
    whole = {"email": token.rlike(rf"^{PATTERNS['email']}$"), "ip": token.rlike(rf"^{PATTERNS['ip']}$"), "phone": token.startswith("+"), "card": token.rlike(r"^[0-9](?:[\x20-]?[0-9])++$")}
    out = F
    for kind, matched in whole.items():
        out = out.when(matched & passes(kind, token), F.lit(KINDS.index(kind)))
    return out


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def around(before: Column, after: Column) -> Column:
    """Hashes of the three contexts between two texts; of a text's edge the word is empty."""
    words = lambda t: F.filter(F.split(normal(t), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    left = words(F.substring(before, -AROUND, AROUND))
    right = words(F.substring(after, 1, AROUND))
    word = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))
    return let(F.struct(left.alias("l"), right.alias("r")), lambda s: contexts(word(s["l"], -2), word(s["l"], -1), word(s["r"], 1)))


def contexts(two_before: Column, before: Column, after: Column) -> Column:
    return F.array(F.xxhash64(F.lit("b"), before), F.xxhash64(F.lit("bb"), two_before, before), F.xxhash64(F.lit("ba"), before, after))


def tokens_of(text: Column) -> Column:
    """array of (value, start, end, seed, contexts) of the identifier-like tokens."""

    def of(v: Column, i: Column, end: Column, found: Column, gaps: Column) -> Column:
        before = F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i))
        after = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit("")))
        fits = F.length(v).between(SHORTEST, LONGEST)
        return F.when(fits, F.struct(F.lower(v).alias("value"), (end - F.length(v)).alias("a"), end.alias("b"), seed_kind(v).alias("seed"), around(before, after).alias("contexts")))

    none = F.array().cast("array<struct<value:string,a:int,b:int,seed:int,contexts:array<bigint>>>")
    return F.when(text.rlike("[0-9@]"), F.filter(placed(text, TOKEN, of), lambda t: t.isNotNull())).otherwise(none)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, key, base (spans), tokens of every row, written: the one pass over the texts."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").cast("long").alias(key), whole.alias("t"))
    base = F.concat(*[base_spans(F.col("t"), k) for k in KINDS])
    return written(rows.select("rid", key, base.alias("base"), tokens_of(F.col("t")).alias("tokens")), "pii-scan")


def fillers(scan: DataFrame) -> DataFrame:
    """context, value, seed, n: how often each identifier-like token fills each context."""
    rows = scan.select(F.explode("tokens").alias("t")).select("t.value", "t.seed", F.explode("t.contexts").alias("context"))
    return rows.groupBy("context", "value", "seed").agg(F.count(F.lit(1)).alias("n"))


def candidates(by_value: DataFrame) -> DataFrame:
    """context, kind, n_values, n_rows of the patterns: contexts that SEEDS different seeds of a kind fill; the commonest kind's, ties to the first listed."""
    seeds = [F.count(F.when(F.col("seed") == k, 1)) for k in range(len(KINDS))]
    counted = by_value.groupBy("context").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_rows"), F.array(*seeds).alias("seeds"))
    most = counted.withColumn("most", F.array_max("seeds")).where(F.col("most") >= SEEDS)
    return most.select("context", (F.array_position("seeds", F.col("most")) - 1).cast("int").alias("kind"), "n_values", "n_rows")


def standing(docs: DataFrame, patterns: DataFrame, n: int, text: str = "text") -> DataFrame:
    """context, n: how often each pattern's context stands around any word of the corpus."""
    split = F.filter(F.split(normal(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    word = lambda w, i: F.coalesce(F.get(w, i), F.lit(""))
    every = docs.select(F.explode(let(split, lambda w: F.flatten(F.transform(w, lambda _, i: contexts(word(w, i - 2), word(w, i - 1), word(w, i + 1)))))).alias("context"))
    wanted = patterns.select("context")
    if n <= BROADCAST_ROWS:
        return every.join(F.broadcast(wanted), "context", "left_semi").groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    return every.groupBy("context").agg(F.count(F.lit(1)).alias("n")).join(wanted, "context")


def score_patterns(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """context, kind, confidence. edges: context, kind, size, value, seed; scores: value, kind, score of what isn't a seed."""
    known = edges.join(scores, ["value", "kind"], "left")
    worth = F.when(F.col("seed").isNull(), F.coalesce("score", F.lit(0.0))).when(F.col("seed") == F.col("kind"), 1.0).otherwise(0.0)
    return known.groupBy("context", "kind", "size").agg(F.sum(worth).alias("sum")).select("context", "kind", F.round(F.col("sum") / F.col("size"), 9).alias("confidence"))


def score_values(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """value, kind, score, reached (whether a pattern of its reaches LEAST), of all that aren't seeds."""
    met = edges.where("seed is null").select("context", "value").join(patterns, "context")
    wrong = F.sum(F.log(1 - F.least("confidence", F.lit(0.999999))))
    return met.groupBy("value", "kind").agg(F.round(1 - F.exp(wrong), 9).alias("score"), (F.max("confidence") >= LEAST).alias("reached"))


def discovered(docs: DataFrame, scan: DataFrame, text: str = "text") -> DataFrame | None:
    """value, k: the identifiers that the patterns find, each of the kind of its highest score; None if there is no pattern."""
    by_value = written(fillers(scan), "pii-fillers")
    patterns = written(candidates(by_value), "pii-patterns")
    n = patterns.count()
    if not n:
        return None
    sized = patterns.join(standing(docs, patterns, n, text), "context", "left")
    size = F.col("n_values") + F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - F.col("n_rows"))
    sized = sized.select("context", "kind", size.cast("double").alias("size"))
    # Nothing stands above this join that needs a context's rows together, so a hot context's can be split.
    edges = written(by_value.drop("n").join(sized, "context"), "pii-edges")
    scores = docs.sparkSession.createDataFrame([], "value string, kind int, score double, reached boolean")
    for _ in range(ROUNDS):
        scores = written(score_values(edges, score_patterns(edges, scores)), "pii-scores")
    found = scores.where("reached").where(F.col("score") >= LEAST)
    return found.groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("best")).select("value", (-F.col("best")["col2"]).alias("k"))


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and found: arrays of (k: number of the kind, a: start, b: end) of every row of docs."""
    scan = scanned(docs, key, text)
    named = discovered(docs, scan, text)
    none = F.array().cast("array<struct<k:int,a:int,b:int>>")
    if named is None:
        return scan.select(key, "base", none.alias("found"))
    tokens = scan.select("rid", F.explode("tokens").alias("t")).where("t.seed is null").select("rid", "t.value", "t.a", "t.b")
    spans = tokens.join(named, "value").groupBy("rid").agg(F.collect_list(F.struct("k", "a", "b")).alias("more"))
    free = F.filter("more", lambda s: ~F.exists("base", lambda x: (x["a"] < s["b"]) & (s["a"] < x["b"])))
    met = scan.select("rid", key, "base").join(spans, "rid", "left")
    return met.select(key, "base", F.coalesce(F.when(F.col("more").isNotNull(), free), none).alias("found"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, the digest of the base spans, and all spans as text."""
    spans = extract(docs)
    of = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "found")).alias("spans"))
