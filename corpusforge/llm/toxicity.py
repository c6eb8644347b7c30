"""Toxicity by a counterfactual-regularised linear classifier.

Method. Logistic regression on binary features of a text's distinct words: the word and its first 3 to 6 characters.
Features are those that part the classes, of either sign, and always all of the identity terms: a term shares beginnings
with ordinary words, and so would carry their weights. In each labelled text a sentence with an identity term gives
copies in which others of its group are swapped in; a text without any has one put into a sentence of its own (which,
its hash says) and swapped there. The squared change of the log-odds from a sentence to its counterfactual is a penalty
beside the log-loss. So a mention of a group moves scores little by itself, which lowers false positives on neutral mentions.

The classifier is fitted on the driver on a bounded sample of labelled rows (`SAMPLE` of each class, by the hash of
doc_id); all texts are then scored whole where they lie. Labels, lang, source and doc_id are never inputs. A null text
counts as empty and has the score of the intercept. Rows with a null label or id teach nothing; of an id with several
texts the one of least hash teaches, and its label is the largest. If one class has no labelled row, every score is the
base rate. Repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, held_out, written

#: Labelled rows of each class that the classifier is fitted on at most.
SAMPLE = 6000
THRESHOLD = 0.3
#: Characters stripped from the ends of a word.
STRIPPED = ".,;:!?\"'()[]{}<>#*$%&|-_/\\…«»“”„‘’¿¡"
#: Groups of identity terms; a term is swapped within its group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
#: Feature selection: least documents with it, least z-score (of either sign), most features beside those of identity terms.
LEAST_DOCS, LEAST_Z, FEATURES = 4, 3.0, 2000
#: Strength of the penalties; steps of the fit.
L2, COUNTERFACTUAL, STEPS = 1e-4, 1.0, 400
#: Lengths of the beginnings that are features.
BEGINNINGS = range(3, 7)
MEMO = 300_000


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


def features_of(word: str) -> tuple[str, ...]:
    """The features of one lower-cased word: itself and its beginnings (marked by a hyphen)."""
    w = word.strip(STRIPPED)
    if not w:
        return ()
    return (w, *(f"{w[:k]}-" for k in BEGINNINGS if len(w) > k))


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: dict[str, float]

    def logit(self, words: set[str]) -> float:
        found = {f for w in words for f in features_of(w) if f in self.weights}
        return self.intercept + sum(self.weights[f] for f in sorted(found))


@dataclass(frozen=True)
class Row:
    """A labelled text as features (indices), and its counterfactuals as the features that each gains and loses."""

    label: int
    features: list[int]
    changes: list[tuple[list[int], list[int]]]


SWAPS = {t: tuple(x for x in group if x != t) for group in IDENTITY_GROUPS for t in group}
TERMS = tuple(sorted(SWAPS))
#: Features that the classifier always has.
FORCED = tuple(sorted({f for t in TERMS for f in features_of(t)}))


def sentences_of(text: str) -> list[set[str]]:
    """The distinct lower-cased words of each sentence that has any."""
    return [w for s in re.split(r"[.!?\n]+", text) if (w := words_of(s))]


def counterfactuals(text: str) -> list[tuple[set[str], set[str]]]:
    """(sentence, its counterfactual): each identity term swapped; in a text without any, one is put into a sentence and swapped there."""
    import xxhash

    sentences, out = sentences_of(text), []
    for words in sentences:
        bare = {w.strip(STRIPPED): w for w in words}
        out += [(words, words - {bare[t]} | {other}) for t in sorted(bare.keys() & SWAPS.keys()) for other in SWAPS[t]]
    if not out:
        number = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
        words = sentences[number % len(sentences)] if sentences else set()
        term = TERMS[(number >> 32) % len(TERMS)]
        out = [(words, words | {term})] + [(words | {term}, words | {other}) for other in SWAPS[term]]
    return out


def row_of(text: str, label: int, index: dict[str, int]) -> Row:
    of = lambda ws: {index[f] for w in ws for f in features_of(w) if f in index}
    changed = {(tuple(sorted(y - x)), tuple(sorted(x - y))) for x, y in ((of(a), of(b)) for a, b in counterfactuals(text))}
    return Row(label, sorted(of(words_of(text))), [(list(g), list(x)) for g, x in sorted(changed) if g or x])


def z_score(ones: float, zeros: float, n1: float, n0: float) -> float:
    """How far a feature's share among toxic texts is above (or below) that among others, in standard errors."""
    pooled = (ones + zeros + 1) / (n1 + n0 + 2)
    return (ones / n1 - zeros / n0) / float(np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0)))


def optimise(rows: list[Row], names: list[str], class_weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit weights by gradient steps on log-loss, L2 and the counterfactual penalty. class_weights: of a row of class 0 and of 1."""
    y = np.array([r.label for r in rows], np.float64)
    row = np.where(y == 1, class_weights[1], class_weights[0])
    total = float(row.sum())
    if not len(rows) or y.min() == y.max():
        rate = (float((row * y).sum()) + 0.05) / (total + 1)
        return Model(float(np.log(rate / (1 - rate))), {})
    at = np.repeat(np.arange(len(rows)), [len(r.features) for r in rows])
    column = np.array([k for r in rows for k in r.features], np.int64)
    changes = [c for r in rows for c in r.changes]
    pair = np.array([j for j, c in enumerate(changes) for part in c for _ in part], np.int64)
    changed = np.array([k for c in changes for part in c for k in part], np.int64)
    sign = np.array([s for gained, lost in changes for s in [1.0] * len(gained) + [-1.0] * len(lost)])
    n, width = len(y), len(names)
    w, b = np.zeros(width), float(np.log((row * y).sum() / (row * (1 - y)).sum()))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[column], n) + b, -30, 30)))
        error = row * (p - y) / total
        gradient = np.bincount(column, error[at], width) + L2 * w
        if changes:
            moved = np.bincount(pair, sign * w[changed], len(changes))
            gradient += COUNTERFACTUAL / len(changes) * np.bincount(changed, sign * moved[pair], width)
        g = np.append(gradient, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(b, {f: float(k) for f, k in zip(names, w, strict=True)})


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of a few labelled texts in memory (the same steps as `train`)."""
    ones, zeros = Counter(), Counter()
    for t, label in zip(texts, labels, strict=True):
        (ones if label else zeros).update({f for w in words_of(t) for f in features_of(w)})
    n1, n0 = sum(labels), len(labels) - sum(labels)
    scored = [(z_score(ones[f], zeros[f], n1, n0), f) for f in ones.keys() | zeros.keys() if ones[f] + zeros[f] >= LEAST_DOCS] if n1 and n0 else []
    names = named([f for z, f in sorted(scored, key=lambda x: (-abs(x[0]), x[1]))[:FEATURES] if abs(z) >= LEAST_Z])
    index = {f: i for i, f in enumerate(names)}
    return optimise([row_of(t, label, index) for t, label in zip(texts, labels, strict=True)], names)


def named(chosen: list[str]) -> list[str]:
    """Chosen and forced features in a fixed order."""
    return sorted({*chosen, *FORCED})


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows of docs that are not held out; `sample` of each class at most.

    Texts stay on the executors: features are counted there, and the driver gets the chosen ones and their indices.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"), modulus)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # Of a fixed number of rows, 2 * sample, so that the side below has a proven bound.
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text"))).alias("first")
    picked = written(picked.groupBy("doc_id", "toxic").agg(first).select("doc_id", "toxic", F.col("first.text").alias("text")), "labelled")
    sizes = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 512):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[label].update({f for w in words_of(text) for f in features_of(w)})
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[f] for f in names], pa.int64()) for c in seen]], names=["feature", "zeros", "ones"])

    names: list[str] = []
    if n1 and n0:
        counted = picked.mapInArrow(count, "feature string, zeros long, ones long").groupBy("feature").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
        pooled = (F.col("ones") + F.col("zeros") + 1) / (n1 + n0 + 2)
        z = (F.col("ones") / n1 - F.col("zeros") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
        best = counted.where(F.col("ones") + F.col("zeros") >= LEAST_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "feature").limit(FEATURES)
        names = named([r["feature"] for r in best.collect()])
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})  # FEATURES and the forced ones at most

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 512):
            rows = [row_of(t, label, index.value) for t, label in zip(*[batch.column(c).to_pylist() for c in ("text", "toxic")], strict=True)]
            changes = [[{"gained": g, "lost": x} for g, x in r.changes] for r in rows]
            kind = pa.list_(pa.struct([("gained", pa.list_(pa.int32())), ("lost", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.label for r in rows], pa.int32()), pa.array([r.features for r in rows], pa.list_(pa.int32())), pa.array(changes, kind)], names=["doc_id", "label", "features", "changes"])

    schema = "doc_id long, label int, features array<int>, changes array<struct<gained: array<int>, lost: array<int>>>"
    table = picked.mapInArrow(reduce, schema).toArrow().sort_by("doc_id").to_pylist()
    rows = [Row(r["label"], r["features"], [(c["gained"], c["lost"]) for c in r["changes"]]) for r in table]
    return optimise(rows, names, (counts.get(0, 0) / max(1, n0), counts.get(1, 0) / max(1, n1)))  # classes weigh as in all labels


def score(docs: DataFrame, model: Model, modulus: int = 4, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in arrow_rows(batches, 256):
            scores = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), modulus).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


class _Scorer:
    """Scores texts; remembers which features each word has, mostly none."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, tuple[str, ...]] = {}
        #: All features of a word begin alike, so a word that begins like no feature has none.
        self.starts = {f[: BEGINNINGS[0]] for f in model.weights}

    def score(self, text: str) -> float:
        memo, starts, first, weights, found = self.memo, self.starts, BEGINNINGS[0], self.model.weights, set()
        for w in words_of(text):
            if w.strip(STRIPPED)[:first] not in starts:
                continue
            if (hit := memo.get(w)) is None:
                hit = tuple(f for f in features_of(w) if f in weights)
                if len(memo) > MEMO:
                    memo.clear()
                if len(w) <= 40:
                    memo[w] = hit
            if hit:
                found.update(hit)
        return float(1 / (1 + np.exp(-np.clip(self.model.intercept + sum(weights[f] for f in sorted(found)), -500, 500))))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")  # as Spark resolves it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in arrow_rows(batches, 256):
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
