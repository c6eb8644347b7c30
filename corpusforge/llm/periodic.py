"""Periodic runs in texts: stretches of words that repeat with a period, found by power-of-two names.

Method (Karp, Miller, Rosenberg). Words are numbered; a block of 2^k words gets a name from the pair of names of its halves,
by sorting pairs, so equal blocks have equal names and no hash is asked. How far two places agree (their LCE) is read off in one
descent through the levels, forward and backward, for all candidates at once in NumPy. A run of period p and length L >= max(24, 3p)
is L - p places that agree with the place p later; so the pairs (i, i + p) on a grid of i, narrow enough that some i has
eight agreeing places before it in which a block of eight starts, hold a candidate of every run. Pairs that agree on a block of eight
are extended both ways. Extension gives the whole run, so candidates of one run collapse; of equal stretches the smallest period
stays (by Fine and Wilf all periods found for a stretch are multiples of it). Higher levels are named only for texts
with a candidate, so ordinary prose costs three levels.

A text is worked on in one task, whole, with memory in proportion to its words times levels; candidates are made in slices of
`SLICE`. Nothing is shuffled. Defined results: a null or empty text has no words and no run; repeated rows give repeated rows,
an empty table none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, utf8

#: A run has this many words at least, and its period this many times.
LEAST, TIMES = 24, 3
#: Level of the blocks that candidates must share: 2^3 words. LEAST and TIMES leave room for one (see `candidates`).
LEVEL = 3
#: Candidates that are made at once.
SLICE = 1 << 20


class Names:
    """Names of all blocks of 2^k words of a sequence of numbers; a level is made when it is asked for."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.levels = [words.astype(np.int64)]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, low = 1 << (len(self.levels) - 1), self.levels[-1]
            pairs = low[: len(low) - half] * (int(low.max(initial=0)) + 1) + low[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        return self.levels[k]

    def top(self) -> int:
        """The highest level at which two blocks are equal; a longer agreement can't be."""
        k = 0
        while (2 << k) <= self.n:
            names = self.level(k + 1)
            if int(names.max()) + 1 == len(names):
                break
            k += 1
        return k

    def forward(self, i: np.ndarray, j: np.ndarray, top: int) -> np.ndarray:
        """How many words from i on and from j on agree, i < j."""
        far = np.zeros(len(i), np.int64)
        for k in range(top, -1, -1):
            names = self.level(k)
            at = j + far
            inside = at < len(names)
            same = inside.copy()
            same[inside] = names[i[inside] + far[inside]] == names[at[inside]]
            far[same] += 1 << k
        return far

    def backward(self, i: np.ndarray, j: np.ndarray, top: int) -> np.ndarray:
        """How many words before i and before j agree, i < j."""
        far = np.zeros(len(i), np.int64)
        for k in range(top, -1, -1):
            names = self.level(k)
            at = i - far - (1 << k)
            inside = at >= 0
            same = inside.copy()
            same[inside] = names[at[inside]] == names[j[inside] - far[inside] - (1 << k)]
            far[same] += 1 << k
        return far


def candidates(names: Names, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, p): places on each period's grid whose next words and those p later agree, 2^LEVEL of them or as many as the shortest run allows.

    A run of period p has M = max(least, times * p) - p agreeing places in a row or more. Of blocks of b of them M - b + 1 start in a
    row, so a grid of that step meets one.
    """
    periods = np.arange(1, names.n // times + 1, dtype=np.int64)
    agree = np.maximum(least, times * periods) - periods
    level = min(LEVEL, int(agree.min()).bit_length() - 1) if len(periods) else 0
    block = names.level(level)
    if not len(block) or int(block.max()) + 1 == len(block):
        return
    step = agree - (1 << level) + 1
    counts = np.maximum(0, -(-(len(block) - periods) // step))
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(periods):
        until = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, "right")))
        p, n = periods[begin:until], counts[begin:until]
        which = np.repeat(np.arange(len(p)), n)
        i = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * step[begin:until][which]
        far = p[which]
        same = block[i] == block[i + far]
        yield i[same], far[same]
        begin = until


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if least < 1 or times < 2:
        raise ValueError("a run has a word and two periods at least")
    if len(words) < least:
        return none
    names, found, top = Names(words), [], None
    for i, p in candidates(names, least, times):
        if len(i):
            top = names.top() if top is None else top
            start = i - names.backward(i, i + p, top)
            end = i + p + names.forward(i, i + p, top)
            whole = end - start >= np.maximum(least, times * p)
            found.append(np.unique(np.stack([start[whole], end[whole], p[whole]], 1), axis=0))
    if not found:
        return none
    every = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    start, end, period = every[first].T
    return np.stack([start, end - start, period], 1)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: one that a run contains after that run's first period goes."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; ties to the smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word, in the order of first use."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


#: What `detect` gives of each text; `collapsed` is the text without what runs repeat.
FOUND = "runs array<struct<start:long,length:long,period:long>>, n_words long, collapsed string"
DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mapped(docs: DataFrame, key: str, text: str, schema: str, of: Callable[[list, list[bytes]], list[pa.Array]]) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column(0), *of(batch.column(0).to_pylist(), utf8(batch.column(1)))], [key, *names])

    slim = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias(text))
    return slim.mapInArrow(run, f"`{key}` long, {schema}")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """key, runs (start, length, period in words), n_words and the collapsed text of every document."""

    def of(_: list, texts: list[bytes]) -> list[pa.Array]:
        found, sizes, bare = [], [], []
        for t in texts:
            words = t.split()
            runs = runs_of(numbered(words), least, times)
            keep = kept_words(len(words), runs)
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
            sizes.append(len(words))
            bare.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k))
        return [pa.array(found, pa.list_(RUN)), pa.array(sizes, pa.int64()), pa.array(bare, pa.binary()).cast(pa.string())]

    return _mapped(docs, key, text, FOUND, of)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the query's contract puts into every tenth text, by the crc32 of its id; none where the id is null."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text; texts with planted repetitions."""

    def of(ids: list, texts: list[bytes]) -> list[pa.Array]:
        rows = []
        for doc_id, t in zip(ids, texts, strict=True):
            words = planted(t.split(), doc_id)
            runs = runs_of(numbered(words))
            keep = kept_words(len(words), runs)
            best = strongest(runs)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
            bare = b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k])
            rows.append((len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(bare).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(columns)]

    return _mapped(docs, "doc_id", "text", DIGEST, of)
