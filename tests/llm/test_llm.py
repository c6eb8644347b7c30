"""The training-data operators against brute force, and their edge cases."""

import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import ann, byte_bpe, components, mixing, ppm, quality_cascade, sharding, simhash, similar, token_counts, token_store, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string"
BPE, WORD_BPE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


def table(spark, texts, ids=None):
    """Documents with nulls and two columns whose names clash with results."""
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", None if t is None else len(t), 7, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


TEXTS = [None, "", " \t\n", "one", "one two", "One two three four", "one two three four", LONG, "naïve Ünïcode — 中文 😀 𝐼 \x00 end", "a b c d e f g h i\na b c d e f g h i\nx", "repeat me now please " * 30, "one two three four"]


def empty(spark):
    return table(spark, [])


# 1 token counts
def test_token_counts(spark):
    from tiktoken import Encoding

    enc = Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(spark, BPE), special_tokens={})
    lengths = [len(enc.encode_ordinary(t or "")) for t in TEXTS]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(table(spark, TEXTS), BPE, P.PATTERN)))
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert set(rows) == set(lengths)
    for x, r in rows.items():
        assert r["n_docs"] == lengths.count(x)
        assert r["docs_at_least"] == sum(n >= x for n in lengths) and r["tokens_at_least"] == sum(n for n in lengths if n >= x)
        assert r["truncated_tokens"] == sum(min(n, x) for n in lengths) and r["total_tokens"] == sum(lengths)
        assert r["quantile"] == sum(n <= x for n in lengths) / len(lengths)
    for r in token_counts.at_limits(sums, [0, 3, 5, 10**9]).collect():
        assert (r["docs_over"], r["tokens_kept"]) == (sum(n > r["context_limit"] for n in lengths), sum(min(n, r["context_limit"]) for n in lengths))
    assert token_counts.quantiles(sums, [0.5]).first()["n_tokens"] == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(empty(spark), BPE, P.PATTERN))).count() == 0


# 2 SimHash
def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    """{doc: smallest doc reachable} by comparing all pairs."""
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d, _ in fps}


def test_simhash_matches_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 200)]
    texts = TEXTS + [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(0, 200, 7)] + [" ".join(f"z{x}" for x in rng.integers(0, 900, 60)) for _ in range(30)]
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in enumerate(texts)]
    groups = brute_groups(fps)
    assert got == {d: (fp, groups[d]) for d, fp in fps}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_within_three_bits_are_never_lost(spark):
    rng = np.random.default_rng(11)
    center = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = {int(c) for c in center}
    for c in center:
        for bits in range(1, 6):
            x = int(c)
            for b in rng.choice(64, bits, replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    hub = int(center[0])
    fps |= {hub ^ (1 << b) for b in range(64)} | {hub ^ (1 << b) ^ (1 << (b * 7 + 3) % 64) for b in range(64)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(signed))], "doc_id long, fp long")
    got = {r["fp"] & (1 << 64) - 1: r["component_id"] for r in simhash.group_table(df).collect()}
    assert got == {x & (1 << 64) - 1: g for (d, x), g in zip(enumerate(sorted(signed)), brute_groups([(i, x & (1 << 64) - 1) for i, x in enumerate(sorted(signed))]).values(), strict=True)}


def test_simhash_keeps_one_of_each_group(spark):
    """Equal doc_ids of different groups each keep their row; other columns stay, whatever their names."""
    texts = ["same text here now", "same text here now", "other words entirely different", None, "same text here now"]
    docs = table(spark, texts, [5, 3, 3, None, None]).unionByName(table(spark, ["lone null id text", "lone null id text"], [None, None]))
    docs = docs.withColumns({c: F.lit(1) for c in ("_keep", "_fp", "_doc", "_hash", "text_hash", "root")})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "lone null id text"), (3, "other words entirely different"), (3, "same text here now")]
    assert simhash.keep_one(empty(spark)).count() == 0


def shingle_groups(texts, width=5):
    """Components of all pairs with 5-word Jaccard of 0.8 or more, by brute force."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def near_copies(seed=8):
    """Copies of a few passages with up to twelve words in 120 changed, unlike texts that share a passage, and TEXTS."""
    rng = np.random.default_rng(seed)
    texts = []
    for p in range(4):
        base = [f"w{p}x{x}" for x in rng.integers(0, 500, 120)]
        for k in range(14):
            own = list(base)
            for at in rng.choice(120, k % 7 * (1 + k // 7), replace=False).tolist():
                own[at] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(own))
    shared = [f"shared{i}" for i in range(60)]
    texts += [" ".join(shared + [f"own{k}y{i}" for i in range(10 + k)]) for k in range(20)]
    return texts + TEXTS


@pytest.mark.parametrize(("small", "heavy"), [(8, 0), (8, 1 << 14), (1, 0), (1, 300), (1, 1 << 14)])
def test_pipeline_near_duplicates_match_all_pairs_of_shingles(spark, monkeypatch, small, heavy):
    """Pairs of any size, and keys of which none, some or all are heavy, give the same groups."""
    import corpus_pipeline

    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "HEAVY", heavy)
    monkeypatch.setattr(similar, "BLOCK", 4 if small == 1 else 4_096)
    texts = near_copies()
    kept = sorted(r["doc_id"] for r in corpus_pipeline.one_of_near_duplicates(spark, table(spark, texts), "").collect())
    assert kept == sorted(set(shingle_groups(texts)))
    assert corpus_pipeline.one_of_near_duplicates(spark, empty(spark), "").count() == 0
    clash = table(spark, texts).withColumns({c: F.lit(1) for c in ("text_hash", "_text_hash", "_doc", "_hash", "node", "_keep", "_fp")})
    out = corpus_pipeline.one_of_near_duplicates(spark, clash, "")
    assert out.columns == clash.columns and sorted(r["doc_id"] for r in out.collect()) == kept


def test_pipeline_keeps_a_row_of_each_group_with_equal_ids(spark):
    import corpus_pipeline

    texts = ["same text here now", "same text here now", "other words entirely different", None, "same text here now", "lone null id text"]
    kept = corpus_pipeline.one_of_near_duplicates(spark, table(spark, texts, [5, 3, 3, None, None, None]), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, "lone null id text"), (3, "other words entirely different"), (3, "same text here now")]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    ends = spark.createDataFrame([(1, None), (None, 2), (None, None), (4, 3), (3, 4), (4, 3)], "a long, b long")
    assert sorted(map(tuple, components.components(ends).collect())) == [(3, 3), (4, 3)]


# 3 mixing
def brute_raked(cells, rate, weights, rounds=400):
    """Probabilities from the targets alone: each group's factor by bisection, to convergence."""
    tokens = np.array([c[3] for c in cells], float)
    groups, total = [], rate * tokens.sum()
    for k, d in enumerate(("source", "lang", "topic")):
        values = sorted({c[k] for c in cells})
        member = np.array([values.index(c[k]) for c in cells])
        own = np.bincount(member, tokens)
        groups.append((d, values, member, own, np.array([weights[d].get(v, 0.0) for v in values]) if d in weights else own ** mixing.EXPONENTS[d]))
    total = min([total, *(own[w > 0].sum() for *_, own, w in groups)])

    def solve(f, want):
        low, high = 0.0, 1.0
        while f(high) < want * (1 - 1e-12) and high < 1e15:
            high *= 2
        for _ in range(200):
            low, high = ((low + high) / 2, high) if f((low + high) / 2) < want else (low, (low + high) / 2)
        return high

    targets = [(member, np.minimum(own, w * solve(lambda level, own=own, w=w: np.minimum(own, w * level).sum(), total))) for _, _, member, own, w in groups]
    x = np.full(len(cells), rate)
    for _ in range(rounds):
        for member, target in targets:
            for g, want in enumerate(target):
                at = member == g
                x[at] *= solve(lambda a, at=at: (tokens[at] * np.minimum(1, a * x[at])).sum(), want)
    return np.minimum(1, x), targets, groups


def test_raking_meets_the_targets_within_its_bounds(spark):
    rng = np.random.default_rng(2)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(1, 10**5))) for i in range(6) for j in range(3) for k in range(2)]
    schema = "source string, lang string, topic string, tokens long"
    for want, rate in (({"lang": {"l0": 0.2, "l1": 0.3, "l2": 0.5}}, 0.6), ({}, 0.7), ({"lang": {"l0": 1.0}}, 0.6)):
        rows = {tuple(r)[:3]: r["probability"] for r in mixing.rake(spark.createDataFrame(cells, schema), rate, want, rounds=25).collect()}
        got = np.array([rows[c[:3]] for c in cells])
        assert ((got >= 0) & (got <= 1)).all()
        if len(want.get("lang", {})) == 1:  # all of l0 and its sources' shares can't be had together: nothing else is taken
            assert all(p == 0 for p, c in zip(got, cells, strict=True) if c[1] != "l0") and got.sum() > 0
            continue
        p, targets, _ = brute_raked(cells, rate, want)
        tokens = np.array([c[3] for c in cells], float)
        assert abs(got - p).max() < 2e-3
        for member, target in targets:
            assert abs(np.bincount(member, tokens * got) / target - 1).max() < 1e-3


def test_mixing_realised_shares_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.judged(docs).toPandas()
    wanted = {(r["dimension"], r["value"]): r for r in mixing.shares(docs).collect()}
    assert all(abs(r["expected"] / r["target"] - 1) < 1e-3 for r in wanted.values())
    for d in ("source", "lang", "topic"):
        for value, own in rows.groupby(d):
            kept = float((own["n_tokens"] * own["kept"]).sum())
            error = float(np.sqrt((own["n_tokens"].astype(float) ** 2 * own["probability"] * (1 - own["probability"])).sum()))
            assert abs(kept - wanted[d, value]["target"]) <= 4 * error + 1e-3 * kept, (d, value)


def test_mixing_draws_by_id_and_handles_edges(spark):
    out = mixing.judged(table(spark, TEXTS)).collect()
    assert len(out) == len(TEXTS) and all(not r["kept"] for r in out if r["n_tokens"] == 0)
    for r in out:
        u = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:13], 16) / 2**52
        assert abs(u - r["probability"]) < 1e-6 or r["kept"] == (u < r["probability"])
        assert 0 <= r["probability"] <= 1
    clash = table(spark, TEXTS).withColumns({c: F.lit(c) for c in ("mix", "cell", "p", "_tokens", "tokens", "topic", "kept", "x", "probability")})
    kept = mixing.sample(clash).collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in out if r["kept"]}
    assert all(list(r.asDict()) == clash.columns and r["mix"] == "mix" and r["_tokens"] == "_tokens" for r in kept)
    assert mixing.judged(empty(spark)).count() == 0 and mixing.sample(empty(spark)).count() == 0 and mixing.shares(empty(spark)).count() == 0


# 4 nearest neighbours
def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v] if v is not None else None, 1, "q") for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<float>, list int, rank string")


def ann_recall(spark, x, k=10):
    """Share of the true neighbours found; every score must be exact and every list full."""
    got = defaultdict(list)
    for r in ann.neighbours(vectors(spark, x), F.col("vec_id") % 100 == 0, k).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        assert all(abs(d[i] - s) < 1e-12 for i, s in got[q]) and len(got[q]) == min(k, len(x) - 1) and q not in dict(got[q])
        hits += len(set(np.argsort(d, kind="stable")[:k].tolist()) & {i for i, _ in got[q]})
    return hits / (k * len(range(0, len(x), 100)))


def test_ann_recall_and_exact_scores(spark):
    assert ann_recall(spark, np.random.default_rng(3).normal(size=(3000, 16)).astype(np.float32)) >= 0.9


def test_ann_looks_into_few_rows_where_vectors_cluster(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(200, 24))[rng.integers(0, 200, 12_000)] + 0.2 * rng.normal(size=(12_000, 24))).astype(np.float32)
    shares = []
    calibrated = ann.calibrated_share
    monkeypatch.setattr(ann, "calibrated_share", lambda *a: shares.append(calibrated(*a)) or shares[-1])
    assert ann_recall(spark, x) >= 0.9 and shares[0] < 0.2


def test_ann_sample_and_distances_are_bounded_in_bytes(spark, monkeypatch):
    """Long vectors: a smaller sample and fewer lists, no more distances at a time, the same recall."""
    x = np.random.default_rng(8).normal(size=(2000, 16)).astype(np.float32)
    whole = ann.fit(x.astype(float)[:800], 40)
    sizes, most, fit, squares = [], [], ann.fit, ann._squares
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 500 * 16 * 8)
    monkeypatch.setattr(ann, "AT_ONCE", 1 << 10)
    monkeypatch.setattr(ann, "_squares", lambda a, b: most.append(len(a) * len(b)) or squares(a, b))
    assert (ann._nearest(x.astype(float), whole.centroids) == np.argmin(squares(x.astype(float), whole.centroids), axis=1)).all()
    assert len(ann._nearest(x[:0], whole.centroids)) == 0 and max(most) <= 1 << 10
    monkeypatch.setattr(ann, "fit", lambda sample, lists: sizes.append((len(sample), lists)) or fit(sample, lists))
    assert ann_recall(spark, x) >= 0.9 and sizes == [(500, 31)]


def test_ann_answers_can_be_longer_than_the_reranked_list(spark):
    x = np.random.default_rng(6).normal(size=(600, 8)).astype(np.float32)
    assert ann_recall(spark, x, 550) >= 0.9


def test_ann_many_copies_crowd_nothing_out(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[300:1200] = x[0] + 0.3
    rows = ann.neighbours(vectors(spark, x), F.col("vec_id").isin(0, 700)).collect()
    of = lambda q: [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(700) == [(i, 0.0) for i in range(300, 310)]
    d = np.sqrt(((x.astype(float) - x[0].astype(float)) ** 2).sum(1))
    d[0] = np.inf
    assert [i for i, _ in of(0)] == np.lexsort((np.arange(1500), d))[:10].tolist()


def test_ann_ties_bad_vectors_and_few_rows(spark):
    good = [[1.0, 0, 0]] * 40 + [[0.0, 1, 0]]
    bad = [None, [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0]]
    df = vectors(spark, good).unionByName(spark.createDataFrame([(100 + i, v, 1, "q") for i, v in enumerate(bad)] + [(None, [1.0, 0.0, 0.0], 1, "q")], "vec_id long, embedding array<float>, list int, rank string"))
    rows = ann.neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == list(range(1, 11)) and all(r["score"] == 0 for r in rows)
    few = ann.neighbours(vectors(spark, good[-2:]), F.col("vec_id") >= 0).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(0, 1), (1, 0)}
    assert ann.neighbours(vectors(spark, []), F.col("vec_id") >= 0).count() == 0
    # Lengths are searched apart; a repeated id is one query and no candidate of its own.
    mixed = vectors(spark, [[1.0, 2.0], [1.0, 3.0], [0.5, 0.5, 0.5], [0.5, 0.5, 1.5]], [7, 8, 8, 9])
    got = {(r["query_id"], r["vec_id"], round(r["score"], 9)) for r in ann.neighbours(mixed, F.col("vec_id") >= 0).collect()}
    assert got == {(7, 8, 1.0), (8, 7, 1.0), (8, 9, 1.0), (9, 8, 1.0)}
    again = ann.neighbours(vectors(spark, [[1.0, 0.0], [1.0, 0.5], [3.0, 0.0]], [1, 1, 2]), F.col("vec_id") == 1).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in again] == [(1, 2, 2.0)]


# 5 toxicity
def labelled(spark, n=400):
    rng = np.random.default_rng(9)
    texts, toxic = [], []
    for i in range(n):
        words = [f"word{x}" for x in rng.integers(0, 300, 40)]
        bad = i % 5 == 0
        if bad:
            words[3] = "idiot" if i % 2 else "scumlike"
        if i % 3 == 0:
            words[7] = "muslim"
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return table(spark, texts), spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (10**6, 0, None)], "doc_id long, quality int, toxic int"), toxic


def test_toxicity_on_held_out_rows(spark):
    docs, labels, toxic = labelled(spark)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(held) > 50 and all(r["predicted"] == toxic[r["doc_id"]] for r in held)


def test_counterfactuals_keep_identity_terms_neutral(monkeypatch):
    texts = [f"muslim idiot a{i}" for i in range(40)] + [f"idiot muslim jewish c{i}" for i in range(10)] + [f"fine b{i}" for i in range(200)]
    labels = [1] * 50 + [0] * 200
    model = toxicity.fit(texts, labels)
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    plain = toxicity.fit(texts, labels)
    rise = lambda m: m.logit({"muslim", "fine"}) - m.logit({"fine"})
    assert abs(rise(model)) < 0.3 * abs(rise(plain))
    odds = math.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
    wrong = lambda m: sum(m.logit({"some", t, "came", "here"}) > odds for t in ("muslim", "jewish", "hindu"))
    assert wrong(model) == 0 and wrong(plain) >= 1


def test_counterfactuals_are_sentences_of_the_text():
    text = "One two three. Some Muslim men, here!\nNothing else"
    pairs = toxicity.counterfactuals(text)
    assert all(a == {"some", "muslim", "men,", "here"} and len(a ^ b) == 2 for a, b in pairs)
    assert len(pairs) == sum(len(toxicity.SWAPS[t]) for t in ("muslim", "men"))
    put_in = toxicity.counterfactuals("one two. three four")
    assert put_in == toxicity.counterfactuals("one two. three four") and put_in[0][0] in ({"one", "two"}, {"three", "four"})
    assert len(put_in[0][1] - put_in[0][0]) == 1 and toxicity.counterfactuals("")[0][0] == set()


def dense_model(texts, labels, names):
    """The same objective and steps as `optimise`, written out on whole matrices."""
    def vector(words):
        out = np.zeros(len(names))
        for w in words:
            w = w.strip(toxicity.STRIPPED)
            for f in [w, *(w[:k] + "-" for k in (3, 4, 5, 6) if len(w) > k)] if w else []:
                if f in names:
                    out[names.index(f)] = 1
        return out

    x, y = np.stack([vector(t.lower().split()) for t in texts]), np.array(labels, float)
    change = []
    for t in texts:
        own = {tuple(vector(b) - vector(a)) for a, b in toxicity.counterfactuals(t)}
        change += [d for d in own if any(d)]
    d = np.array(change)
    w, b = np.zeros(len(names)), math.log(y.sum() / (1 - y).sum())
    m = v = np.zeros(len(names) + 1)
    for step in range(1, toxicity.STEPS + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = np.append(x.T @ (p - y) / len(y) + toxicity.L2 * w + d.T @ (d @ w) / len(d), (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return {i: 1 / (1 + math.exp(-(vector(t.lower().split()) @ w + b))) for i, t in enumerate(texts)}


def test_toxicity_equals_brute_force(spark):
    docs, labels, toxic = labelled(spark)
    rows = docs.orderBy("doc_id").collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    model = toxicity.train(docs, labels)
    fitted = toxicity.fit([r["text"] for r in train], [toxic[r["doc_id"]] for r in train])
    assert model.weights.keys() == fitted.weights.keys() and all(abs(model.weights[f] - fitted.weights[f]) < 1e-6 for f in model.weights)
    want = dense_model([r["text"] for r in train], [toxic[r["doc_id"]] for r in train], sorted(model.weights))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[r["doc_id"]] - want[i]) < 1e-6 for i, r in enumerate(train))


def test_the_penalty_acts_on_the_labelled_documents(spark, monkeypatch):
    import duckdb

    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select d.doc_id, text, toxic from '{folder}/documents.parquet' d join '{folder}/labels.parquet' using (doc_id) where toxic in (0, 1) order by 1").fetchall()
    parts = {h: [(t, y) for i, t, y in rows if (zlib.crc32(str(i).encode()) % 4 == 2) == h] for h in (False, True)}
    model = toxicity.fit(*map(list, zip(*parts[False], strict=True)))
    index = {f: i for i, f in enumerate(sorted(model.weights))}
    assert all(toxicity.row_of(t, y, index).changes for t, y in parts[False][:200])
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    plain = toxicity.fit(*map(list, zip(*parts[False], strict=True)))
    assert max(abs(model.weights[f] - plain.weights[f]) for f in model.weights) > 0.1
    neutral = [toxicity.sentences_of(t)[0] for t, y in parts[True] if not y and toxicity.sentences_of(t)][:100]
    moved = lambda m: sum(abs(m.logit(s | {t}) - m.logit(s)) for s in neutral for t in toxicity.TERMS)
    assert moved(model) < 0.1 * moved(plain)
    caught = sum(y and toxicity._Scorer(model).score(t) >= toxicity.THRESHOLD for t, y in parts[True])
    assert caught >= 109


def test_toxicity_of_an_id_with_several_texts(spark):
    docs, labels, _ = labelled(spark, 120)
    more = table(spark, ["another text idiot", "word1 word2"], [3, 3]).unionByName(docs)
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, toxicity.train(d, labels)).collect()) for d in (more, more.repartition(7))]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(*scores, strict=True))


def test_toxicity_edges(spark):
    docs, labels, _ = labelled(spark, 60)
    none = toxicity.train(docs, labels.where("toxic = 9"))
    assert {r["predicted"] for r in toxicity.score(table(spark, TEXTS), none).collect()} == {0}
    model = toxicity.train(docs, labels)
    assert toxicity.score(table(spark, TEXTS), model).count() == len(TEXTS)
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.keep_clean(empty(spark), model).count() == 0
    assert toxicity.train(empty(spark), labels).weights == {}


# 6 sharding
def test_sharding_law_slots_and_growth(spark):
    texts = [f"text {i % 50}" for i in range(3000)] + TEXTS + ["x", "x", None]
    docs = table(spark, texts, [*range(3000 + len(TEXTS)), 1, 1, None])
    rows = sharding.shard_documents(docs, 24).collect()
    assert len(rows) == len(texts)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and len(by_shard) == 24
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    moved = sum(r["grown_shard"] == 24 for r in rows) / len(rows)
    assert 0.02 < moved < 0.07
    text_of = {i: t for i, t in enumerate(texts[:3000])}
    assert all(r["size"] == len(text_of[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text_of[r["doc_id"]].encode()) for r in rows if r["doc_id"] in text_of and r["doc_id"] != 1)
    assert sharding.shard_documents(empty(spark), 24).count() == 0


def test_shards_equal_brute_force_and_a_run_with_one_more(spark):
    docs = table(spark, [f"text {i}" for i in range(500)] + ["null id"], [*range(500), None])
    salted = docs.select("doc_id", F.array(*[F.xxhash64("doc_id", F.lit(i)) for i in range(25)]).alias("h")).collect()
    best = {}
    for r in salted:
        scores = [-1.0 / math.log((((h & (1 << 64) - 1) >> 12) + 0.5) / 2**52) for h in r["h"]]
        best[r["doc_id"]] = tuple(max(range(n), key=lambda i, s=scores: (s[i], -i)) for n in (24, 25))
    rows = {r["doc_id"]: r for r in sharding.shard_documents(docs, 24).collect()}
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 25).collect()}
    assert {i: (r["shard"], r["grown_shard"]) for i, r in rows.items()} == best
    assert grown == {i: r["grown_shard"] for i, r in rows.items()}


def test_weights_set_the_shares(spark):
    rows = sharding.assign(spark.range(20000).withColumnRenamed("id", "doc_id"), F.col("doc_id"), [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20000 for r in rows}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.02


# 7 byte-level BPE
def test_byte_bpe_equals_tiktoken(spark):
    from tiktoken import Encoding

    enc = Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(spark, BPE), special_tokens={})
    texts = TEXTS + ["don't  stop\n\n  now", "ﬁ №１２３", "▁under Ġ", "x" * 5000, " " * 3000 + "y"]
    rows = {r["doc_id"]: r for r in byte_bpe.round_trip(table(spark, texts), BPE, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(table(spark, texts), BPE, P.PATTERN), BPE, P.PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert byte_bpe.round_trip(empty(spark), BPE, P.PATTERN).count() == 0


def test_byte_bpe_codec_over_memos_and_patterns(spark, monkeypatch):
    import random
    import re

    import pyarrow as pa
    import regex
    from tiktoken import Encoding

    ranks = byte_bpe.read_ranks(spark, BPE)
    enc = Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(byte_bpe, "MEMO", 20)
    codec = byte_bpe.Codec(ranks, byte_bpe.sentencepiece_model(ranks), P.PATTERN)
    random.seed(1)
    texts = TEXTS + ["".join(random.choices("ab 1'tls.\n\x1c\x1fé中 ", k=random.randint(0, 60))) for _ in range(300)]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        want = [enc.encode_ordinary(t or "") for t in part]
        ids = codec.encode(part)
        assert ids.to_pylist() == want and codec.counts(part).to_pylist() == [len(x) for x in want]
        assert codec.decode(ids).to_pylist() == [(t or "").encode() for t in part]
        assert codec.decode(ids.slice(2)).to_pylist() == [(t or "").encode() for t in part[2:]]
    assert codec.decode(pa.array([None, [], None], pa.list_(pa.int32()))).to_pylist() == [b"", b"", b""]
    with pytest.raises((KeyError, IndexError)):
        codec.decode(pa.array([[10**6]], pa.list_(pa.int32())))
    plain, whole = re.compile(byte_bpe.ascii_pattern(P.PATTERN)).findall, regex.compile(P.PATTERN).findall
    for t in ("".join(random.choices("".join(map(chr, range(128))), k=20)) for _ in range(2000)):
        assert plain(t) == whole(t)
    assert byte_bpe.ascii_pattern(r"\p{Lu}+") is None and byte_bpe.ascii_pattern(r"(?i:x)|\w") is None and byte_bpe.ascii_pattern(r"[\S]") is None


def test_pipeline_encodes_and_decodes_in_one_pass(spark):
    import corpus_pipeline

    docs = table(spark, TEXTS).withColumns({"source": F.lit("s"), "lang": F.lit(None).cast("string")}).drop("n_chars")
    out = corpus_pipeline.encode(spark, docs, "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "round_trip"]
    rows = {r["doc_id"]: r for r in out.collect()}
    ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, BPE, P.PATTERN).collect()}
    assert all(r["round_trip"] and r["ids"] == ids[i] and r["n_tokens"] == len(ids[i]) for i, r in rows.items()) and len(rows) == len(TEXTS)


def test_pipeline_counts_words_once_and_moves_texts_once(spark):
    docs = table(spark, TEXTS).withColumns({"source": F.lit("s"), "lang": F.lit("l")})
    plan = lambda df, kind: getattr(df._jdf.queryExecution(), kind)().toString()
    assert plan(mixing.described(docs, "mix").select("mix.topic", "mix.tokens"), "optimizedPlan").count("regexp_extract_all") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(similar.keep_one(docs), "executedPlan").count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "translate" not in plan(docs.select(quality_cascade.base_metrics(F.col("text"))), "optimizedPlan")


# 8 token store
def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_token_store_round_trip(spark):
    texts = TEXTS + ["It's 42, ÉCOLE <|endoftext|> done.", "x" * 300, LONG + "tail"]
    folder = token_store.build(table(spark, texts), WORD_BPE, 2)
    want, start = brute_ids(texts), 0
    rows = {r["doc_id"]: r for r in token_store.digests(spark, folder).collect()}
    whole = {r["doc_id"]: r["ids"] for r in token_store.reconstruct(spark, folder).collect()}
    for i, ids in enumerate(want):
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[i] == ids
        start += len(ids)
    chunks = token_store.read_chunks(spark, folder)
    assert chunks.count() == chunks.select("hash").distinct().count()
    assert token_store.damaged(spark, folder).count() == 0
    assert token_store.digests(spark, token_store.build(empty(spark), WORD_BPE, 2)).count() == 0


def rewrite(df, folder):
    """Write a changed table of the store in place of the old one."""
    rows = df.collect()
    df.sparkSession.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(folder)


def test_the_store_notices_every_change(spark):
    texts = [f"some words number {i} " + "and more words here " * (i % 50) for i in range(60)]
    recipes, start = (lambda f: token_store.read_recipes(spark, f)), F.col("start")
    first = F.col("doc_id") == 7
    changes = {
        "start": lambda f: recipes(f).withColumn("start", F.when(first, start + 5).otherwise(start)),
        "all starts": lambda f: recipes(f).withColumn("start", start + 5),
        "n_tokens": lambda f: recipes(f).withColumn("n_tokens", F.when(first, F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))),
        "doc_id": lambda f: recipes(f).withColumn("doc_id", F.when(first, 700).otherwise(F.col("doc_id"))),
        "dropped recipe": lambda f: recipes(f).where(~first),
        "added part": lambda f: recipes(f).unionByName(recipes(f).where(first).withColumns({"part": F.lit(999), "start": F.lit(10**6).cast("long")})),
    }
    for name, change in changes.items():
        folder = token_store.build(table(spark, texts), WORD_BPE, 2)
        assert token_store.damaged(spark, folder).count() == 0
        rewrite(change(folder), f"{folder}/recipes")
        assert -1 in {r["part"] for r in token_store.damaged(spark, folder).collect()}, name
        with pytest.raises(ValueError, match="manifest"):
            token_store.digests(spark, folder)
    folder = token_store.build(table(spark, texts), WORD_BPE, 2)
    flipped = F.concat(F.unhex(F.when(F.hex(F.substring("data", 1, 1)) == "01", "02").otherwise("01")), F.expr("substring(data, 2)"))
    rewrite(token_store.read_chunks(spark, folder).withColumn("data", flipped), f"{folder}/objects/kind=chunk")
    with pytest.raises(Exception, match="is damaged"):
        token_store.digests(spark, folder).collect()


def test_the_store_keeps_wide_ids_and_encodes_by_other_tokenizers(spark, tmp_path):
    texts = ["Plain words, here.", "It's 42", "", None]
    folder = token_store.build(table(spark, texts), WORD_BPE, 70_000)
    rows = {r["doc_id"]: r for r in token_store.digests(spark, folder).collect()}
    whole = {r["doc_id"]: r["ids"] for r in token_store.reconstruct(spark, folder).collect()}
    for i, ids in enumerate(brute_ids(texts)):
        assert whole[i] == ids[:-1] + [70_000] and rows[i]["ids_crc32"] == zlib.crc32(np.array(whole[i], "<u4").tobytes())
    other = json.load(open(WORD_BPE))
    other["normalizer"]["normalizers"] = other["normalizer"]["normalizers"][:2]  # keeps capital letters
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    assert token_store.splits_at_words(open(WORD_BPE).read()) and not token_store.splits_at_words(path.read_text())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(path))
    whole = {r["doc_id"]: r["ids"] for r in token_store.reconstruct(spark, token_store.build(table(spark, texts), str(path), 2)).collect()}
    assert whole == {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(1)
    passage, a, b = rng.integers(0, 49000, 6000), rng.integers(0, 49000, 333), rng.integers(0, 49000, 1234)

    def names(ids):
        ends = token_store.cuts(ids.astype("<u2"))
        assert ends[-1] == len(ids) and all(0 < y - x <= token_store.GREATEST for x, y in zip([0, *ends], ends, strict=False))
        return {token_store.name_of(ids[x:y].astype("<u2").tobytes()) for x, y in zip([0, *ends], ends, strict=False)}

    shared = names(np.concatenate([a, passage])) & names(np.concatenate([b, passage]))
    assert len(shared) >= len(names(passage)) // 2


def test_repeated_ids_and_null_ids_in_the_store(spark):
    rows = token_store.digests(spark, token_store.build(table(spark, ["a b", "a b", "c", "d"], [4, 4, None, 1]), WORD_BPE, 2)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 4, 4] and [r["start"] for r in rows] == [0, 2, 4, 7]


# 9 quality rules
def brute_quality(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    failed = out[0] < 20 or 100 * out[4] > 30 * out[0]
    kept = not failed and not (10 * out[2] > out[0] or 2 * out[3] > len(lines) or out[1] < 2 * out[0] or out[1] > 15 * out[0])
    return (*out, failed, kept)


def test_quality_counts_and_verdicts(spark):
    rng = np.random.default_rng(4)
    texts = TEXTS + [" ".join(rng.choice(list("abc"), 60)) for _ in range(20)] + ["| # word " * 30, "line of some words here\n" * 9, "\x0bA\x0cb\r\nc " * 25, "unique " + " ".join(f"w{i}" for i in range(40))]
    rows = {r["doc_id"]: tuple(r)[1:] for r in quality_cascade.judge(table(spark, texts)).collect()}
    assert rows == {i: brute_quality(t) for i, t in enumerate(texts)}
    kept = {r["doc_id"] for r in quality_cascade.keep(table(spark, texts)).collect()}
    assert kept == {i for i, t in enumerate(texts) if brute_quality(t)[-1]}
    assert quality_cascade.judge(empty(spark)).count() == 0


def test_cascade_order_is_rejections_per_cost():
    a, b, c, d = (quality_cascade.Rule(x, None) for x in "abcd")
    assert [r.name for r in quality_cascade.order([(a, 1.0, 0.1), (b, 0.1, 0.05), (c, 5.0, 0.0), (d, 0.2, 0.0)])] == ["b", "a", "d", "c"]


def test_cascade_order_is_the_same_in_every_run_and_never_changes_a_verdict(spark):
    texts = TEXTS + ["| # word " * 30] * 9 + ["line of some words here\n" * 9] * 4 + ["unique " + " ".join(f"w{i}" for i in range(40))] * 20
    rules = quality_cascade.BASE_RULES + quality_cascade.METHOD_RULES
    docs = table(spark, texts)
    orders = {tuple(r.name for r in quality_cascade.ordered(d, rules)) for d in [docs] * 5 + [docs.repartition(n) for n in range(1, 6)]}
    assert len(orders) == 1
    want = {i for i, t in enumerate(texts) if brute_quality(t)[-1]}
    for chosen in (rules, rules[::-1]):
        text = F.coalesce("text", F.lit(""))
        kept = docs.where(quality_cascade.verdict(list(chosen), quality_cascade.Parts(text, quality_cascade.words(text)))).collect()
        assert {r["doc_id"] for r in kept} == want
    sampled = {r["text"] for r in quality_cascade.sample_of(docs.repartition(3), rows=8).collect()}
    assert sampled == {r["text"] for r in quality_cascade.sample_of(docs, rows=8).collect()}
    assert quality_cascade.keep(empty(spark)).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("words", "b", "kept", "lines")})
    assert quality_cascade.keep(clash).columns == clash.columns and {r["doc_id"] for r in quality_cascade.keep(clash).collect()} == want


# 10 language-model scores
def test_ppm_base_scores_and_counts(spark):
    texts = TEXTS + [f"common words and rare{i} token{i % 7}" for i in range(60)]
    docs = table(spark, texts).unionByName(table(spark, ["one two three four"] * 2, [5, 5]))
    rows = ppm.score(docs).collect()
    every = [(i, t) for i, t in enumerate(texts)] + [(5, "one two three four")] * 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for i, t in every if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in every)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(-10**6 < r["score"] < 0 for r in rows) and ppm.score(empty(spark)).count() == 0


def brute_ppm(texts, held, top=ppm.ORDER):
    """Code lengths by a trie of dictionaries, one byte at a time, as the model's definition says."""
    def stream(t):
        return b" " * top + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b" "

    whole = Counter()
    for t, h in zip(texts, held, strict=True):
        s = stream(t)
        if not h:
            whole.update(s[i - top : i + 1] for i in range(top, len(s)))
    trie = {top: defaultdict(Counter)}
    for g, c in whole.items():
        trie[top][g[:top]][g[top]] = c
    for k in range(top - 1, -1, -1):
        trie[k] = defaultdict(Counter)
        if k > 2:
            for context, seen in trie[k + 1].items():
                for s in seen:
                    trie[k][context[1:]][s] += 1
        else:
            for g, c in whole.items():
                trie[k][g[top - k : top]][g[top]] += c

    def lp(context, symbol):
        logs, out = 0.0, set()
        for k in range(top, -1, -1):
            seen = trie[k].get(context[top - k :], {})
            left = {s: c for s, c in seen.items() if s not in out}
            if left:
                n, once = sum(left.values()), sum(c == 1 for c in left.values())
                e = 0.0 if len(seen) >= 256 else 0.3 if n == 1 else min(0.7, (0.3 + 0.8 * once) / (n + 0.5))
                if symbol in left:
                    return logs + math.log10((1 - e) * left[symbol] / n)
                logs += math.log10(e)
            out |= seen.keys()
        return logs - math.log10(256 - len(out))

    scores = [sum(lp(s[i - top : i], s[i]) for i in range(top, len(s))) for s in map(stream, texts)]
    return scores, lp


PPM_TEXTS = ["the cat sat on the mat", "the cat sat on the hat", "The cat SAT on the mat", "then the dog\nsat on the cat", "a\u00e9\u4e2d b \u00e9\u00e9", "", None, "zebra zebra zebra", "x" * 60] + [f"the {w} sat on the {v}" for w in ("cat", "dog", "cow", "hen") for v in ("mat", "rug", "bed")]


def test_ppm_equals_a_trie_of_dictionaries(spark):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(PPM_TEXTS))]
    assert any(held) and not all(held)
    want, lp = brute_ppm(PPM_TEXTS, held)
    for context in (b" " * 6, b"he cat", b"on the", b"xxxxxx", b"qqqqqq"):
        assert abs(sum(10 ** lp(context, s) for s in range(256)) - 1) < 1e-9
    # Blocks and shards of any size, also cuts inside a text, give the same scores.
    for sizes in ({}, {"block": 40, "shard": 16}):
        rows = {r["doc_id"]: r for r in ppm.score(table(spark, PPM_TEXTS), **sizes).collect()}
        for i, x in enumerate(want):
            assert rows[i]["held_out"] == held[i] and abs(rows[i]["score"] - x) < 1e-6 * (1 + abs(x)), (i, rows[i]["score"], x)
            assert rows[i]["n_tokens"] == len((PPM_TEXTS[i] or "").split()) + 1


@pytest.mark.parametrize("split", [0.05, 0.5])
def test_ppm_hot_contexts_are_dealt_further_and_change_no_score(spark, monkeypatch, split):
    monkeypatch.setattr(ppm, "SPLIT", split)
    docs, size = table(spark, PPM_TEXTS), sum(len((t or "").encode()) for t in PPM_TEXTS)
    hot = ppm.hot_contexts(docs, size, size // 16 + 1)
    assert all(len(hot[k]) for k in (3, 4, 5)) and all(set((hot[k + 1] >> np.uint64(8)).tolist()) <= set(hot[k].tolist()) for k in (3, 4))
    want, _ = brute_ppm(PPM_TEXTS, [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(PPM_TEXTS))])
    rows = {r["doc_id"]: r["score"] for r in ppm.score(docs, block=40, shard=16).collect()}
    assert all(abs(rows[i] - x) < 1e-6 * (1 + abs(x)) for i, x in enumerate(want))


def test_ppm_largest_shard_falls_as_data_grows(spark):
    part = {}
    for sf in ("0.01", "0.1"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
        texts = [(r["text"] or "").encode() for r in docs.toLocalIterator()]
        size = sum(map(len, texts))
        shards = size // (8 << 10) + 1
        grams, _ = ppm._distinct_grams([s for t in texts for s, _, _ in ppm.segments_of(t, ppm.BLOCK)])
        for name, hot in (("whole", {}), ("dealt", ppm.hot_contexts(docs, size, shards))):
            part[sf, name] = np.bincount(ppm.shard_of_grams(grams, shards, hot)).max() / len(grams)
    assert part["0.1", "dealt"] < part["0.01", "dealt"] / 3 and part["0.1", "dealt"] < part["0.1", "whole"] / 2


def test_ppm_reads_context_across_words_and_trains_on_nothing(spark):
    texts = [f"alpha beta gamma delta {i % 5}" for i in range(80)] + ["delta alpha gamma beta 0"] * 3
    rows = {r["doc_id"]: r["score"] for r in ppm.score(table(spark, texts)).collect()}
    assert rows[0] > rows[82] + 3  # the same words in an order that training doesn't have
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    for r in ppm.score(table(spark, ["ab", "", "c d"], held)).collect():
        n_bytes = {held[0]: 4, held[1]: 1, held[2]: 5}[r["doc_id"]]
        assert abs(r["score"] + n_bytes * math.log10(256)) < 1e-5 and r["train_tokens"] == 0
    twice = ppm.score(table(spark, ["one two", "one two", "three"], [4, 4, None])).collect()
    assert len(twice) == 3 and len({r["score"] for r in twice if r["doc_id"] == 4}) == 1


def test_ppm_beats_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = ppm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


# the contract of the queries, and the pipeline
def test_queries_and_sql_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_sql_of_native_operators(spark):
    import duckdb

    from corpusforge.llm import queries

    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{data}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, data).toPandas(), c.sql(sql).df()
        key = lambda df: sorted(json.dumps([round(x, 6) if isinstance(x, float) else str(x) for x in row]) for row in df[sorted(df.columns)].itertuples(index=False))
        assert key(got) == key(want), name


@pytest.fixture(scope="module")
def pipeline_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels, _ = labelled(spark, 200)
    more = table(spark, [*TEXTS, " ".join(f"copy{i}" for i in range(40)), " ".join(f"copy{i}" for i in range(40))], range(1000, 1000 + len(TEXTS) + 2))
    docs.unionByName(more).drop("shard", "fp").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_stage_by_stage(spark, pipeline_folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{pipeline_folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, pipeline_folder)
        assert set(out.columns) == set(docs.columns), name
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept = {r["doc_id"] for r in out.collect()}
        if name == "quality rules":
            assert kept == {i for i, t in rows.items() if brute_quality(t)[-1]}
        elif name == "toxicity":
            assert not any("idiot" in (rows[i] or "") for i in kept) and len(kept) > 100
        elif name == "near duplicates":
            ids = sorted(rows)
            assert kept == {ids[g] for g in shingle_groups([rows[i] for i in ids])}
        else:
            assert kept == {r["doc_id"] for r in mixing.judged(docs).where("kept").collect()}
        docs = spark.createDataFrame(out.collect(), docs.schema)
    final = corpus_pipeline.run(spark, pipeline_folder).collect()
    assert {r["doc_id"] for r in final} == kept and all(r["round_trip"] for r in final)


def test_pipeline_of_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs, labels, _ = labelled(spark, 60)
    docs = docs.withColumns({c: F.lit("x") for c in ("_keep", "_fp", "_tokens", "mix", "words", "node", "toxic", "probability", "root")})
    labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(r["_keep"] == r["mix"] == "x" for r in out.collect()), name


def test_quality_rules_beside_nested_maps(spark):
    docs = table(spark, TEXTS).select("*", F.array(F.create_map(F.lit("k"), F.lit(1))).alias("maps"), F.struct(F.create_map(F.lit("k"), F.lit(1)).alias("m")).alias("deep"))
    assert {r["doc_id"] for r in quality_cascade.keep(docs).collect()} == {i for i, t in enumerate(TEXTS) if brute_quality(t)[-1]}


def test_slots_keep_all_columns_and_split_equal_keys(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("_row"), F.lit(1).alias("bucket"), (F.col("id") % 2).cast("int").alias("shard"), F.lit("x").alias("n"))
    out = sharding.with_slots(df, "shard", F.col("k"), [F.col("_row")])
    assert out.columns == ["shard", *[c for c in df.columns if c != "shard"], "slot"] or set(out.columns) == {*df.columns, "slot"}
    rows = out.collect()
    for s in (0, 1):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(1500))
    assert {r["n"] for r in rows} == {"x"} and {r["_row"] for r in rows} == set(range(3000))
    # Null keys are dealt over the buckets.
    assert df.select(F.pmod(F.xxhash64(F.col("k"), F.col("_row"), F.lit("slot")), F.lit(sharding.BUCKETS))).distinct().count() > 200


def test_toxicity_takes_a_column_as_spark_resolves_it(spark):
    docs, labels, _ = labelled(spark, 60)
    model = toxicity.train(docs, labels)
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs.withColumnRenamed("text", "Text"), model).collect()}
    assert kept == {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()}


def test_quality_sample_is_the_rows_of_least_hash(spark):
    docs = table(spark, [f"text {i}" for i in range(900)] + ["copy"] * 300)
    hashed = docs.withColumn("h", F.xxhash64(*docs.columns)).orderBy("h").limit(50).collect()
    assert sorted(r["text"] for r in quality_cascade.sample_of(docs, rows=50).collect()) == sorted(r["text"] for r in hashed)
    assert quality_cascade.sample_of(empty(spark)).count() == 0 and quality_cascade.sample_of(docs).count() == 400


def test_simhash_proposes_near_duplicates_of_the_pipeline(spark):
    from corpusforge.llm import similar

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1])]
    fps = [similar.fingerprint_of(similar.shingles(t.encode())) for t in texts]
    unsigned = [f & (1 << 64) - 1 for f in fps]
    assert (unsigned[0] ^ unsigned[1]).bit_count() <= 3 < (unsigned[0] ^ unsigned[2]).bit_count()
    assert similar.fingerprint_of(similar.shingles(b"")) == 0
    nodes = spark.createDataFrame([(10, fps[0]), (11, fps[1]), (12, fps[2]), (13, fps[0])], "node long, fp long")
    pairs = {frozenset((r["a"], r["b"])) for r in similar.simhash_pairs(nodes).collect()}
    assert frozenset((10, 13)) in pairs and (fps[0] == fps[1] or frozenset((10, 11)) in pairs) and not any(12 in p for p in pairs)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == [0, 2]
