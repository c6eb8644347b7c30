"""Personal data: base spans against Python's matcher on the contract's plain patterns, and what patterns discover."""

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from corpusforge.llm import pii

DOCS = "doc_id long, text string, base string, Tokens int, t string"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def expected(doc_id, text):
    spans = brute(text)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (doc_id, *[sum(s[0] == k for s in spans) for k in PLAIN], hashlib.sha256(listed.encode()).hexdigest(), listed)


def digested(df):
    return sorted(map(tuple, pii.digests(df).collect()), key=str)


def card(r, n=16):
    body = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def noisy(r):
    bits = [lambda: r.choice(("a", "ab.c", "x%y", "é", "😀", "@", "@@", ".", "..", "-", "+", " ", "\n", "_", "#")), lambda: str(r.randrange(300)), lambda: r.choice(("a@b.c", "q@w", "@x.y", "a@b.c_d@e.f", "m@n.o.p-q.")), lambda: ".".join(str(r.randrange(0, 270)) for _ in range(r.randrange(3, 7))), lambda: card(r, r.randrange(12, 21)), lambda: " ".join(card(r)[i : i + 4] for i in range(0, 16, 4)), lambda: f"+{r.randrange(99)} ({r.randrange(999)}) {r.randrange(10**6)}-{r.randrange(10**3)}", lambda: "0" * r.randrange(5)]
    return r.choice(("", " ", "-")).join(r.choice(bits)() for _ in range(r.randrange(1, 40)))


def test_base(spark):
    r = random.Random(1)
    texts = [None, "", " \t\n", "no numbers", "1.2.3.4.5.6.7.8", "000255.0.0.1 256.1.1.1", "a@b.c_d@e.f", "4111 1111 1111 1111 é 4111-1111-1111-1111", "+1 (017) 555-7713", "+123456789012345678"] + [noisy(r) for _ in range(600)]
    ids = [*range(len(texts) - 2), None, 4]
    # Few tokens share contexts here, so nothing is discovered; the base columns hold in any case.
    got = [x[:6] for x in digested(table(spark, texts, ids))]
    assert sorted(got, key=str) == sorted((expected(i, t)[:6] for i, t in zip(ids, texts, strict=True)), key=str)


def test_long_texts(spark):
    """Long runs of one kind of character, against the plain patterns where these are quick, else against what must come out."""
    texts = ["1" * 2000, "a" * 2000 + "@", "x@" + "a." * 2000, "1.2.3.4 " * 3000, "+1" * 2000, "a@b.c " * 3000, "1-" * 2000]
    assert digested(table(spark, texts)) == sorted((expected(i, t) for i, t in enumerate(texts)), key=str)
    nothing = ["1" * 300_000, "a" * 300_000 + "@", "+1" * 150_000, "1-" * 150_000]
    assert all(r[1:5] == (0, 0, 0, 0) and r[6] == "" for r in digested(table(spark, nothing)))
    assert digested(table(spark, ["x@" + "a." * 150_000 + "b"]))[0][6] == "email:0:300003"


def test_running(spark):
    for n in (0, 1, 63, 64, 65, 300):
        sizes = [(7 * i) % 11 for i in range(n)]
        df = spark.createDataFrame([(sizes,)], "s array<int>")
        assert df.select(pii.running(F.col("s")).alias("r")).first()["r"] == list(itertools.accumulate(sizes))


def planted():
    """Numbers after `tel:` that are phones but for a few without their plus sign; cards after common words; years."""
    r = random.Random(4)
    filler = [f"word{chr(97 + i)}" for i in range(20)]
    say = lambda n: " ".join(r.choice(filler) for _ in range(n))
    texts = [f"{say(9)} tel: +49 30 {r.randrange(10**6, 10**7)} {say(6)}" for _ in range(40)]
    texts += [f"{say(5)} tel: 030-{k}55512 {say(4)}" for k in range(3)]
    texts += [f"{say(5)} again 030-155512, {say(4)}"]
    texts += [f"{say(4)} {card(r)} {say(3)}" for _ in range(60)] + [f"{say(6)} in 19{k}x7 {say(5)}" for k in range(10, 30)]
    return texts


def test_discovery(spark):
    texts = planted()
    spans = {r["doc_id"]: r for r in pii.extract(table(spark, texts)).collect()}
    seen = {i: [texts[i][s["a"] : s["b"]] for s in r["found"]] for i, r in spans.items() if r["found"]}
    assert seen == {40: ["030-055512"], 41: ["030-155512"], 42: ["030-255512"], 43: ["030-155512"]}
    assert {s["k"] for r in spans.values() for s in r["found"]} == {3}
    got = {r["doc_id"]: r for r in pii.digests(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = expected(i, t)
        assert tuple(got[i])[:6] == want[:6] and set(want[6].split(",")) - {""} <= set(got[i]["spans"].split(","))
    at = texts[41].index("030-1")
    assert got[41]["spans"] == f"phone:{at}:{at + 10}"


def test_counts_beyond_the_broadcast(spark, monkeypatch):
    docs = table(spark, planted())
    whole = sorted(map(str, pii.extract(docs).collect()))
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert sorted(map(str, pii.extract(docs).collect())) == whole


def test_plain_words_lower_confidence(spark):
    """The same numbers after a word that plain words follow as well aren't found."""
    words = [f"word{chr(97 + i)}" for i in range(20)]
    texts = planted() + [f"{a} tel: {b} {c}" for a in words for b, c in zip(words, words[::-1], strict=True)]
    assert not any(r["found"] for r in pii.extract(table(spark, texts)).collect())


def test_edges(spark):
    assert pii.digests(table(spark, [])).count() == 0
    t = "mail me: a@b.de"
    assert digested(table(spark, [t, t, None], [1, 1, None])) == sorted([expected(1, t)] * 2 + [expected(None, None)], key=str)
