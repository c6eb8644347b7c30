"""Behaviour of single operators on tiny tables."""

import dataclasses
import io
import zipfile

from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.functions import udfs
from corpusforge.operators import audits, chunking, context, fusion, kgraph, lexical, metrics, routing, vectors
from corpusforge.settings import DEFAULTS, Settings
from corpusforge.sources import files, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_settings_fingerprint_covers_every_knob():
    prints = {DEFAULTS.fingerprint()}
    for f in dataclasses.fields(Settings):
        value = getattr(DEFAULTS, f.name)
        other = (not value) if isinstance(value, bool) else value + 1 if isinstance(value, (int, float)) else f"{value}x"
        prints.add(dataclasses.replace(DEFAULTS, **{f.name: other}).fingerprint())
    assert len(prints) == len(dataclasses.fields(Settings)) + 1


def test_cleaning_keeps_urls_and_unwraps(spark):
    raw = "$\\color{red}{T}$ ![i](a.png)[in](b%20c(d).md) [out](https://e.org/a%20b)<br/>x\n\n\n\ny"
    assert one(spark, T.clean_markdown(F.lit(raw))) == "T in [out](https://e.org/a%20b) x\n\ny"


def test_tokens_drop_thousands_commas(spark):
    assert one(spark, T.tokens(F.lit("2,292 A, 1,000,000 x,y"))) == ["2292", "a", "1000000", "x", "y"]


def test_split_recursive_properties():
    text = "\n\n".join(f"paragraph {i} " + "word " * (i % 40) for i in range(60))
    pieces = chunking.split_recursive(text, 200, 40)
    assert all(0 < len(p) <= 200 for p in pieces)
    at = 0
    for p in pieces:
        found = text.find(p[:30], max(0, at - 300))
        assert found >= 0
        at = found
    assert chunking.split_recursive("x" * 500, 200, 40) == ["x" * 500]
    assert chunking.split_recursive(None, 200, 40) == []


def test_blocks_take_tables_with_heading_and_diagrams():
    got = chunking.split_blocks("# H\n\n| a |\n|---|\n| 1 |\n\nrest\n```\n│──│\n```", "[t {n}]", "[d {n}]")
    assert [b["kind"] for b in got["blocks"]] == ["diagram", "table"]
    assert got["blocks"][1]["page_content"].startswith("# H\n\n| a |")
    assert "[t 1]" in got["body"] and "[d 1]" in got["body"]


def test_place_blocks_after_first_marker_and_orphans_last(spark):
    prose = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b [m] c"), ("s", 2, "[m]")], "source string, ord int, page_content string")
    blocks = spark.createDataFrame([("s", 0, "table", "[m]", "T"), ("s", 1, "table", "[gone]", "O")], "source string, ord int, kind string, marker string, page_content string")
    rows = chunking.with_positions(chunking.place_blocks(prose, blocks), "source", ["place"]).orderBy("chunk_index").collect()
    assert [r["page_content"] for r in rows] == ["a", "b [m] c", "T", "[m]", "O"]
    assert [r["chunk_index"] for r in rows] == list(range(5))


def test_breakpoints_of_two_groups_and_of_equal_vectors(spark):
    rows = [(0, i, v) for i, v in enumerate([[1.0, 0, 0], [0.95, 0.05, 0], [0.9, 0.1, 0], [0.0, 0, 1], [0.05, 0, 0.95], [0, 0.05, 0.9]])] + [(1, i, [1.0, 1.0]) for i in range(5)]
    df = spark.createDataFrame([(g, i, [float(x) for x in v]) for g, i, v in rows], "g int, idx int, embedding array<double>")
    out = chunking.breakpoints(chunking.adjacent_distances(df, "g", "idx"), "g", 80).where("is_break").collect()
    assert [(r["g"], r["idx"]) for r in out] == [(0, 2)]


def test_merge_sentences():
    assert chunking.merge_sentences(list("abcdef"), {2}, 100, 0) == ["a b c", "d e f"]
    assert chunking.merge_sentences(["long enough", "x"], {0}, 100, 5) == ["long enough x"]


def test_bm25_ranks_and_drops_zero_scores(spark):
    docs = spark.createDataFrame([(1, "apple pie recipe"), (2, "apple tart"), (3, "car engine"), (4, "boat"), (5, None)], "id int, text string")
    q = spark.createDataFrame([(1, "apple pie"), (2, "nothing here")], "query_id long, question string")
    rows = lexical.bm25_topk(docs, q, "id", 6).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 2] and {r["query_id"] for r in rows} == {1}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, list_id int, rank int, key string")


def test_fusion_prefers_agreement_and_first_seen(spark):
    rows = fusion.fuse(ranked(spark, [(1, 0, 1, "only"), (1, 0, 2, "both"), (1, 1, 1, "both"), (1, 2, 1, "both")]), 6).orderBy("rank").collect()
    assert [(r["key"], r["first_list"]) for r in rows] == [("both", 0), ("only", 0)]
    tied = fusion.fuse(ranked(spark, [(1, 1, 1, "b"), (1, 0, 1, "a")]), 6).orderBy("rank").collect()
    assert [r["key"] for r in tied] == ["a", "b"]
    twice = fusion.fuse(ranked(spark, [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 0, 3, "b")]), 1).collect()
    assert twice[0]["key"] == "b"


def test_version_filter_and_history(spark):
    rows = spark.createDataFrame([(q, i, i % 2 == 0) for q in (1, 2) for i in range(1, 7)], "query_id long, rank int, superseded boolean")
    asked = spark.createDataFrame([(1, "지금은"), (2, "예전에는")], "query_id long, question string")
    out = fusion.version_filtered(rows, asked, 3)
    assert out.where("query_id = 1 and superseded").count() == 0
    assert out.where("query_id = 2 and superseded").count() == 1


def test_invalid_permutation_keeps_order(spark):
    rows = ranked(spark, [(1, 0, 1, "a"), (1, 0, 2, "b"), (2, 0, 1, "c"), (2, 0, 2, "d")])
    p = spark.createDataFrame([(1, [1, 0]), (2, [0, 0])], "query_id long, permutation array<int>")
    got = {(r["key"], r["new_rank"]) for r in fusion.permuted(rows, p).collect()}
    assert got == {("a", 2), ("b", 1), ("c", 1), ("d", 2)}


def chunks(spark):
    rows = [(i, "x.md", None, f"c{i}") for i in range(5)] + [(5, "y.md", None, "d0"), (6, "y.md", "table", "T"), (7, "y.md", None, "d2")]
    return spark.createDataFrame(rows, "chunk_index int, source string, kind string, page_content string")


def test_neighbours_by_both_plans(spark):
    c = chunks(spark)
    asked = c.select(F.col("chunk_index").cast("long").alias("query_id"), F.lit(1).alias("rank"), "*")
    got = {r["chunk_index"]: r["page_content"] for r in context.neighbours_of(asked, c, 1).collect()}
    assert got[0] == "c0\nc1" and got[2] == "c1\nc2\nc3" and got[6] == "T" and got[5] == "d0" and got[7] == "d2"
    wide = {r["chunk_index"]: r["page_content"] for r in context.widened(c, 1).collect()}
    assert wide == {k: v for k, v in got.items() if k != 6}
    assert context.neighbours_of(asked, c, 0) is asked


def test_parents_keep_child_order(spark):
    children = spark.createDataFrame([(1, 1, "p3"), (1, 2, "p1"), (1, 3, "p3"), (1, 4, "gone"), (1, 5, "p2")], "query_id long, rank int, parent_id string")
    parents = spark.createDataFrame([(f"p{i}", f"text {i}") for i in (1, 2, 3)], "parent_id string, page_content string")
    assert [r["parent_id"] for r in context.parents_of(children, parents).orderBy("rank").collect()] == ["p3", "p1", "p2"]


def test_prompt_order(spark):
    items = F.array(*[F.lit(x) for x in "abc"])
    assert one(spark, context.ordered(items, "sandwich")) == ["a", "c", "b", "a"]
    assert one(spark, context.ordered(items)) == ["c", "b", "a"]
    assert one(spark, context.ordered(F.slice(items, 1, 2), "sandwich")) == ["b", "a"]


def test_graph_counts_edges_of_seeds(spark):
    triples = spark.createDataFrame([("P", "worked_at", "A", 1, "s"), ("P", "worked_at", "B", 2, "s"), ("B", "located_in", "C", 2, "s"), (" ", "x", "C", 3, "s")], "subject string, relation string, object string, chunk_index int, source string")
    e = kgraph.edges(triples)
    assert e.count() == 3
    q = spark.createDataFrame([(1, "tell me about b"), (2, "nothing")], "query_id long, question string")
    rows = kgraph.one_hop(kgraph.seeds(kgraph.nodes(e).select("name"), q), e, 6).collect()
    assert [(r["query_id"], r["chunk_index"], r["score"]) for r in rows] == [(1, 2, 2)]


def test_particles_follow_the_last_sound(spark):
    assert one(spark, T.render_question(F.lit("{s}{eun_neun} {s}{eul_reul}"), F.lit("서울"))) == "서울은 서울을"
    assert one(spark, T.render_question(F.lit("{s}{i_ga}"), F.lit("Acme"))) == "Acme가"


def test_path_coverage_needs_a_whole_path(spark):
    paths = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3), (2, 0, 4)], "query_id long, path_id int, anchor_id int")
    hits = spark.createDataFrame([(1, 1), (1, 1), (2, 4)], "query_id long, anchor_id int")
    got = {r["query_id"]: (r["satisfied"], r["best_coverage"], r["any_anchor"]) for r in metrics.path_coverage(paths, hits).collect()}
    assert got == {1: (False, 0.5, True), 2: (True, 1.0, True)}


def test_chance_matches_its_closed_form(spark):
    assert abs(one(spark, metrics.chance(F.lit(10), F.lit(2), 3)) - (1 - 8 / 10 * 7 / 9 * 6 / 8)) < 1e-12
    assert one(spark, metrics.chance(F.lit(3), F.lit(3), 3)) == 1.0


def test_medians_and_profile(spark):
    rows = spark.createDataFrame([("t", float(x)) for x in (1, 2, 3, 4)], "type string, v double")
    assert metrics.upper_median(rows, "v", ("type",)).first()["median_upper"] == 3.0
    traces = spark.createDataFrame([({"retrieve": 1.0, "generate": 3.0},), ({"retrieve": 2.0, "grade": 1.0, "rewrite": 1.0, "generate": 2.0},)], "timings map<string,double>")
    assert {r["node"]: r["share"] for r in metrics.node_profile(traces).collect()}["generate"] == 50.0


def test_confusion_counts_unparsed(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (None, 1)], "p int, a int")
    r = metrics.confusion(rows, "p", "a").first()
    assert (r["accuracy"], r["constant_baseline"], r["false_positives"], r["false_negatives"], r["unparsed"]) == (0.25, 0.75, 1, 1, 1)


def test_keywords_are_found_in_any_case(spark):
    said = lambda answer, word: one(spark, metrics.passes(F.lit(answer), F.lit(None).cast("array<string>"), F.array(F.lit(word)), F.lit(False)))
    assert said("Enß des", "ENSS") and said("ENSS DES", "enß") and said("ΟΔΟΣ", "οδος") and said("so: end", "SO： END")
    assert not said("Enß des", "ENS D")


def test_verdict_fails_open(spark):
    assert [one(spark, routing.verdict(F.lit(x).cast("string"))) for x in ("yes", "No.", "?", None)] == ["sufficient", "insufficient", "sufficient", "sufficient"]


def test_postfilter_underfills_and_prefilter_does_not(spark):
    v = spark.createDataFrame([(i, i % 5, [1.0, i / 100]) for i in range(100)], "vec_id long, label int, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vector array<double>")
    assert vectors.nearest(v, q, 6, prefilter=F.col("label") == 4).count() == 6
    assert vectors.nearest_postfiltered(v, q, 6, F.col("label") == 4, over_fetch=2).count() == 2


def test_safe_arithmetic_and_cover():
    assert udfs.evaluate("2*(3-1)") == "4" and udfs.evaluate("9**9**9") is None and udfs.evaluate("f()") is None and udfs.evaluate(None) is None
    import random
    from itertools import combinations

    for e, v in {"-2**2": "-4", "2**-1": "0.5", "2**3**2": "512", "-(1+2)*3": "-9", "1 - -1": "2", "10/4": "2.5", "1.5e2+.5": "150.5", "2*-3": "-6", "0.1+0.2": "0.3", "--4": "4"}.items():
        assert udfs.evaluate(e) == v, e
    assert all(udfs.evaluate(e) is None for e in ("", "1+", "(1", "1)", "1 2", "2(3)", "()", "a", "1/0", "2**65", "1,5", "+", "0x10"))
    rng = random.Random(3)
    for _ in range(200):
        sets = [rng.sample(range(9), rng.randint(0 if rng.random() < 0.05 else 1, 4)) for _ in range(rng.randint(0, 5))]
        fit = lambda c, sets=sets: all(set(c) & set(s) for s in sets)
        want = next((list(c) for n in range(len(sets) + 1) for c in combinations(range(9), n) if fit(c)), None)
        assert udfs.smallest_cover(sets) == want
    assert udfs.smallest_cover([[i, 50 + i // 20] for i in range(4)] + [list(range(5000))] * 3) is not None
    assert udfs.smallest_cover([[1, 2], [2, 3]]) == [2] and udfs.smallest_cover([[1], []]) is None and udfs.smallest_cover([]) == []


def test_docx_hwpx_and_damaged_files():
    def archive(name, xml):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, xml)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    assert files.docx_text(archive("word/document.xml", doc)) == "Hello\na | b"
    assert files.hwpx_text(archive("Contents/section0.xml", '<s xmlns:hp="u"><hp:p><hp:t>one</hp:t></hp:p><hp:p><hp:t>two</hp:t></hp:p></s>')) == "one\ntwo"
    assert files.load_one("docx", b"junk")[2].startswith("BadZipFile")


def test_scan_names_archived_versions(spark, tmp_path):
    for p in ("a.md", "archive/v1/b.md", "c.bin"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"text of {p}")
    rows = files.scan(spark, str(tmp_path))
    assert {r["source"] for r in rows.where("superseded").collect()} == {"b.md@v1"}
    assert [r["path"] for r in files.rejected(rows).collect()] == ["c.bin"]
    loaded = {r["path"]: r["text"] for r in files.load(rows).collect()}
    assert loaded["a.md"] == "text of a.md" and loaded["c.bin"] is None


def test_manifest_and_cache(spark):
    c = spark.createDataFrame([(0, "m0"), (1, "m1")], "chunk_index int, md5 string")
    m = store.manifest(c, DEFAULTS)
    assert store.consistency(m, m).first()["status"] == "ok"
    assert store.consistency(m, store.manifest(c.where("chunk_index = 0"), DEFAULTS)).first()["status"] == "mismatch"


def test_containment_finds_the_copy(spark):
    old = spark.createDataFrame([(1, "the quick brown fox jumps")], "old_id long, text string")
    new = spark.createDataFrame([(7, "so The quick, brown fox jumps over"), (8, "something else entirely")], "new_id long, text string")
    r = audits.containment(old, new).first()
    assert r["new_id"] == 7 and r["score"] > 0.8
