"""Small cases of the operators: boundaries, nulls, ties, and rules that must fail."""

import hashlib
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import ddl, dialects, domains, extract, graph, intervals, markup, merge, provenance, report, search, store, validate
from lodestrata.sources import files
from lodestrata.streaming import incremental


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- text ----------------------------------------------------------------------------------------------------------


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_paths_globs_and_keys(spark):
    assert one(spark, X.path_parts(F.col("p")), p="C:\\a\\.\\b\\..\\c/d.py") == ["a", "c", "d.py"]
    for glob, path, hit in (("**/x/**", "a/x/b", True), ("**/x/**", "x/b", True), ("*.py", "a/b/c.py", True), ("src/*.py", "src/a/b.py", False), ("/build/", "build/x", True), ("a?c", "abc", True), ("docs/**", "docs", False)):
        assert one(spark, F.col("p").rlike(X.glob_regex(glob)), p=path) is hit, (glob, path)
    assert one(spark, X.last_glob(F.col("p"), ["*.py", "!test_*"]), p="test_a.py") is None
    want = "ak1:" + hashlib.sha256("java\x1fclass\x1f\x1fa/b".encode()).hexdigest()[:16]
    assert one(spark, X.key("ak1:", F.lit("java"), F.lit("class"), F.lit(None).cast("string"), F.col("p")), p="a/b") == want
    assert one(spark, X.body(F.col("t")), t="\r\n a \r\nb\t\r\n\r\n") == " a\nb"
    assert one(spark, X.language(F.col("p")), p="x/Y.PY") == "python" and one(spark, X.language(F.col("p")), p="x/Makefile") is None


def test_windows_end_with_the_text(spark):
    for n in (1, 4, 5, 6, 9, 10, 23):
        text = "\n".join(map(str, range(1, n + 1)))
        got = rows(intervals.windows(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", 5, 2))
        assert got[0][2] == 1 and max(r[3] for r in got) == n and all(r[3] - r[2] < 5 for r in got)
        by = sorted(got, key=lambda r: r[1])
        assert all(b[2] == a[2] + 3 and a[3] == a[2] + 4 for a, b in zip(by, by[1:], strict=False))


# --- retrieval -----------------------------------------------------------------------------------------------------


def test_fusion_prefers_what_both_rank(spark):
    lex = spark.createDataFrame([("b", 1)], "k string, rank long")
    vec = spark.createDataFrame([("a", 1), ("b", 2)], "k string, rank long")
    got = {r.k: (r.score, r.rank) for r in search.fuse(lex, vec, "k", 10).collect()}
    assert got == {"b": (round(1 / 62 + 1 / 61, 9), 1), "a": (round(1 / 61, 9), 2)}


def test_bm25_needs_all_terms_and_floors_idf(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat"), (3, "cat dog dog"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, ["cat", "dog"]).collect()}
    assert set(got) == {1, 3} and got[3] > 0
    only = {r.doc_id for r in search.bm25(docs, ["cat", "bird"]).collect()}
    assert only == set()


def test_raw_queries_rank_filter_and_refuse(spark):
    docs = spark.createDataFrame([(1, "cat dog", "draft"), (2, "cat bird", "approved"), (3, "dog cat fish", "draft"), (4, None, "draft"), (5, "catalog of birds", "draft")], "doc_id long, text string, state string")
    ids_ = lambda q, **kw: sorted(r.doc_id for r in search.keyword_search(docs, q, **kw).collect())
    assert ids_("cat") == [1, 2, 3] and ids_("cat dog") == [1, 3] and ids_('"cat dog"') == [1] and ids_("cat*") == [1, 2, 3, 5] and ids_("bird OR fish") == [2, 3] and ids_("cat NOT dog") == [2]
    assert ids_("cat AND (dog OR bird) NOT fish") == [1, 2] and ids_("dog OR bird NOT cat") == [1, 3]
    found = search.keyword_search(docs, "cat", 20, ["draft"]).collect()
    assert {r.doc_id for r in found} == {1, 3} and {r.dropped for r in found} == {1} and max(r.rank for r in found) <= 3
    for bad in ("cat AND", "(cat", "cat )", "OR cat", "***"):
        with pytest.raises(ValueError):
            search.RawQuery(bad)
    counts, lengths = search.postings(docs)
    assert rows(search.bm25_postings(counts, lengths, ["cat", "dog"])) == rows(search.bm25(docs, ["cat", "dog"]))


def test_near_pairs_check_the_size_of_the_query_set(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = rows(search.near_pairs(v.filter("vec_id = 2"), v, 1.0, 5))
    assert [(r[1], r[2], r[4]) for r in got] == [(1, 1.0, 0.5), (3, 1.0, 0.5)]
    with pytest.raises(ValueError):
        search.near_pairs(v, v, 1.0, 5, bound=3)


def test_near_pairs_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5)]) for i in range(40)], "vec_id long, embedding array<float>")
    want = rows(search.near_pairs(v, v, 3.0, 4))
    assert want and all(rows(search.near_pairs_in_blocks(v, v, 3.0, 4, bound=b)) == want for b in (6, 40))
    twice = v.filter("vec_id = 3").unionAll(v.filter("vec_id = 3"))
    with pytest.raises(ValueError):
        search.near_pairs_in_blocks(twice, v, 3.0, 4, bound=1)


def test_query_of_near_pairs_has_no_bound(spark, monkeypatch):
    from lodestrata.plans import retrieval

    want = rows(retrieval.r11_near_dup_pairs(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(search.near_pairs, "__defaults__", ("vec_id", 2))
    monkeypatch.setattr(search.near_pairs_in_blocks, "__defaults__", ("vec_id", 2))
    assert want and rows(retrieval.r11_near_dup_pairs(spark, "/root/testdata/sf0.001")) == want


def test_query_of_near_pairs_asks_every_row(spark, tmp_path):
    """only rows with vec_id % 20 = 0 were asked about."""
    from lodestrata.plans import retrieval

    rng = random.Random(11)
    vectors = {i: [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(6)] for i in range(61)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = []
    for i, v in vectors.items():
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), 6), j) for j, x in vectors.items() if j != i)
        want += [(i, j, d, n + 1, round(1 / (1 + d), 6)) for n, (d, j) in enumerate(near[:5]) if d <= 1.2]
    assert {i for i, *_ in want if i % 20} and rows(retrieval.r11_near_dup_pairs(spark, str(tmp_path))) == sorted(want, key=str)


def test_only_large_blocks_of_near_pairs_are_split(spark):
    """one block of more than bound rows doubled the number of all blocks."""
    v = spark.range(90).selectExpr("id AS vec_id", "array(float(id % 23), float(id % 7)) AS embedding")
    got = search.near_pairs_in_blocks(v, v, 2.0, 3, bound=2)
    assert got.select("incoming_id").distinct().count() == 90 and rows(got) == rows(search.near_pairs(v, v, 2.0, 3))
    place = search._place(7, {2: 3, 5: 2}, "vec_id")
    dealt = v.groupBy(search._block(7, "vec_id").alias("b"), place.alias("p")).count().collect()
    assert sorted((r.b, r.p) for r in dealt) == [(0, 0), (1, 1), (2, 2), (2, 7), (2, 8), (3, 3), (4, 4), (5, 5), (5, 9), (6, 6)]


def test_near_pairs_by_matrix_products(spark, monkeypatch):
    """compared pair by pair, 2,000 x 20,000 vectors took minutes. Ties, copies, odd vectors and all blocks and slices against plain sums."""
    rng = random.Random(4)
    made = [[rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(8)] for _ in range(60)]
    vectors = [(i, rng.choice(made)) for i in range(300)] + [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [1.0] * 7), (304, [1e200] * 8), (305, [1e200] * 8), (None, made[0]), (306, [])]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("embedding", F.expr("transform(embedding, x -> CASE WHEN isnan(x) THEN x WHEN x > 1e30 THEN float('inf') ELSE x END)"))
    plain = {i: x for i, x in vectors if i is not None and x and None not in x and x[0] == x[0] and x[0] < 1e30}
    want = []
    for i in plain:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(plain[i], x, strict=True)), 6), j) for j, x in plain.items() if j != i and len(x) == len(plain[i]))
        want += [(i, j, d, n + 1) for n, (d, j) in enumerate(p for p in near[:6] if p[0] <= 1.3)]
    for bound, size in ((1000, 1 << 20), (40, 1 << 20), (1000, 200)):
        monkeypatch.setattr(search, "STORED", size)
        got = [tuple(r)[:4] for r in search.near_pairs_in_blocks(v, v, 1.3, 6, bound=bound).collect() if r.incoming_id != 306]
        assert sorted(got) == sorted(want)
    monkeypatch.undo()
    many = spark.range(20_000).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> float(pmod(xxhash64(id, i), 1000) / 4000)) AS embedding")
    began = time.time()
    found = search.near_pairs_in_blocks(many.filter("vec_id % 10 = 0"), many, 100.0, 5)
    assert found.count() == 10_000 and time.time() - began < 40


def test_hash_embedding(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in search.hash_embedding(docs).collect()}
    place = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 64
    assert got[1][place("a")] == pytest.approx(2 / 5**0.5) and sum(x * x for x in got[1]) == pytest.approx(1) and set(got[2]) == set(got[3]) == {0.0}


# --- intervals -----------------------------------------------------------------------------------------------------


def test_coverage_by_path_suffix_and_closed_lines(spark):
    chunks = spark.createDataFrame([("c1", "src/a/x.py", 1, 10), ("c2", "src/a/x.py", 11, 30), ("c3", "other/x.py", 1, 99), ("c4", "y.py", 5, 5)], "chunk_id string, path string, start_line int, end_line int")
    cites = spark.createDataFrame([("a\\x.py", 10, 4), ("./deep/y.py", 5, 5)], "path string, start_line int, end_line int")
    covered = intervals.coverage(chunks, cites)
    assert {r.chunk_id for r in covered.filter("claimed").collect()} == {"c1", "c4"}
    assert [r.chunk_id for r in intervals.uncovered(covered).collect()] == ["c3", "c2"]
    assert intervals.coverage(chunks, cites.limit(0)).filter("claimed").count() == 0


def test_innermost_is_the_tightest(spark):
    spans = spark.createDataFrame([(1, "class", 1, 15), (1, "method", 3, 8), (1, "same", 3, 8)], "f long, span_id string, start_line int, end_line int")
    refs = spark.createDataFrame([(1, "in", 4, 4), (1, "edge", 8, 8), (1, "out", 20, 20), (1, "wide", 2, 9)], "f long, r string, start_line int, end_line int")
    got = {r.r: r.span_id for r in intervals.innermost(refs, spans, "f", "r", "span_id").collect()}
    assert got == {"in": "method", "edge": "method", "out": None, "wide": "class"}


# --- graph ---------------------------------------------------------------------------------------------------------


def test_resolution_confidences(spark):
    symbols = spark.createDataFrame([(1, "a.py", "py", 1, "only", "m.only"), (2, "a.py", "py", 5, "two", "x.two"), (3, "b.py", "py", 1, "two", "y.two"), (4, "c.go", "go", 1, "alien", "p"), (5, "d.go", "go", 1, "alien", "q")], "symbol_id long, path string, language string, start_line int, name string, qualified_name string")
    refs = spark.createDataFrame([(1, "only", "py", "z.py"), (2, "m.only", "py", "z.py"), (3, "two", "py", "b.py"), (4, "two", "py", "z.py"), (5, "alien", "py", "z.py"), (6, "none", "py", "z.py")], "ref_id long, name string, language string, path string")
    got = {r.ref_id: (r.callee_id, r.confidence) for r in graph.resolve(refs, symbols).collect()}
    assert got == {1: (1, 0.85), 2: (1, 0.85), 3: (3, 0.7), 4: (2, 0.7), 5: (None, 0.4), 6: (None, 0.3)}


def test_callers_fall_back_only_without_any(spark):
    edges = spark.createDataFrame([(1, 7, "f", "calls"), (2, None, "f", "calls"), (3, None, "g", "calls")], "e long, callee_id long, callee_name string, edge_kind string")
    assert [(r.e, r.fallback) for r in graph.callers(edges, 7, "f").collect()] == [(1, False)]
    assert [(r.e, r.fallback) for r in graph.callers(edges, 8, "g").collect()] == [(3, True)]
    assert graph.callers(edges, 7, "f", ["inherits"]).count() == 0


# --- reports and domains -------------------------------------------------------------------------------------------


def test_null_empty_and_zero_differ(spark):
    df = spark.createDataFrame([("a", 1), ("", None), (None, 1)], "x string, y int")
    assert rows(report.fill_counts(df, ["x", "y"])) == [("x", 1, 1, 1), ("y", 2, 0, 1)]
    assert [tuple(r) for r in report.group_null_last(df, "y").collect()] == [(1, 2), (None, 1)]
    assert [tuple(r) for r in report.group_coalesce(df, "y").collect()] == [("1", 2), ("(none)", 1)]
    assert rows(report.fill_rates(report.fill_counts(df, ["x"]), ("x",))) == [("x", 66.6667)]


def test_majority_needs_more_than_half(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "unassigned"), (4, "a"), (4, "unassigned"), (4, "unassigned")], "k long, v string")
    assert rows(report.majority(df, "k", "v", ("unassigned",))) == [(1, "a", "majority"), (2, None, "tie"), (3, None, "none"), (4, "a", "majority")]


def test_named_orders(spark):
    df = spark.createDataFrame([(1, "P1", 0, "Low", "b", "s"), (2, "P9", 5, None, "a", "r"), (3, "P0", 1, "High", "c", "r"), (4, "P1", 2, "Medium", "d", "q")], "gr_id long, priority string, errors long, confidence_extraction string, name string, subject string")
    ids_ = lambda n: [r.gr_id for r in report.in_order(df, n).collect()]
    assert ids_("priority") == ids_("what") == [3, 4, 1, 2] and ids_("ERRORS") == [2, 4, 3, 1] and ids_("confidence") == [1, 4, 2, 3] and ids_("name") == [2, 1, 3, 4] and ids_("subject") == [4, 2, 3, 1] and ids_("id") == [1, 2, 3, 4]


def test_name_search_and_pages(spark):
    df = spark.createDataFrame([(1, "Foo"), (2, "foobar"), (3, "Foo")], "k long, n string")
    assert [r.k for r in report.by_name(df, "n", "Foo", "k").collect()] == [1, 3]
    assert [r.k for r in report.by_name(df, "n", "OOB", "k").collect()] == [2]
    assert [r.k for r in report.page(df, [F.col("k")], 2, 2).collect()] == [3] and report.page(df, [F.col("k")], 0, 9999).count() == 3


def test_domains_first_pattern_and_manual_wins(spark):
    files_ = spark.createDataFrame([("src/a.py",), ("src/b.py",), ("doc/c.md",)], "p string")
    manual = spark.createDataFrame([("src/b.py", "hand"), ("gone.py", "hand")], "p string, domain string")
    patterns = [("src/**", "core"), ("**/a.py", "second")]
    assert {r.p: (r.domain, r.matches) for r in domains.resolve_globs(files_, patterns, "p").collect()}["src/a.py"] == ("core", 2)
    got = rows(domains.reconcile(files_, patterns, manual, "p"))
    assert got == [("doc/c.md", "unassigned", "none"), ("src/a.py", "core", "glob"), ("src/b.py", "hand", "manual")]
    f = domains.freshness(domains.reconcile(files_, patterns, manual, "p")).first()
    assert (f.discovered, f.classified, f.unassigned, f.coverage_pct) == (3, 2, 1, 66.6667)


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = report.upsert(old, new, ["k"])
    assert rows(once) == rows(report.upsert(once, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]


# --- merging -------------------------------------------------------------------------------------------------------


def naive_merge(offers, stored, cites, stored_cites, near):
    """One offer after the other: (outcome, row) of each, and all pairs."""
    ids, anchors, rows_, out, pairs = {}, defaultdict(set), [(g, *c) for g, *c in stored_cites], {}, set()
    for gr, dk, dka in sorted(stored):
        ids.setdefault(dk, gr)
        anchors[dka].add(gr)
    for o, dk, dka in sorted(offers):
        own = [c for i, *c in cites if i == o]
        if dk in ids:
            out[o] = ("merged", ids[dk])
        else:
            ids[dk], found = str(o), {(o, x, "drift") for x in anchors[dka]}
            if not found:
                found = {(o, x, "semantic") for i, x, _ in near if i == o} | {(o, g, "overlap") for g, p, a, b in rows_ for q, c, e in own if p == q and a <= e and b >= c and g != str(o)}
            out[o] = ("candidate" if found else "new", str(o))
            anchors[dka].add(str(o))
            pairs |= found
        rows_ += [(out[o][1], *c) for c in own]
    return out, pairs


def test_merge_outcomes_against_the_sequential_rule(spark):
    rng = random.Random(11)
    line = lambda: (f"f{rng.randrange(6)}", (a := rng.randrange(60)), a + rng.randrange(4))
    for _ in range(3):
        offers = [(i, f"k{rng.randrange(40)}", f"a{rng.randrange(30)}") for i in range(40)]
        stored = [(f"g{i}", f"k{rng.randrange(40)}", f"a{rng.randrange(60)}") for i in range(4)]
        cites, stored_cites = [(rng.randrange(40), *line()) for _ in range(50)], [(f"g{rng.randrange(4)}", *line()) for _ in range(8)]
        near = [(i, f"g{rng.randrange(4)}", 0.5) for i in rng.sample(range(40), 6)]
        o, s = spark.createDataFrame(offers, "ordinal long, dk string, dka string"), spark.createDataFrame(stored, "gr_id string, dk string, dka string")
        lines = "path string, start_line long, end_line long"
        found = merge.outcomes(o, s).cache()
        pairs = merge.merge_pairs(found, s, spark.createDataFrame(cites, f"ordinal long, {lines}"), spark.createDataFrame(stored_cites, f"gr_id string, {lines}"), spark.createDataFrame(near, "ordinal long, other string, similarity double")).cache()
        want, want_pairs = naive_merge(offers, stored, cites, stored_cites, near)
        got = {r.ordinal: (r.outcome, r.gr_ref) for r in merge.merge_outcomes(found, pairs).collect()}
        assert got == want and {(r.ordinal, r.other, r.reason) for r in pairs.collect()} == want_pairs
        assert {x for x, _ in got.values()} == {"merged", "new", "candidate"}


def test_merge_keeps_what_a_human_edited(spark):
    existing = spark.createDataFrame([(1, "c", "live", "old", "rev"), (2, "c", "same", "same", None), (3, "c", "x", "x", None)], "id long, category string, s string, s_extracted string, reviewer string")
    incoming = spark.createDataFrame([(1, "c2", "new"), (2, "c", "same")], "id long, category string, s string")
    got = rows(merge.merged_fields(existing, incoming, "id", ["category"], ["s"], ["reviewer"]))
    assert got == [(1, "c2", "live", "new", "rev", True), (2, "c", "same", "same", None, False), (3, "c", "x", "x", None, False)]


def test_lifecycle_and_import_guard(spark):
    changes = spark.createDataFrame([(1, "draft", "superseded", "p"), (5, "draft", "approved", "p"), (6, "approved", "rejected", None), (2, "reviewed", "approved", None), (3, "reviewed", "approved", "p"), (4, "reviewed", "approved", "p")], "id long, old string, new string, pattern string")
    assert rows(merge.transitions(changes, spark.createDataFrame([(4,)], "id long"))) == [(1, "illegal"), (2, "blocked"), (3, "ok"), (4, "blocked"), (5, "ok"), (6, "ok")]
    stored = spark.createDataFrame([(1, "approved", "ann")], "id long, state string, reviewer string")
    incoming = spark.createDataFrame([(1, "unheard of", "bob", 5), (2, "draft", "bob", 6)], "id long, state string, reviewer string, n int")
    assert rows(merge.import_guard(stored, incoming, "id", ["reviewer"], ["n"])) == [(1, "approved", "ann", 5, True), (2, "draft", "bob", 6, False)]


def test_export_is_the_same_twice(spark, tmp_path):
    parents = spark.createDataFrame([(2, "b"), (1, None)], "key long, name string")
    kids = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "key long, n int, t string")
    lines = merge.export_jsonl(parents, kids, "key", ["n"], ["n", "t"], "kids")
    assert [r.line for r in lines.collect()] == ['{"key":1,"kids":[{"n":1,"t":"x"},{"n":2,"t":"y"}],"name":null}', '{"key":2,"kids":[],"name":"b"}']
    files.write_export(lines, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == [r.line for r in lines.collect()]


# --- validator -----------------------------------------------------------------------------------------------------


STATEMENT = "k long, statement string, rule_class string, pattern string, category string, enforcement_level string, terms array<string>"


def statements(spark, *cases):
    """Rows of (statement, class, pattern, level, terms), numbered; what is left out is null."""
    return spark.createDataFrame([(i, *(list(c) + [None] * 5)[:3], None, *(list(c) + [None] * 5)[3:5]) for i, c in enumerate(cases)], STATEMENT)


B, D = "behavioral", "definitional"
#: Statement, class, pattern, level, terms; findings that must be there, and ones that must not.
CASES = [
    (("A clerk may close an order only if the manager agrees or the limit is met.", B, "B-RESTRICT", "override"), set(), None),
    (("A clerk may close an order.", B, "B-RESTRICT", "strict"), {"V-KW-07", "V-KW-06", "V-KW-01"}, set()),
    (("A must do b. C must not do d.", B, "B-UNCOND"), {"V-KW-04"}, {"V-KW-01"}),
    (("A must do b.",), {"V-CLASS-01"}, set()),
    (("The system must do b.", B, "B-UNCOND"), {"V-SLOT-02"}, set()), (("It must do b.", B, "B-UNCOND"), {"V-VAG-03"}, set()), (("Must do b.", B, "B-UNCOND"), {"V-SLOT-01"}, {"V-VAG-03"}),
    (("A must act.", B, "B-COND"), {"V-SLOT-03"}, set()), (("If a or b, the clerk must act.", B, "B-COND"), set(), {"V-VAG-04", "V-SLOT-03"}), (("A must do b or c.", B, "B-UNCOND"), {"V-VAG-04"}, set()),
    (("A price is always positive.", D, "D-NEC"), set(), {"V-VAG-08"}), (("Every price must be positive.", B, "B-UNCOND"), {"V-VAG-08"}, set()), (("A price is always positive.", B, "B-UNCOND"), {"V-VAG-08", "V-KW-01", "V-KW-02"}, set()),
    (("A must follow the policy.", B, "B-UNCOND"), {"V-VAG-09"}, set()), (("A must follow ISO 9001.", B, "B-UNCOND"), set(), {"V-VAG-09"}), (("A must follow the policy, within 30 days.", B, "B-UNCOND"), {"V-VAG-09"}, set()),
    (("A must follow the manual as of Edition two.", B, "B-UNCOND"), set(), {"V-VAG-09"}), (("A must follow the manual that was given to all the clerks in 2020.", B, "B-UNCOND"), {"V-VAG-09"}, set()),
    (("A must weigh the parcel and print a label.", B, "B-UNCOND"), {"V-SING-01"}, set()), (("A must weigh the parcel and stop.", B, "B-UNCOND"), {"V-SING-01"}, set()), (("A must keep the parcel weight and return address here.", B, "B-UNCOND"), set(), {"V-SING-01"}),
    (("A rate is to be fixed at 5.", D, "D-CONST"), set(), {"V-STY-01", "V-KW-01"}), (("A rate is to be taken by b.", D, "D-CONST"), {"V-STY-01"}, set()), (("It is  required that a must go.", B, "B-UNCOND"), {"V-STY-01"}, set()), (("A must be able to go.", B, "B-UNCOND"), {"V-STY-02"}, set()),
    (("A must call getUser.", B, "B-UNCOND"), {"V-STY-03"}, set()), (("A must use Ledger.", B, "B-UNCOND", None, ["Ledger"]), {"V-STY-03"}, set()), (("A must use a ledger.", B, "B-UNCOND", None, ["Ledger", "us"]), set(), {"V-STY-03"}),
    (("Rate is to be computed as baseRate.", D, "D-COMPUTE"), {"V-STY-03"}, set()), (("Rate is to be fixed at baseRate.", D, "D-CONST"), set(), {"V-STY-03"}), (("Rate is to be considered baseRate if topRate.", D, "D-INFER"), {"V-STY-03"}, {"V-SLOT-03"}),
    (("A should go.", B, "B-UNCOND", "strict"), {"V-KW-05"}, set()), (("A should go.", B, "B-UNCOND", "guideline"), set(), {"V-KW-05"}), (("A shall not go.", B, "B-UNCOND"), {"V-KW-03", "V-KW-01"}, set()),
    (("x", D, None, "strict"), {"V-ENF-01"}, set()), (("x", B, None, "soft"), {"V-ENF-02"}, {"V-ENF-03"}), (("x", B), {"V-ENF-03"}, set()), (("Use the most user  FRIENDLY, etc. if possible", B), {"V-VAG-01", "V-VAG-02", "V-VAG-05", "V-VAG-07"}, set()),
]


def test_validator(spark):
    assert len({n for n, *_ in validate.checks()}) == 28
    found, open_ = defaultdict(set), defaultdict(set)
    df = statements(spark, *(c for c, _, _ in CASES))
    for r in validate.validate(df, "k").collect():
        (found if r.evaluated else open_)[r.k].add(r.finding_id)
    for i, (case, there, absent) in enumerate(CASES):
        assert there <= found[i] if absent is not None else found[i] == there, (case, found[i])
        assert not found[i] & (absent or set()), (case, found[i])
    assert {"V-KW-01", "V-KW-02", "V-SLOT-01", "V-SLOT-02", "V-SLOT-03", "V-VAG-03"} == open_[3] and not open_[0]
    blocked = {r.k for r in validate.blocking(validate.validate(df, "k"), "k").collect()}
    assert 0 not in blocked and 1 in blocked
    native = {(r.k, r.finding_id) for r in validate.native_findings(df, "k").collect()}
    assert native == {(k, f) for k, fs in found.items() for f in fs if f in {n for _, n in native} | {"V-KW-03", "V-STY-01", "V-VAG-06"}}


def test_findings_after_changes(spark):
    old = statements(spark, ("A must act.", B, "B-UNCOND"), ("A may act.", B), ("x", B), ("y", B))
    new = statements(spark, ("A must act.", B, "B-UNCOND"), ("A must act.", B, "B-UNCOND"), ("z", B)).filter("k > 0")
    got = rows(validate.refreshed(validate.validate(old, "k"), new, old.filter("k >= 2").select("k"), "k"))
    assert got == rows(validate.validate(statements(spark, ("A must act.", B, "B-UNCOND"), ("A must act.", B, "B-UNCOND")), "k"))


def test_rows_that_say_the_same_are_checked_once(spark, monkeypatch):
    """every row was checked by itself, 0.1 ms to 1 ms each. Nulls in all columns, a repeated key, and both joins."""
    few = statements(spark, ("A must act.", B, "B-UNCOND", None, ["act", None]), (), ("The price always is significant.", D, None, "wrong", ["price"]), ("A may act.", B))
    want = {r.k: sorted(tuple(x)[1:] for x in validate.validate(few.filter(F.col("k") == r.k), "k").collect()) for r in few.collect()}
    many = spark.range(40_000).withColumn("k", F.col("id") % 4).join(few, "k").select("id", *validate.COLUMNS)
    many = many.unionAll(many.filter("id = 3"))
    for bound in (validate.FEW, 1):
        monkeypatch.setattr(validate, "FEW", bound)
        began = time.time()
        found = validate.validate(many, "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("finding_id", "severity", "span", "evaluated"))).alias("f")).groupBy((F.col("id") % 4).alias("k"), "f").count().collect()
        assert time.time() - began < 60
        got = defaultdict(list)
        for r in found:
            got[r.k].append(([tuple(x) for x in r.f], r["count"]))
        assert {k: v for k, v in got.items() if k != 3} == {k: [(v, 10_000)] for k, v in want.items() if k != 3 and v}
        assert sorted(got[3]) == sorted([(want[3], 9_999), (sorted(want[3] * 2), 1)])


def test_keywords_slots_and_leaks(spark):
    restrict = ("A clerk may close an order only if the manager agrees.", B, "B-RESTRICT")
    df = statements(spark, restrict, ("It must not be; it may be. Only then.",), ("A must do b.",), (), ("A must call getUser in Ledger by jdbc.", None, None, None, ["Ledger", "by", "a.b"]), ("Clé: prix must be €5, always, é.", B, "B-COND"))
    said = defaultdict(list)
    for r in validate.keywords(df, "k").collect():
        said[r.k].append(tuple(r)[1:])
    assert said[0] == [("may ... only", B, "restricted", "8-11,27-31")] and [x[0] for x in said[1]] == ["must not", "may"] and said[5][0][3] == "10-14"
    cut = defaultdict(dict)
    for r in validate.slots(df, "k").collect():
        cut[r.k][r.slot] = (r.span, r.words, r.unsure)
    assert cut[0] == {"action": ("12-26", "close an order", False), "condition": ("35-53", "the manager agrees", False), "subject": ("0-7", "A clerk", False)}
    assert cut[2] == {"action": ("7-11", "do b", True)} and 3 not in cut and cut[5] == {"condition": ("0-20", "Clé: prix must be €5", True)}
    assert [tuple(r)[1:] for r in validate.leaks(df, "k").collect()] == [("12-19", "getUser"), ("23-29", "Ledger"), ("33-37", "jdbc")]
    assert validate.keywords(df.limit(0), "k").count() == validate.validate(df.limit(0), "k").count() == 0


def test_subject_by_majority_or_statement(spark):
    cites = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "unassigned"), (4, "a"), (4, "unassigned"), (4, "excluded"), (6, "excluded")], "k long, domain string")
    df = statements(spark, *[("The clerk must act.", B, "B-UNCOND")] * 7)
    got = {r.k: (r.subject, r.subject_provenance) for r in report.derive_subject(cites, df, "k").collect()}
    said = "The clerk"
    assert got == {0: (said, "derived_ambiguous"), 1: ("a", "derived"), 2: (said, "derived_ambiguous"), 3: (said, "llm_named"), 4: ("a", "derived"), 5: (said, "derived_ambiguous"), 6: (said, "derived_ambiguous")}


def test_bodies_of_entities_and_coverage(spark):
    body = lambda t, a, b, s, e: one(spark, extract.entity_body(F.col("t"), F.col("a"), F.col("b"), F.col("s"), F.col("e")), t=t, a=a, b=b, s=s, e=e)
    assert body("ab", -1, 5, 1, 1) == "ab" and body("ab", 50, 60, 3, 4) is None and body("aé", 1, 3, 1, 1) == "é" and body("aé", 0, 2, 1, 1) == "a\ufffd"
    assert body("a\nb\nc", 1, 1, 2, 3) == "b\nc" and body("a", 0, 2, 0, 1) is None
    payloads = ['{"coverage": {"uncovered": 0}}', '{"coverage": {"uncovered": 3}}', '{"coverage": {"uncovered": 0, "skipped": true}}', '{"coverage": {"uncovered": "0.5"}}', "{}", None]
    got = rows(merge.run_coverage(spark.createDataFrame(list(enumerate(payloads)), "k long, p string"), "k", "p"))
    assert got == [(0, 0, True), (1, 3, False), (2, None, False), (3, None, False), (4, None, False), (5, None, False)]


def test_kinds_of_edges(spark):
    kind = lambda k, lang, said="", name="x", callee=None: one(spark, graph.edge_kind(*(F.col(c) for c in ("k", "n", "e", "l", "c"))), k=k, n=name, e=said, l=lang, c=callee)
    assert [kind("inherits_or_implements", "csharp", name=n, callee=c) for n, c in (("IFoo", None), ("Foo", None), ("IFoo", "class_declaration"), ("Foo", "interface_declaration"))] == ["implements", "inherits", "inherits", "implements"]
    assert kind("x", "sql", "select * from t") == "uses_table" and kind("x", "java", "select * from t") == "references" and kind("x", "java", "EXEC SQL") == "references" and kind("x", "cobol", "EXEC SQL") == "executes_sql"
    assert kind("object_creation_expression", "java", "new Foo()") == "calls" and kind("hibernate_column", "xml") == "uses_column" and kind("method_call", "xml") == "references" and kind("using_directive", "csharp") == "imports"


def test_signs_of_logic(spark):
    logic = lambda t: one(spark, X.has_logic(F.col("t")), t=t)
    assert all(map(logic, ["@Required", "x == y", "RAISE e", "not  null", "return a > b", "foreignkey(x)"])) and not any(map(logic, ["", "verify the vendor", "returned", "ifs and elses", "return a"])) and logic(None) is False


def test_overfetch_and_shortfall(spark):
    found = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(20)], "k long, v string")
    assert rows(search.overfetched(found, [F.col("k")], F.col("v") == "a", 2)) == [(1, "a", 1), (3, "a", 2)]
    assert rows(search.overfetched(found, [F.col("k")], F.col("k") > 8, 2, factor=5)) == [(9, "a", 1)]  # the pool is 10 rows
    notice = lambda a, b: search.shortfall_text(found.limit(a), found.limit(b)).first().notice
    assert [notice(0, 0), notice(3, 0), notice(3, 2), notice(3, 3)] == ["no rows", "no row has a vector", "2 of 3 rows have vectors; 1 cannot be found by meaning", "all rows have vectors"]


def test_domains_in_a_column_fail_if_they_are_no_json(spark):
    good = spark.createDataFrame([('{"domains": [{"domain_id": "x", "path_globs": ["a/**"]}]}',), (None,)], "c string")
    assert [r.c and r.c.domains[0].domain_id for r in files.parsed_domains(good, "c").collect()] == ["x", None]
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        files.parsed_domains(spark.createDataFrame([("{",)], "c string"), "c").collect()


# --- extraction and sources ----------------------------------------------------------------------------------------


def test_ddl_and_citations(spark):
    sql = "CREATE TABLE [dbo].[t] (id INT PRIMARY KEY, -- c INT,\n \"na me\" DECIMAL(10, 2) NOT NULL, r INT REFERENCES x.other(id), CONSTRAINT k CHECK (id > 0)); CREATE TABLE IF NOT EXISTS u (a text); CREATE TABLE cut (b text"
    frame = spark.createDataFrame([(1, sql), (2, None), (3, "")], "k long, t string")
    got = ddl.sql_columns(frame, "k", "t").collect()
    assert [(r.table_name, r.column_name, r.data_type, r.not_null, r.is_primary, r.refers_to) for r in got] == [("t", "id", "INT", False, True, None), ("t", "na me", "DECIMAL(10, 2)", True, False, None), ("t", "r", "INT", False, False, "other"), ("u", "a", "text", False, False, None)]
    raw = spark.createDataFrame([(1, "- a/b.py:1-5,9\nc.sql\n\nbad:1-,2")], "k long, raw string")
    assert rows(extract.citations(raw, "k", "raw")) == [(1, "a/b.py", 1, 5), (1, "a/b.py", 9, 9), (1, "bad", 1, 1), (1, "bad", 2, 2), (1, "c.sql", 1, 2**31 - 1)]


def test_citations_of_all_shapes(spark):
    raws = ['["A.java:1-2, b/c d.java:5-9", "- e.sql", "x:y.py:7-"]', "A.java:24-26,62-70\n* B.java:3, B.java:9-11,14", "A.java:1-2, prose", "[broken", "C:1-2-3", None, "•"]
    got = rows(extract.citations(spark.createDataFrame(list(enumerate(raws)), "k long, raw string"), "k", "raw"))
    whole = 2**31 - 1
    want = [(0, "A.java", 1, 2), (0, "b/c d.java", 5, 9), (0, "e.sql", 1, whole), (0, "x:y.py", 7, 7), (1, "A.java", 24, 26), (1, "A.java", 62, 70), (1, "B.java", 3, 3), (1, "B.java", 9, 11), (1, "B.java", 14, 14), (2, "A.java:1-2, prose", 1, whole), (4, "C:1-2-3", 1, whole)]
    assert got == sorted(want, key=str)
    for bad in ("[broken", "C:1-2-3", "- "):
        with pytest.raises(Exception, match="array|ranges|path"):
            extract.citations(spark.createDataFrame([(1, bad)], "k long, raw string"), "k", "raw", strict=True).collect()


def test_provenance_and_tiers(spark):
    files_ = [("a/own.tld", "<uri>http://my.org/x</uri>"), ("vendor/own.tld", '<x targetNamespace="urn:MY.org">'), ("b/other.xsd", '<x targetNamespace="urn:else">'), ("c/jquery-1.2.js", ""), ("vendor/x.py", None), ("src/x.py", "")]
    df = spark.createDataFrame(files_, "path string, text string")
    got = {r.path: (r.rule, r.detail, r.rescued) for r in provenance.third_party(df, ["my.org"], [r"jquery-[\d.]+js$"], ["vendor/"]).collect()}
    assert got == {"a/own.tld": (None, None, False), "vendor/own.tld": (None, None, True), "b/other.xsd": ("declared_identity", "urn:else", False), "c/jquery-1.2.js": ("vendor_filename", r"jquery-[\d.]+js$", False), "vendor/x.py": ("vendored_globs", "vendor/", False), "src/x.py": (None, None, False)}
    assert {r.path: r.rule for r in provenance.third_party(df, [], [], ["vendor/"]).collect()}["vendor/own.tld"] == "vendored_globs"
    tree = [("src/a.py", 5), ("src/big.py", 99), ("src/a.zzz", 5), ("src/key.PEM", 5), ("lib/cacerts", 5), ("doc/a.pdf", 5), ("img/a.png", 5), ("src/gen/a.py", 5), ("gen.txt", 5), ("skip/a.py", 5)]
    rows_ = provenance.tiered(spark.createDataFrame(tree, "path string, size_bytes long").withColumn("line_count", F.lit(2)), ["src/**"], ["skip/"], ["**/gen/**", "gen.txt"], 50)
    assert {r.path: (r.tier, r.rejected_by, r.matched_glob) for r in rows_.collect()} == {
        "src/a.py": ("indexed", None, None), "src/big.py": ("gap", "size_cap", None), "src/a.zzz": ("gap", "language", None), "src/key.PEM": ("credential", None, None), "lib/cacerts": ("credential", None, None), "doc/a.pdf": ("referenced_content", None, None),
        "img/a.png": ("asset", None, None), "src/gen/a.py": ("first_party_excluded", None, "**/gen/**"), "gen.txt": ("first_party_excluded", None, "gen.txt"),
    }
    assert {r.tier: (r.files, r.size_bytes) for r in provenance.tier_totals(rows_.filter("tier != 'asset'")).collect()} == {"indexed": (1, 5), "credential": (2, 10), "referenced_content": (1, 5), "asset": (0, 0), "first_party_excluded": (2, 10), "gap": (2, 104)}


def test_store_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, "behavioral", "B-COND", "draft", None, None, "x"), (2, "definitional", "B-COND", "odd", None, "strict", None), (3, None, None, "approved", None, None, "x"), (4, None, None, "approved", "delegated", None, "x")], "k long, rule_class string, pattern string, state string, disposition string, enforcement_level string, statement string")
    got = rows(store.violations(df, "k", ["statement"], {"state": ["draft", "approved"]}))
    assert got == [(2, "enforcement_level", "a definitional rule cannot have one"), (2, "pattern", "is of the other class"), (2, "state", "has a value that is not allowed"), (2, "statement", "is empty"), (3, "pattern", "an approved rule needs one")]
    odd = spark.createDataFrame([(1, "invariant", "no json"), (2, "unknown", "{}"), (3, None, None), (4, "decision_table", "{}"), (5, "formula", '{"scale": "s", "meter": "m", "expression": "e", "variables": [{"name": "v"}]}')], "k long, kind string, body string")
    assert rows(store.structured_bodies(odd, "k", "kind", "body")) == [(i, False, None) for i in range(1, 6)]


def test_markup(spark):
    code = spark.createDataFrame([(1, "java", "public class A extends B implements C, D<E> {\n private Order order;\n void f(List<Item> xs) {}\n}"), (2, "python", "class P(Q):\n    def go(self): ...\n")], "k long, language string, text string")
    assert {(r.name, r.line) for r in markup.definitions(code, "k").collect()} == {("A", 1), ("P", 1), ("go", 2)}
    assert {(r.child, r.kind, r.parent) for r in markup.inheritance(code, "k").collect()} == {("A", "extends", "B"), ("A", "implements", "C"), ("A", "implements", "D"), ("P", "inherits_or_implements", "Q")}
    assert {(r.predicate, r.type) for r in markup.type_refs(code, "k").collect()} == {("has_field_of_type", "Order"), ("accepts_dto", "Item")}
    typed = spark.createDataFrame([(1, "csharp", "public Task<Claim> Get(Guid id, DateTime at, Filter f)\n{"), (2, "csharp", "public Guid Id { get; set; }\npublic Owner Who { get; set; }\npublic async Task<Claim> Find(Guid id, [From] Filter f) {\n return Make(x);"), (3, "java", "  Guid id;\n  return x;\n  private final Map<String, Order> all = of();")], "k long, language string, text string")
    assert {(r.k, r.predicate, r.type) for r in markup.type_refs(typed, "k").collect()} == {(2, "has_field_of_type", "Owner"), (2, "returns_dto", "Claim"), (2, "accepts_dto", "Filter"), (3, "has_field_of_type", "Guid"), (3, "has_field_of_type", "Order")}
    xml = "<hibernate-mapping><class name='A' table='T'><property name='x' column='C'/></class></hibernate-mapping>"
    flow = "<flow><view-state id='s'><transition to='e'/></view-state></flow>"
    got = rows(dialects.xml_facts(spark.createDataFrame([(1, xml), (2, flow), (3, "<broken"), (4, None)], "k long, text string"), "k"))
    assert [r[:4] for r in got] == [(1, "has_column", "A", "C"), (1, "maps_to", "A", "T"), (2, "transitions_to", "s", "e")]


def test_sources(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", "src/b.txt": "no", "vendor/c.py": "y", "src/big.py": "z" * 100}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.source_tree(spark, f"file://{tmp_path}", exclude=["vendor/"], most_bytes=50).collect()
    assert [(r.relative_path, r.language, r.sha256, r.text) for r in got] == [("src/a.py", "python", hashlib.sha256(b"x = 1\n").hexdigest(), "x = 1\n")]
    (tmp_path / "p.json").write_text('{"system": "s",\n "confirmedRules": [{"name": "n1"}, {"name": "n2", "edgeCases": ["e"]}]}')
    assert [(r.ordinal, r.name) for r in files.read_payload(spark, f"{tmp_path}/p.json").orderBy("ordinal").collect()] == [(0, "n1"), (1, "n2")]
    (tmp_path / "e.jsonl").write_text('{"gr_id": "1"}\n\n{"x": 2}\n')
    assert files.read_export(spark, f"{tmp_path}/e.jsonl", "gr_id string").count() == 1
    (tmp_path / "d.json").write_text('{"domains": [{"domain_id": "d", "name": "D", "path_globs": ["a/**"]}], "exclusions": ["x"]}')
    assert files.read_domains(spark, f"{tmp_path}/d.json").first().domains[0].path_globs == ["a/**"]


def test_streaming_front_indexes_each_file_once(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i in range(2):
        spark.createDataFrame([(i, "a\nb")], "doc_id long, text string").write.mode("append").parquet(source)
        incremental.index_available(spark, source, "doc_id long, text string", out, f"{tmp_path}/state")
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [0, 1]
