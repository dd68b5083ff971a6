"""Retrieval queries over documents (lexical) and embeddings (vectors, vec_id as doc_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import postings as P
from ..operators import search as S
from ..tables import work_folder
from .catalog import busy_table, query, table

_tok = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_bm = f"""
    w AS (SELECT doc_id, lang, text, {_tok} AS w FROM documents),
    c AS (SELECT doc_id, lang, text, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS f0, len(list_filter(w, lambda x: x = 'and')) AS f1 FROM w),
    s AS (SELECT count(*) AS n, avg(len) AS avgdl, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM c),
    b AS (SELECT doc_id, lang, text, round(0.0
            + (CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END) * (f0 * 2.2) / (f0 + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))
            + (CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END) * (f1 * 2.2) / (f1 + 1.2 * (1 - 0.75 + 0.75 * len / avgdl)), 6) AS score
          FROM c, s WHERE f0 > 0 AND f1 > 0)"""
_lex = "lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b {where} ORDER BY rank LIMIT 40)"
_knn = """
    q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    d AS (SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS dist FROM embeddings, q)"""
_vec = "vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d {where} ORDER BY rank LIMIT 40)"
_rrf = """
    f AS (SELECT coalesce(lex.doc_id, vec.doc_id) AS doc_id, round(coalesce(1.0 / (60 + lex.rank)::DOUBLE, 0.0) + coalesce(1.0 / (60 + vec.rank)::DOUBLE, 0.0), 9) AS score, least(lex.rank, vec.rank) AS best
          FROM lex FULL JOIN vec ON lex.doc_id = vec.doc_id)
    SELECT doc_id, score, best, row_number() OVER (ORDER BY score DESC, best, doc_id) AS rank FROM f ORDER BY rank LIMIT 10"""


def _lexical(docs, where=None):
    found = S.bm25(docs, ["the", "and"])
    return S.ranked(found if where is None else found.join(where, "doc_id", "left_semi"), [F.desc("score"), F.col("doc_id")], 40)


def _vector(vectors, where=None):
    query_ = vectors.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    rows = vectors if where is None else vectors.join(where.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    found = S.nearest(rows, query_, 40)
    return S.ranked(found, [F.col("dist"), F.col("vec_id")], 40).withColumnRenamed("vec_id", "doc_id")


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\\pL\\pM\\pN_]+'), ' ') AS cleaned, CAST(len(regexp_extract_all(text, '[\\pL\\pM\\pN_]+')) AS BIGINT) AS n, CAST(len(list_distinct({_tok})) AS BIGINT) AS n_distinct FROM documents")
def r1_query_tokens(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))  # words of all scripts
    return table(spark, d, "documents").select("doc_id", F.array_join(found, " ").alias("cleaned"), F.size(found).cast("long").alias("n"), F.size(F.array_distinct(X.tokens(F.col("text")))).cast("long").alias("n_distinct"))


@query(f"WITH {_bm} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY rank LIMIT 40")
def r2_bm25_topk(spark, d):
    return _lexical(busy_table(spark, d, "documents"))


@query(f"WITH {_bm} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY rank LIMIT 40")
def r2_bm25_postings(spark, d):
    """The same ranking from postings; a user writes them once and reads them at each search."""
    counts, lengths = S.postings(busy_table(spark, d, "documents"))
    return S.ranked(S.bm25_postings(counts, lengths, ["the", "and"]), [F.desc("score"), F.col("doc_id")], 40)


@query(f"""WITH {_bm}, ws AS (SELECT doc_id, {_tok} AS w FROM documents), m AS (SELECT doc_id FROM ws WHERE len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0 AND NOT contains(concat(' ', array_to_string(w, ' '), ' '), ' of the ')),
    t AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b JOIN m USING (doc_id) ORDER BY rank LIMIT 20)
    SELECT doc_id, score, rank, (SELECT count(*) FROM t JOIN documents USING (doc_id) WHERE lang IS NULL OR lang NOT IN ('en', 'de')) AS dropped FROM t JOIN documents USING (doc_id) WHERE lang IN ('en', 'de')""")
def r3_keyword_search(spark, d):
    return S.keyword_search(busy_table(spark, d, "documents"), '(the AND and) AND th* NOT "of the"', 20, ["en", "de"], state="lang")


_units = f"""WITH w AS (SELECT doc_id, {_tok} AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: starts_with(x, 'th'))) AS f0, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS f1,
        len(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('by', 'for') AND list_contains(w[i:i + 4], 'by') AND list_contains(w[i:i + 4], 'for'))) AS f2, len(list_filter(w, lambda x: x = 'hablees')) AS f3 FROM w),
    s AS (SELECT count(*) AS n, avg(len) AS avgdl, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1, count(*) FILTER (f2 > 0) AS n2 FROM c),
    i AS (SELECT *, greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 0) AS i0, greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 0) AS i1, greatest(ln((n - n2 + 0.5) / (n2 + 0.5)), 0) AS i2, 1.2 * (1 - 0.75 + 0.75 * len / avgdl) AS k FROM c, s WHERE f0 > 0 AND (f1 > 0 OR f2 > 0) AND f3 = 0),
    b AS (SELECT doc_id, round(CASE WHEN i0 = 0 THEN 1e-6 ELSE i0 END * (f0 * 2.2) / (f0 + k) + CASE WHEN i1 = 0 THEN 1e-6 ELSE i1 END * (f1 * 2.2) / (f1 + k) + CASE WHEN i2 = 0 THEN 1e-6 ELSE i2 END * (f2 * 2.2) / (f2 + k), 6) AS score FROM i)
    SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY rank LIMIT 40"""


@query(_units)
def r3_stored_index(spark, d):
    """A prefix, a phrase, nearness and a column filter, matched and ranked from an index that is written once."""
    folder = work_folder(spark)
    P.write_index(busy_table(spark, d, "documents"), folder)
    return P.search_index(spark, folder, 'th* AND ("of the" OR NEAR(by for, 3)) NOT text:hablees', 40).withColumnRenamed("key", "doc_id")


@query(f"WITH w AS (SELECT doc_id, {_tok} AS w FROM documents) SELECT doc_id FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'tion'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'ever'))) = 0 AND len(list_filter(w, lambda x: starts_with(x, 'the'))) > 0")
def r4_prefix_and(spark, d):
    found = S.prefix_and(busy_table(spark, d, "documents"), ["tion", "the"])
    return found.join(S.prefix_and(busy_table(spark, d, "documents"), ["ever"]), "doc_id", "left_anti")


@query(f"WITH {_knn} SELECT vec_id, dist, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d ORDER BY rank LIMIT 40")
def r5_knn(spark, d):
    return _vector(table(spark, d, "embeddings")).withColumnRenamed("doc_id", "vec_id").select("vec_id", "dist", "rank")


@query(f"WITH {_knn} SELECT vec_id, dist, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d WHERE label = 3 ORDER BY rank LIMIT 40")
def r5_knn_filtered(spark, d):
    v = table(spark, d, "embeddings")
    found = S.nearest(v, v.filter("vec_id = 0").select(F.col("embedding").alias("q")), 40, where=F.col("label") == 3)
    return S.ranked(found, [F.col("dist"), F.col("vec_id")], 40).select("vec_id", "dist", "rank")


@query("SELECT count(*) AS n_rows, count(vec_id) AS n_vectors, count(*) - count(vec_id) AS shortfall FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def r6_vector_shortfall(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count("vec_id").alias("n_vectors"), F.count_if(F.col("vec_id").isNull()).alias("shortfall"))


@query(f"""WITH {_knn}, i AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')), r AS (SELECT vec_id AS doc_id, dist, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d WHERE vec_id IN (SELECT doc_id FROM i) ORDER BY rank LIMIT 40)
    SELECT doc_id, dist, rank, (SELECT count(*) FROM i) AS n_rows, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM i)) AS n_vectors FROM r""")
def r6_semantic_search(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return S.semantic_search(table(spark, d, "documents"), v, v.filter("doc_id = 0").select(F.col("embedding").alias("q")), 40, ["en", "fr"], state="lang")


@query(f"WITH {_bm}, {_lex.format(where='')}, {_knn}, {_vec.format(where='')}, {_rrf.strip()}")
def r7_rrf(spark, d):
    return S.fuse(_lexical(busy_table(spark, d, "documents")), _vector(table(spark, d, "embeddings")), "doc_id", 10)


@query(f"WITH {_bm}, {_lex.format(where='WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = $$en$$)')}, {_knn}, {_vec.format(where='WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = $$en$$)')}, {_rrf.strip()}")
def r8_rrf_scoped(spark, d):
    docs = busy_table(spark, d, "documents")
    scope = docs.filter("lang = 'en'").select("doc_id")
    return S.fuse(_lexical(docs, scope), _vector(table(spark, d, "embeddings"), scope), "doc_id", 10)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3 OR lower(n_name) = lower('GerMany') OR lower(n_name) = lower('nation_7')")
def r9_domain_name(spark, d):
    n = table(spark, d, "nation")
    return n.filter((F.col("n_nationkey") == 3) | F.lower("n_name").isin("germany", "nation_7")).select("n_nationkey", "n_name")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:16], chr(10)) AS snippet FROM documents")
def r10_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("""
    WITH q AS (SELECT vec_id AS incoming_id, embedding::DOUBLE[] AS q FROM embeddings),
    p AS (SELECT incoming_id, vec_id AS stored_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS dist FROM embeddings, q WHERE vec_id <> incoming_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY incoming_id ORDER BY dist, stored_id) AS rank FROM p WHERE dist <= 1.2)
    SELECT incoming_id, stored_id, dist, rank, round(1 / (1 + dist), 6) AS similarity FROM r WHERE rank <= 5""")
def r11_near_dup_pairs(spark, d):
    v = table(spark, d, "embeddings")
    return S.near_pairs_in_blocks(v, v, 1.2, 5)


@query()
def r12_hash_embedding(spark, d):
    return S.hash_embedding(table(spark, d, "documents"))


@query("SELECT count(DISTINCT len(embedding)) = 1 AS consistent, CAST(max(len(embedding)) AS BIGINT) AS dim FROM embeddings")
def r13_dimension(spark, d):
    size = F.size("embedding")
    return table(spark, d, "embeddings").agg((F.min(size) == F.max(size)).alias("consistent"), F.max(size).cast("long").alias("dim"))


@query("""SELECT count(*) AS n_rows, (SELECT count(*) FROM embeddings) AS n_vectors, CASE WHEN count(*) = 0 THEN 'no rows' WHEN (SELECT count(*) FROM embeddings) = 0 THEN 'no row has a vector'
    WHEN count(*) > (SELECT count(*) FROM embeddings) THEN concat((SELECT count(*) FROM embeddings), ' of ', count(*), ' rows have vectors; ', count(*) - (SELECT count(*) FROM embeddings), ' cannot be found by meaning') ELSE 'all rows have vectors' END AS notice FROM documents""")
def r14_shortfall_text(spark, d):
    return S.shortfall_text(table(spark, d, "documents"), table(spark, d, "embeddings"))


_dear = "ORDER BY o_totalprice DESC, o_orderkey"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")]


@query(f"SELECT o_orderkey, o_totalprice, row_number() OVER ({_dear}) AS rank FROM orders {_dear} LIMIT 40")
def w1_enumerated(spark, d):
    rows, order = _orders(spark, d)
    return S.ranked(rows.drop("o_orderstatus"), order, 40)


@query(f"WITH pool AS (SELECT * FROM orders {_dear} LIMIT 200) SELECT o_orderkey, o_totalprice, row_number() OVER ({_dear}) AS rank FROM pool WHERE o_orderstatus = 'O' {_dear} LIMIT 40")
def l3_overfetch(spark, d):
    rows, order = _orders(spark, d)
    return S.overfetched(rows, order, F.col("o_orderstatus") == "O", 40).select("o_orderkey", "o_totalprice", "rank")


@query(f"""WITH a AS (SELECT o_orderkey, row_number() OVER ({_dear}) AS r FROM orders {_dear} LIMIT 40), b AS (SELECT o_orderkey, row_number() OVER ({_dear}) AS r FROM orders WHERE o_orderstatus = 'O' {_dear} LIMIT 40)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.r AS r1, b.r AS r2 FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def j17_two_rankings(spark, d):
    rows, order = _orders(spark, d)
    return S.ranks_side_by_side(S.ranked(rows, order, 40), S.ranked(rows.filter("o_orderstatus = 'O'"), order, 40), "o_orderkey")
