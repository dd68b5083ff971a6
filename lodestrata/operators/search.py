"""Retrieval: BM25, exact nearest neighbours and their fusion by reciprocal ranks.

Postings are pre-aggregated per document before the shuffle; rankings end in a top-k, which Spark takes in each task
before one small merge. Every ranking is total: rounded score, then identifier.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, FUSION = 1.2, 0.75, 60


class RawQuery:
    """A query in raw syntax: words, "phrases" and prefix*, side by side (all must be there, binds closest), with NOT, AND and
    OR (in this order, in capitals) and parentheses. matches(w) tests an array of tokens; terms are the words to rank by."""

    def __init__(self, raw: str):
        self.parts, self.at, self.terms = re.findall(r'"[^"]*"|[()]|[^\s()"]+', raw), 0, []
        self.matches = self._either()
        if self.at < len(self.parts):
            raise ValueError(f"what does {self.parts[self.at]} belong to in {raw}?")

    def _next(self) -> str | None:
        return self.parts[self.at] if self.at < len(self.parts) else None

    def _joined(self, word: str, inner, join):
        left = inner()
        while self._next() == word:
            self.at += 1
            left = (lambda a, b: lambda w: join(a(w), b(w)))(left, inner())
        return left

    def _either(self):
        return self._joined("OR", self._all, lambda a, b: a | b)

    def _all(self):
        return self._joined("AND", self._without, lambda a, b: a & b)

    def _without(self):
        kept = len(self.terms)
        left = self._beside()
        while self._next() == "NOT":
            self.at, kept = self.at + 1, len(self.terms)
            right = self._beside()
            del self.terms[kept:]  # what must be absent is no reason to rank
            left = (lambda a, b: lambda w: a(w) & ~b(w))(left, right)
        return left

    def _beside(self):
        left = self._one()
        while self._next() not in (None, ")", "OR", "AND", "NOT"):
            left = (lambda a, b: lambda w: a(w) & b(w))(left, self._one())
        return left

    def _one(self):
        part = self._next()
        self.at += 1
        if part == "(":
            inside = self._either()
            if self._next() != ")":
                raise ValueError("a parenthesis is not closed")
            self.at += 1
            return inside
        if part in (None, ")", "OR", "AND", "NOT"):
            raise ValueError(f"a term is missing before {part or 'the end'}")
        words = re.findall("[a-z0-9]+", part.lower())
        if not words:
            raise ValueError(f"{part} has no word")
        if part.endswith("*") and len(words) == 1:
            return lambda w: F.exists(w, _starts(words[0]))
        self.terms += words
        if len(words) == 1:
            return lambda w: F.array_contains(w, words[0])
        return lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).contains(f" {' '.join(words)} ")


def keyword_search(rows: DataFrame, raw: str, k: int = 20, states: list[str] | None = None, key: str = "doc_id", text: str = "text", state: str = "state") -> DataFrame:
    """key, score, rank, dropped of the k best matches of a raw query; states filters after ranking (ranks stay as they were),
    and dropped says of how many of the k it let none through."""
    query = RawQuery(raw)
    top = ranked(bm25(rows, [*dict.fromkeys(query.terms)], key, text, query.matches), [F.desc("score"), F.col(key)], k)
    kept = rows if states is None else rows.filter(F.col(state).isin(states))
    hits = top.join(kept.select(key).withColumn("kept", F.lit(True)), key, "left")
    n = hits.agg(F.count_if(F.col("kept").isNull()).alias("dropped"))  # one row
    return hits.filter("kept").select(key, "score", "rank").crossJoin(F.broadcast(n))


def semantic_search(rows: DataFrame, vectors: DataFrame, query: DataFrame, k: int, states: list[str] | None = None, key: str = "doc_id", state: str = "state") -> DataFrame:
    """key, dist, rank, n_rows, n_vectors: the k nearest of the rows in these states (filtered before the search), and how many
    such rows there are and have a vector (vectors: key, embedding)."""
    inside = (rows if states is None else rows.filter(F.col(state).isin(states))).select(key)
    found = vectors.join(inside, key, "left_semi")
    n = inside.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(found.agg(F.count(F.lit(1)).alias("n_vectors")))  # two single rows
    return nearest(found, query, k, key).crossJoin(F.broadcast(n))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, key, tf) and (key, len), to be written once, the former dealt and sorted by term: a search then reads its terms."""
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    counts = words.select(key, F.explode("w").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    return counts, words.select(key, F.size("w").alias("len"))


def bm25_postings(counts: DataFrame, lengths: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """bm25 from postings: key, score of the documents with all terms."""
    hits = counts.filter(F.col("term").isin(terms))
    found = hits.groupBy(key).agg(*(F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"f{i}") for i, t in enumerate(terms)))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl")).crossJoin(hits.agg(*(F.count_if(F.col("term") == t).alias(f"n{i}") for i, t in enumerate(terms))))
    rows = found.filter(" AND ".join(f"f{i} > 0" for i in range(len(terms)))).join(lengths, key).crossJoin(F.broadcast(stats))  # one row
    return rows.select(key, F.round(_score(len(terms)), 6).alias("score"))


def _score(n: int) -> Column:
    score = F.lit(0.0)
    for i in range(n):
        raw = F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        score = score + idf * (F.col(f"f{i}") * (K1 + 1)) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return score


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", matches=None) -> DataFrame:
    """key, score of the documents with all terms, or of those that matches (a test of an array of tokens) lets through; the
    text is cut into tokens once, nothing is exploded."""
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    hit = matches(F.col("w")) if matches else reduce(lambda a, b: a & b, (F.array_contains("w", t) for t in terms))
    counted = words.select(key, hit.alias("hit"), F.size("w").alias("len"), *((F.size("w") - F.size(F.array_remove("w", t))).alias(f"f{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))))
    rows = counted.filter("hit").crossJoin(F.broadcast(stats))  # one row of sums
    return rows.select(key, F.round(_score(len(terms)), 6).alias("score"))


def prefix_and(docs: DataFrame, prefixes: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key of the documents that have a token with each of the prefixes."""
    words = docs.select(key, tokens(F.col(text)).alias("w"))
    for p in prefixes:
        words = words.filter(F.exists("w", _starts(p)))
    return words.select(key)


def _starts(prefix: str):
    return lambda x: x.startswith(prefix)


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, in double."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """key, dist, rank of the k rows nearest to the one row of query (column q); where filters first."""
    rows = vectors if where is None else vectors.filter(where)
    found = rows.crossJoin(F.broadcast(query)).select(key, F.round(distance(F.col("embedding"), F.col("q")), 6).alias("dist"))
    return ranked(found, [F.col("dist"), F.col(key)], k)


def ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank; only these k meet in one task."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def ranks_side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, r1, r2 of all rows of two rankings (key, rank); null where a ranking lacks the row."""
    return left.select(key, F.col("rank").alias("r1")).join(right.select(key, F.col("rank").alias("r2")), key, "full_outer")


def overfetched(rows: DataFrame, order: list[Column], where: Column, k: int, factor: int = 5, most: int = 500) -> DataFrame:
    """The first k rows that pass where, out of the min(k * factor, most) best ones, with ranks of their own."""
    pool = ranked(rows, order, min(k * factor, most)).drop("rank")
    return ranked(pool.filter(where), order, k)


def shortfall_text(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """n_rows, n_vectors and, in words, how many rows have no vector."""
    n = rows.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(vectors.agg(F.count(F.lit(1)).alias("n_vectors")))  # two single rows
    missing = F.col("n_rows") - F.col("n_vectors")
    some = F.concat(F.col("n_vectors").cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" rows have vectors; "), missing.cast("string"), F.lit(" cannot be found by meaning"))
    return n.withColumn("notice", F.when(F.col("n_rows") == 0, "no rows").when(F.col("n_vectors") == 0, "no row has a vector").when(missing > 0, some).otherwise("all rows have vectors"))


def fuse(lexical: DataFrame, vector: DataFrame, key: str, k: int, constant: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of two rankings (key, rank): key, score, best."""
    both = ranks_side_by_side(lexical, vector, key)
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    both = both.select(key, F.round(part("r1") + part("r2"), 9).alias("score"), F.least("r1", "r2").alias("best"))
    return ranked(both, [F.desc("score"), F.col("best"), F.col(key)], k)


def near_pairs(incoming: DataFrame, stored: DataFrame, most: float, k: int, key: str = "vec_id", bound: int = 100_000) -> DataFrame:
    """For each incoming row, the k nearest stored ones within a distance, and similarity 1 / (1 + distance).

    incoming is a stated query set, so its size is checked. near_pairs_in_blocks takes any size."""
    if incoming.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} incoming rows: pass them in blocks")
    return _near(incoming, stored, most, k, key, 1)


#: Numbers of the stored rows, and of the incoming ones, that one task compares.
STORED, INCOMING = 1 << 20, 1 << 22
#: More than a distance can change when it is rounded to 6 digits, there and back.
ROUNDED = 2e-6


def _near(incoming: DataFrame, stored: DataFrame, most: float, k: int, key: str, n: int, parts: dict[int, int] | None = None) -> DataFrame:
    """near_pairs, incoming dealt by key into n blocks and the further parts of some: each block meets each slice of the stored
    rows in a task of its own, which hands back what may be among the k nearest; ranks are given over all of these."""
    from ..shipping import ship

    spark, cores = incoming.sparkSession, incoming.sparkSession.sparkContext.defaultParallelism
    kind = "array<float>" if all(x.schema["embedding"].dataType.simpleString() == "array<float>" for x in (incoming, stored)) else "array<double>"
    whole = lambda x: x.filter(F.col(key).isNotNull() & ~F.coalesce(F.exists("embedding", lambda v: v.isNull() | F.isnan(v)), F.lit(True))).select(F.col(key).alias("id"), F.col("embedding").cast(kind).alias("v"))
    asked, there = whole(incoming), whole(stored)
    place, n = _place(n, parts or {}, "id"), n + sum(m - 1 for m in (parts or {}).values())
    numbers = there.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    slices = max(-(-numbers // STORED), -(-cores // n))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = asked.select("id", "v", place.alias("block"), each(slices).alias("slice"), F.lit(False).alias("stored"))
    there = there.select("id", "v", each(n).alias("block"), F.pmod(F.xxhash64("id", "v"), F.lit(slices)).alias("slice"), F.lit(True).alias("stored"))
    cells = asked.unionByName(there).repartitionById(n * slices, (F.col("block") * slices + F.col("slice")).cast("int")).sortWithinPartitions("stored")
    id_kind = cells.schema["id"].dataType.simpleString()
    ship(spark)
    found = cells.select("id", "v", "stored").mapInArrow(lambda batches: _near_in_cell(batches, most, k), f"incoming_id {id_kind}, stored_id {id_kind}, d double")
    pairs = found.select(F.col("incoming_id").cast(incoming.schema[key].dataType), F.col("stored_id").cast(stored.schema[key].dataType), F.round("d", 6).alias("dist")).filter(F.col("dist") <= most)
    rank = F.row_number().over(Window.partitionBy("incoming_id").orderBy("dist", "stored_id"))
    return pairs.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).withColumn("similarity", F.round(1 / (1 + F.col("dist")), 6))


def _block(n: int, key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def _place(n: int, parts: dict[int, int], key: str) -> Column:
    """_block, but a block that parts names is dealt by another hash into so many: the first keeps its number, the others are
    numbered from n on. Only such blocks cost more cells."""
    block = _block(n, key)
    if not parts:
        return block
    ends = list(accumulate(parts[b] - 1 for b in parts))
    known = F.create_map(*(F.lit(x) for b, end in zip(parts, ends, strict=True) for x in (b, end)))
    many = F.create_map(*(F.lit(x) for b in parts for x in (b, parts[b])))
    part = F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.try_element_at(many, block))
    return F.when(part > 0, n + F.try_element_at(known, block) - part).otherwise(block)


def _near_in_cell(batches, most: float, k: int):
    """Batches (incoming_id, stored_id, d) of Arrow batches (id, v, stored), incoming rows first: all pairs that may be among
    the k nearest of an incoming row. Vectors of different lengths make no pairs."""
    import numpy as np
    import pyarrow as pa

    asked, known = {}, None
    for b in batches:
        is_stored = b.column("stored").to_numpy(zero_copy_only=False)
        sizes = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for side in (False, True):
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero((sizes == size) & (is_stored == side)))
                if not len(at):
                    continue
                ids, v = b.column("id").take(at), b.column("v").take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
                if not side:
                    asked.setdefault(size, []).append((ids, v))
                    continue
                if known is None:  # the last incoming row has been read
                    known = {n: (pa.concat_arrays([i for i, _ in x]), np.concatenate([q for _, q in x])) for n, x in asked.items()}
                    best = {n: np.full(len(q), float(most)) for n, (_, q) in known.items()}
                if size in known:
                    for r, c, d in _nearest(known[size], ids, v, best[size], k):
                        yield pa.RecordBatch.from_arrays([known[size][0].take(pa.array(r)), ids.take(pa.array(c)), pa.array(d)], names=["incoming_id", "stored_id", "d"])


def _nearest(asked, ids, v, best, k: int, chunk: int = 128):
    """(incoming rows, stored rows, distances) of pairs within best, a distance for each incoming row that at least k stored
    rows are known to be within (at first the largest one asked for); it shrinks as nearer ones are found.

    A product of matrices gives distances up to an error; what may be near enough is computed as distance() does it, so that
    sums are the same to the last bit. Of equal distances the k smallest identifiers stay."""
    import numpy as np
    import pandas as pd

    queries, q_ids, s_ids = asked[1], asked[0].to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
    order = np.argsort(s_ids, kind="stable")
    s_ids, s = s_ids[order], v[order]
    if len(s_ids) < 2 or (s_ids[1:] != s_ids[:-1]).all():
        # Of equal vectors the smallest identifiers suffice, and one more where the incoming row is among them.
        equal = np.unique(s.view(np.dtype((np.void, max(1, s.strides[0])))).ravel(), return_inverse=True)[1] if s.shape[1] else np.zeros(len(s), int)
        few = pd.Series(equal).groupby(equal).cumcount().to_numpy() <= k
        s_ids, s, order = s_ids[few], s[few], order[few]
    with np.errstate(over="ignore", invalid="ignore"):
        s_norm = np.einsum("ij,ij->i", s, s)
        right = np.column_stack([s * -2, np.ones(len(s)), s_norm]).T
        for first in range(0, len(queries), chunk):
            q, near = queries[first : first + chunk], best[first : first + chunk]
            q_norm = np.einsum("ij,ij->i", q, q)
            about = np.column_stack([q, q_norm, np.ones(len(q))]) @ right
            lo, hi = np.searchsorted(s_ids, q_ids[first : first + chunk], "left"), np.searchsorted(s_ids, q_ids[first : first + chunk], "right")
            for i in np.flatnonzero(lo < hi):
                about[i, lo[i] : hi[i]] = np.inf
            error = 8 * (q.shape[1] + 4) * np.finfo(float).eps * (q_norm + s_norm.max())
            limit = near + error + ROUNDED
            hit = ~(about > limit[:, None])
            if 16 * np.count_nonzero(hit) > hit.size and k < len(s):  # else the k nearest are looked for among the hits below
                limit = np.fmin(limit, np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * error + ROUNDED)
                hit = ~(about > limit[:, None])
            r, c = np.divmod(np.flatnonzero(hit), len(s))
            by = np.lexsort((about[r, c], r))
            r, c = r[by], c[by]
            a, full = about[r, c], np.arange(len(r)) - np.searchsorted(r, r) == k - 1
            limit[r[full]] = np.fmin(limit[r[full]], a[full] + 2 * error[r[full]] + ROUNDED)
            keep = ~(a > limit[r])
            r, c = r[keep], c[keep]
            own = (c >= lo[r]) & (c < hi[r])
            r, c = r[~own], c[~own]
            d = np.empty(len(r))
            for at in range(0, len(r), 1 << 15):
                part = slice(at, at + (1 << 15))
                gap = q[r[part]] - s[c[part]]
                d[part] = np.add.accumulate(gap * gap, axis=1)[:, -1] if q.shape[1] else 0.0
            keep = d <= near[r] + ROUNDED
            r, c, d = r[keep], c[keep], d[keep]
            by = np.lexsort((c, d, r))
            r, c, d = r[by], c[by], d[by]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            full = place == k - 1
            near[r[full]] = np.minimum(near[r[full]], d[full])
            fresh = np.r_[True, (r[1:] != r[:-1]) | (d[1:] != d[:-1])] if len(r) else np.zeros(0, bool)
            tied = np.arange(len(r)) - np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0)) if len(r) else np.zeros(0, int)
            keep = (d <= near[r] + ROUNDED) & (tied < k)
            if keep.any():
                yield r[keep] + first, order[c[keep]], d[keep]


def near_pairs_in_blocks(incoming: DataFrame, stored: DataFrame, most: float, k: int, key: str = "vec_id", bound: int = 100_000) -> DataFrame:
    """near_pairs for any number of incoming rows: they are dealt by key into blocks of at most bound rows (fewer if they are
    long). More than bound rows of one key are refused; rows without a key have no pairs."""
    incoming = incoming.filter(F.col(key).isNotNull())
    rows, numbers = incoming.agg(F.count(F.lit(1)), F.sum(F.size("embedding").cast("long"))).first()
    n, parts = max(1, -(-(numbers or 0) // INCOMING)), {}
    if rows > bound:
        n = max(n, -(-2 * rows // bound))
        while large := {r.b for r in incoming.groupBy(_block(n, key).alias("b"), _place(n, parts, key).alias("p")).count().filter(F.col("count") > bound).collect()}:
            parts |= {b: 2 * parts.get(b, 1) for b in large}
            if max(parts.values()) > rows * rows:
                raise ValueError(f"more than {bound} incoming rows of one key")
    return _near(incoming, stored, most, k, key, n, parts)


def hash_embedding(docs: DataFrame, dim: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, embedding: tokens hashed by an 8-byte blake2b into dim places, scaled to unit length (all 0 without tokens)."""
    from hashlib import blake2b

    import numpy as np
    import pandas as pd

    from ..shipping import ship

    ship(docs.sparkSession)

    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            out = []
            for t in b[text]:
                v = np.zeros(dim)
                for w in re.findall("[a-z0-9]+", (t or "").lower()):
                    if w not in known:
                        known[w] = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "big") % dim
                    v[known[w]] += 1
                n = np.sqrt((v * v).sum())
                out.append((v / n if n else v).tolist())
            yield pd.DataFrame({key: b[key], "embedding": out})
            if len(known) > 200_000:
                known.clear()

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, embedding array<double>")
