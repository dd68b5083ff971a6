"""N-gram Jaccard join: documents whose word-shingle sets have a similarity of 0.8 or more, as components.

Signatures (PartEnum). If two sets of sizes a and b have a similarity of 0.8, they differ in at most (a + b) / 9
elements, so in at most a / 4 of the smaller one's. The domain of element hashes is cut into groups of PARTS parts, the
number of groups fixed for a band of sizes. A signature is the content of a subset of a group's parts: all subsets that
leave out MAY parts are enumerated. Of a / 4 / (MAY + 1) + 1 groups one has MAY differing elements at most, and there two
similar sets agree in a whole subset; of a / 50 groups more, in as many more. A group counts if more than MAY of its parts hold elements, so that a subset with
elements is among those on which they agree; a set enumerates groups in order until enough of them count. A band covers
sizes L to 2.5 L, and sets in the lowest quarter of a band also sign in the band below, so that any two sets of similar
size have a band in common. A set with too few groups that count signs them all, and again in cuts into single parts
(none may differ), each finer than the last, until it has enough; if two similar sets both fall short,
they meet in the next cut.

Then, each step exact:
1. Only signatures of two different sets count, and only sets with as many shared signatures as any link needs.
2. Of those, only sets of which 80 % of the elements stand in another one.
3. In each signature's bucket all members are compared with a hub, the member that shares most; links give components.
4. In buckets that still hold several components, members of different ones are compared: small buckets pair by pair,
   large ones in blocks of bounded size, gathered by hub, by counting common elements; a block reports no more links
   than join its components. So no link between components is lost, and large groups of near copies, which mostly
   link to their hub, cost rows in proportion to their size.

Equal sets are one set from the beginning, however many documents have it. Sets are named by a 64-bit sum over their
element hashes. A second sum is compared for all documents of a name; where it differs (for 10^10 documents about three
names are expected to), the others get a name of their own, so that different sets are never taken for one.

A key that very many sets have is no single task's work: rows whose key a batch of texts holds twice are known to be
shared, so they are dealt by set, and one row a batch tells the key's own task that it is shared.

Memory: a task holds a batch of texts, or two blocks of BLOCK elements each. What is sent to all tasks is one bit map of
BITS bits at most. Intermediate tables lie in the shared folder.

Defined results: a text that is null or has no words has n_shingles 0 and links with nothing (component_id is its
doc_id); a null doc_id never names a component (null if no other row is in it); repeated rows are one set and keep a
row each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ._common import drop_folder, fresh_name, materialise, small, work_folder
from .components import components
from .shingles import mix, shingle_sets

WORDS = 5
#: Parts of a group, and how many of them may differ.
PARTS, MAY = 3, 1
#: Bytes of text that are worked on at a time; elements of a block; members of a small bucket; bits of the map.
SLICE, BLOCK, SMALL, BITS = 1_000_000, 1 << 18, 24, 1 << 27


def linked(a: int, b: int, common: int) -> bool:
    return 100 * common >= 80 * (a + b - common)


def _sums(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = np.diff(bounds)
    total = np.zeros(len(n), np.uint64)
    if len(hashes):
        total[n > 0] = np.add.reduceat(hashes, bounds[:-1][n > 0])
        total[n > 0] = mix(total[n > 0] + n[n > 0].astype(np.uint64))
    return total


def set_checks(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A second hash of each set."""
    return _sums(mix(elements ^ np.uint64(0xA5A5A5A55A5A5A5B)), bounds).view(np.int64)


def set_ids(elements: np.ndarray, bounds: np.ndarray, names: dict[int, int] | None = None) -> np.ndarray:
    """A hash of each set; 0 for an empty one. names: of a name that several sets have, the second hash of the set that
    keeps it; the others get new names."""
    ids = _sums(mix(elements + np.uint64(1)), bounds).view(np.int64)
    if names:
        checks = set_checks(elements, bounds)
        for i in np.flatnonzero(np.isin(ids, np.array([*names], np.int64))):
            while (keeps := names.get(int(ids[i]))) is not None and keeps != checks[i]:
                ids[i] = mix(ids[i : i + 1].view(np.uint64) + checks[i : i + 1].view(np.uint64)).view(np.int64)[0]
    return ids


def _subsets(parts: int, may: int) -> np.ndarray:
    """A column for each subset that leaves out may of the parts: 1 where a part is in it."""
    out = np.ones((parts, len([*combinations(range(parts), may)])), np.uint64)
    for i, left in enumerate(combinations(range(parts), may)):
        out[list(left), i] = 0
    return out


_kept = {(PARTS, MAY): _subsets(PARTS, MAY), (1, 0): _subsets(1, 0)}


def _enumerated(elements: np.ndarray, groups: int, parts: int, may: int, key: np.uint64) -> tuple[np.ndarray, bool]:
    """The signatures of a sorted set in one cut, and whether enough groups counted."""
    slot = ((elements >> np.uint64(32)) * np.uint64(groups * parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    slot = slot[first].astype(np.int64)
    content = np.add.reduceat(mix(elements + key), first)
    group = slot // parts
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    filled = np.diff(np.append(start, len(group)))
    counted = np.cumsum(filled > may)
    need = len(elements) // 4 // (may + 1) + len(elements) // 50 + 1
    enough = bool(counted[-1] >= need)
    last = int(np.searchsorted(counted, need)) + 1 if enough else len(start)
    end = int(start[last]) if last < len(start) else len(group)
    row, column = np.repeat(np.arange(last), filled[:last]), slot[:end] % parts
    dense, has = np.zeros((last, parts), np.uint64), np.zeros((last, parts), np.uint64)
    dense[row, column], has[row, column] = content[:end], 1
    kept = _kept[parts, may]
    place = (group[start[:last]].astype(np.uint64) * np.uint64(8))[:, None] + np.arange(kept.shape[1], dtype=np.uint64)[None, :]
    return mix(dense @ kept + place * np.uint64(2) + key)[has @ kept > 0], enough


def signatures(elements: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(tag, signatures) of one sorted set of 4 elements or more, by band and cut. tag is need * 4096 + band and cut; need
    is the least number of signatures that the set shares with a similar one, which has 0.8 a elements at least."""
    a = len(elements)
    need = 2 * a // 125 + 1
    own = a.bit_length() - 1
    for band in (own, own - 1) if 4 * a < 5 << own else (own,):
        largest = (5 << band) // 2
        groups, parts, may, cut, enough = (largest // 4 // (MAY + 1) + largest // 50 + 1) * 6 // 5 + 1, PARTS, MAY, 0, False
        while not enough:
            sigs, enough = _enumerated(elements, groups, parts, may, np.uint64((band << 8) + cut + 1))
            yield (need << 12) + (band << 4) + cut, sigs
            if groups >= 1 << 31:  # as fine as the hashes are; each element is alone
                enough = True
            groups, parts, may, cut = min(max(8, 4 << band) * 8**cut, 1 << 31), 1, 0, cut + 1


def _sets(docs: DataFrame, make, schema: str, names: dict[int, int] | None = None) -> DataFrame:
    """make() gives a function from (batch, elements, bounds, ids) to the columns of each batch; the text is its last column."""
    ship(docs.sparkSession)
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            for part in small(b, SLICE):
                elements, bounds = shingle_sets(part.column(part.num_columns - 1).to_pylist(), WORDS)
                columns = work(part, elements, bounds, set_ids(elements, bounds, names))
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.mapInArrow(run, out)


class _Seen:
    """Which sets a task has met; forgets all when there are very many, which only repeats rows."""

    def __init__(self, most: int = 500_000):
        self.ids, self.most = set(), most

    def new(self, ids: np.ndarray) -> list[int]:
        out = []
        for i, x in enumerate(ids.tolist()):
            if x and x not in self.ids:
                self.ids.add(x)
                out.append(i)
        if len(self.ids) > self.most:
            self.ids.clear()
        return out


def memberships(docs: DataFrame, names: dict[int, int] | None = None) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), n_shingles, set_id, check of each row."""

    def make():
        return lambda part, elements, bounds, ids: [part.column(0), part.column(1), part.column(2), pa.array(np.diff(bounds)), pa.array(ids), pa.array(set_checks(elements, bounds))]

    out = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("h1", "h2", "n_shingles", "set_id", "check"))])
    return _sets(docs.select("doc_id", *text_hashes("h1", "h2"), "text"), make, out, names)


def text_hashes(first: str, second: str) -> list:
    return [F.xxhash64("text").alias(first), F.xxhash64("text", F.lit(1)).alias(second)]


def _told(keys: np.ndarray, sets: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    """Rows of a batch as (key, set_id, tag * 4 + kind): of a key that two sets of the batch have, kind 1, and one row more
    of kind 2 that says so; else 0."""
    order = np.lexsort((sets, keys))
    keys, sets, tags = keys[order], sets[order], tags[order].astype(np.int64) * 4
    if len(keys):
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        run = np.cumsum(new) - 1
        several = np.zeros(run[-1] + 1, bool)
        several[run[1:][(sets[1:] != sets[:-1]) & ~new[1:]]] = True
        tags += several[run]
        tell = np.flatnonzero(new)[several]
        keys, sets, tags = np.concatenate((keys, keys[tell])), np.concatenate((sets, sets[tell])), np.concatenate((tags, tags[tell] + 1))
    return [keys, sets, tags]


def signature_rows(docs: DataFrame, names: dict[int, int] | None = None) -> DataFrame:
    """sig, set_id, tag (with kind) of each set's signatures, each set once a task."""

    def make():
        seen = _Seen()

        def work(_, elements, bounds, ids):
            sigs, owner = [np.zeros(0, np.uint64)], []
            for i in seen.new(ids):
                if bounds[i + 1] - bounds[i] >= 4:  # smaller sets link with equal ones only
                    for tag, sig in signatures(elements[bounds[i] : bounds[i + 1]]):
                        sigs.append(sig)
                        owner.append((ids[i], tag, len(sig)))
            sets, tags = (np.repeat(np.array([x[i] for x in owner], np.int64), [x[2] for x in owner]) for i in (0, 1))
            return [pa.array(x) for x in _told(np.concatenate(sigs).view(np.int64), sets, tags)]

        return work

    return _sets(docs.select("text"), make, "sig long, set_id long, tag long", names)


def shared(rows: DataFrame) -> DataFrame:
    """Of rows (key, set_id, tag as _told gives it) those whose key two different sets have; tag without its kind.

    The rows are dealt and sorted by key in the JVM, which spills; a task then streams over them and holds one batch."""
    key, sid, tag = rows.columns[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether the one before has its key

        def out(k, s, t, near):
            keep = (near & (t % 4 == 0)) | (t % 4 == 1)
            return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(s[keep]), pa.array(t[keep] // 4)], names=[key, sid, tag])

        for b in batches:
            k, s, t = (b.column(i).to_numpy() for i in range(3))
            before = False
            if held is not None:
                (hk, hs, ht), before = held
                k, s, t = (np.concatenate((np.array([x], y.dtype), y)) for x, y in ((hk, k), (hs, s), (ht, t)))
            if not len(k):
                continue
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])))
            k, s, t = k[new], s[new], t[new]
            same = np.concatenate(([False], (k[1:] == k[:-1])))
            prev = same.copy()
            prev[0] = before
            near = prev.copy()
            near[:-1] |= same[1:]
            held = (k[-1], s[-1], t[-1]), bool(prev[-1])
            if len(k) > 1:
                yield out(k[:-1], s[:-1], t[:-1], near[:-1])
        if held is not None:
            (hk, hs, ht), before = held
            yield out(np.array([hk], np.int64), np.array([hs], np.int64), np.array([ht], np.int64), np.array([before]))

    deal = F.when(F.col(tag) % 4 == 1, F.xxhash64(sid)).otherwise(F.col(key))
    return rows.repartition(deal).sortWithinPartitions(key, sid, tag).mapInArrow(run, rows.select(key, sid, tag).schema)


def _bit_map(ids: DataFrame) -> np.ndarray:
    """A map of BITS bits at most with the bit of each set_id; all ones in the limit, never wrong about an absent one."""
    bits = min(BITS, max(1 << 16, 1 << (16 * max(1, ids.count())).bit_length()))
    words = ids.selectExpr(f"shiftright(set_id & {bits - 1}, 5) AS w", "shiftleft(1L, cast(set_id & 31 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def sets_of(docs: DataFrame, ids: DataFrame, names: dict[int, int] | None = None) -> DataFrame:
    """set_id, n, elements of the sets in ids (set_id), made again from the texts: only they move."""
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(ids))

    def make():
        seen, bits = _Seen(), sent.value

        def work(_, elements, bounds, found):
            place = found & (len(bits) * 32 - 1)
            hit = (bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1
            at = [i for i in seen.new(np.where(hit == 1, found, 0))]
            parts = [elements[bounds[i] : bounds[i + 1]] for i in at]
            sizes = np.array([len(p) for p in parts], np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
            return [pa.array(found[at]), pa.array(sizes), lists]

        return work

    rows = _sets(docs.select("text"), make, "set_id long, n int, elements array<long>", names)
    return rows.join(ids, "set_id", "left_semi").groupBy("set_id").agg(F.first("n").alias("n"), F.first("elements").alias("elements"))


def _element_rows(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small(b, 2_000_000):
                lists = part.column(2)
                n = np.diff(lists.offsets.to_numpy())
                told = _told(lists.flatten().to_numpy(), np.repeat(part.column(0).to_numpy(), n), np.repeat(part.column(1).to_numpy(), n))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in told], names=["element", "set_id", "tag"])

    return sets.mapInArrow(run, "element long, set_id long, tag long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b: set ids) those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch, 8_000_000):
                a, b, x, y = (part.column(i) for i in range(4))
                flat, bounds = [c.flatten().to_numpy() for c in (x, y)], [c.offsets.to_numpy() - c.offsets[0].as_py() for c in (x, y)]
                keep = []
                for i in range(part.num_rows):
                    p, q = (flat[j][bounds[j][i] : bounds[j][i + 1]] for j in (0, 1))
                    keep.append(linked(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("x")), sets.select(F.col("set_id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _block_links(table: pa.Table) -> pa.Table:
    """Links between different labels in two blocks (or one), no more than join what is not joined yet.

    Columns: i, j, block, set_id, label, elements. For each set outside the commonest label, the sets that share an
    element are counted through lists of each element's owners."""
    one = table["i"][0].as_py() == table["j"][0].as_py()
    ids, labels, block = (table[c].to_numpy() for c in ("set_id", "label", "block"))
    lists = table["elements"].combine_chunks()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(ids)), n)
    values, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(at, kind="stable")
    where = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(values)))))
    by_value = owner[order]
    parent = {int(x): int(x) for x in np.unique(labels)}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    names, count = np.unique(labels, return_counts=True)
    common = names[count.argmax()]
    out = []
    for s in np.flatnonzero(labels != common):
        lists_of = [by_value[where[v] : where[v + 1]] for v in at[bounds[s] : bounds[s + 1]]]
        shared_with = np.bincount(np.concatenate(lists_of), minlength=len(ids)) if lists_of else np.zeros(len(ids), int)
        hits = 100 * shared_with >= 80 * (n[s] + n - shared_with)
        hits &= (labels != labels[s]) & (shared_with > 0)
        if not one:
            hits &= block != block[s]
        for t in np.flatnonzero(hits):
            x, y = find(int(labels[s])), find(int(labels[t]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids[s]), int(ids[t])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _close(a: str, b: str):
    """Whether two sizes can be of linked sets."""
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def links(docs: DataFrame, folder: str, names: dict[int, int] | None = None) -> DataFrame:
    """set_id pairs (a, b) whose components are those of all links between different sets."""
    spark = docs.sparkSession
    rows = materialise(shared(signature_rows(docs, names)), f"{folder}/shared")
    near = rows.groupBy("set_id", "tag").count().filter(F.col("count") >= F.shiftright("tag", 12)).select("set_id").distinct()
    sets = materialise(sets_of(docs, materialise(near, f"{folder}/near"), names), f"{folder}/sets")
    backed = shared(_element_rows(sets)).groupBy("set_id", F.col("tag").alias("n")).count().filter(F.col("count") * 5 >= F.col("n") * 4)
    backed = materialise(backed.select("set_id", "n"), f"{folder}/backed")
    sets = sets.join(backed.select("set_id"), "set_id", "left_semi")
    buckets = rows.join(backed, "set_id").select("sig", "set_id", "n").distinct()
    buckets = materialise(buckets, f"{folder}/buckets")
    score = buckets.groupBy("set_id").agg((F.count(F.lit(1)) / F.first("n")).alias("score"))
    top = buckets.join(score, "set_id").groupBy("sig").agg(F.max(F.struct("score", "set_id", "n")).alias("top"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    hubs = materialise(top.select("sig", F.col("top.set_id").alias("hub"), F.col("top.n").alias("hub_n"), "size"), f"{folder}/hubs")
    stars = buckets.join(hubs, "sig").filter((F.col("set_id") != F.col("hub")) & _close("n", "hub_n")).select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct()
    found = materialise(verified(stars, sets), f"{folder}/stars")
    labels = components(found, f"{folder}/parts")
    known = buckets.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("sig", "set_id", "n", F.coalesce("label", "set_id").alias("label"))
    known = materialise(known, f"{folder}/known")
    mixed = known.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("sig")
    mixed = materialise(mixed.join(hubs, "sig"), f"{folder}/mixed")
    # small buckets: pair by pair, of different components
    member = F.struct("set_id", "n", "label")
    few = known.join(mixed.filter(F.col("size") <= SMALL), "sig").groupBy("sig").agg(F.array_sort(F.collect_list(member)).alias("m"))
    few = few.select(F.posexplode("m").alias("i", "p"), "m").select("p", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("q"))
    few = few.filter("p.label != q.label").select("p.set_id", "p.n", F.col("q.set_id").alias("b"), F.col("q.n").alias("m")).filter(_close("n", "m"))
    pairs = few.select(F.col("set_id").alias("a"), "b").distinct()
    # large ones: gathered by hub, in blocks
    many = known.join(mixed.filter(F.col("size") > SMALL), "sig").select("hub", "set_id", "n", "label").distinct()
    many = materialise(many, f"{folder}/many")
    blocks = many.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = many.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "label").join(sets.select("set_id", "elements"), "set_id")
    cross = dealt.groupBy("hub", "i", "j").applyInArrow(_block_links, "a long, b long")
    rest = materialise(verified(pairs, sets).unionByName(cross), f"{folder}/rest")
    for name in ("shared", "near", "backed", "buckets", "hubs", "known", "mixed", "many", "parts", "sets"):
        drop_folder(spark, f"{folder}/{name}")
    return found.unionByName(rest)


def _named(docs: DataFrame, folder: str) -> tuple[DataFrame, dict[int, int]]:
    """memberships in which no two different sets have one name, and the names that several sets would have had."""
    names: dict[int, int] = {}
    while True:
        members = materialise(memberships(docs, names), f"{folder}/members{len(names)}")
        clash = members.groupBy("set_id").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least != most")
        found = {r.set_id: r.least for r in clash.select("set_id", "least").collect()}  # about n * n / 2 ** 65 of n sets
        if not found:
            return members, names
        drop_folder(docs.sparkSession, f"{folder}/members{len(names)}")
        names |= found


def _labelled(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, h1, h2, n_shingles and label: the same for all rows that links join."""
    members, names = _named(docs, folder)
    labels = components(links(docs, folder, names), f"{folder}/labels")
    known = members.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("doc_id", "h1", "h2", "n_shingles", F.coalesce("label", "set_id").alias("label"))
    known = materialise(known, f"{folder}/labelled")
    for name in (f"members{len(names)}", "labels", "stars", "rest"):
        drop_folder(docs.sparkSession, f"{folder}/{name}")
    return known


def ngram_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included)."""
    folder = work_folder(docs.sparkSession)
    known = _labelled(docs, folder)
    # A plain table, so that Spark can split the rows of a label that very many documents have in the join.
    least = materialise(known.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least")), f"{folder}/least")
    named = known.join(least, "label", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, one with the smallest doc_id; with their own columns.

    Rows without an identifier stay; of rows without words that share identifier and text one stays."""
    names = docs.columns
    h1, h2 = fresh_name("h1", names), fresh_name("h2", names)
    known = _labelled(docs, work_folder(docs.sparkSession)).filter("doc_id is not null")
    row = F.struct("doc_id", "h1", "h2")
    stay = known.filter("n_shingles > 0").groupBy("label").agg(F.min(row).alias("r")).unionByName(known.filter("n_shingles = 0").select("label", row.alias("r")))
    stay = stay.select(F.col("r.doc_id").alias("doc_id"), F.col("r.h1").alias(h1), F.col("r.h2").alias(h2)).distinct()
    rows = docs.filter("doc_id is not null").select("*", *text_hashes(h1, h2)).join(stay, ["doc_id", h1, h2], "left_semi")
    return rows.dropDuplicates(["doc_id", h1, h2]).select(*names).unionByName(docs.filter("doc_id is null"))
