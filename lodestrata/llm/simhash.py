"""SimHash near-dedup: fingerprints, linked by pivot distance tables.

A bit of a fingerprint is set if it is set in over half of the hashes of the text's shingles. Two fingerprints link if
DISTANCE bits or fewer differ; documents are grouped by what links reach.

Which fingerprints meet: the 64 bits are cut into DISTANCE + r blocks. Of two that link, at least r blocks are equal, so
each is dealt once for every choice of r blocks, by their content. r grows with the number of different fingerprints, so
that unlike ones seldom meet. Equal fingerprints are one from the beginning.

Where they meet, a pivot distance table decides: the Hamming distances of each member to PIVOTS reference fingerprints,
computed once a member. By the triangle inequality a pair whose coordinates differ by more than DISTANCE anywhere cannot
link; the largest difference discards it, one pivot after the other, and what survives all pivots is verified bit by
bit. A member that was reached is not looked at again, so a dense group of n members costs about n steps over what is
left of it, and at most n - 1 links leave a task, whatever the number of pairs.

A meeting place of more than CELL members is dealt out as pairs of slices, every two slices in one task. The slices grow
with the root of the members, so a group of n is copied about sqrt(n) / 32 times, and a task holds two slices, not the group.

Defined results: a text that is null or has no words has fingerprint 0, which links like any other; a null doc_id has a
fingerprint, but names no component and passes on no link of its own (null, if no other row has its fingerprint);
repeated rows keep a row each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ._common import drop_folder, map_texts, materialise, work_folder
from .components import components, roots

WORDS, SEED, DISTANCE = 4, 42, 4
#: Reference fingerprints; members of a meeting place that are taken together; members up to which all pairs are formed at once.
PIVOTS, CELL, FEW = 32, 4096, 64
#: Unlike fingerprints that may meet at one place, on average, before r grows.
CROWD = 256
#: Fingerprints with more than this share of the rows are sent to all tasks: 10,000 at most.
HEAVY = 1 / 10_000
#: Shingles, and rows, that are worked on at a time.
SLICE, ROWS = 1 << 16, 1 << 18


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a text, unsigned: a-z for A-Z, runs of `words` words, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both change and split at ASCII only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones, hash_ = len(parts) - words + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for low in range(0, n, SLICE):
        high = min(n, low + SLICE)
        cuts = zip(starts[low:high].tolist(), ends[low + words - 1 : high + words - 1].tolist(), strict=True)
        hashes = np.array([hash_(joined[a:b], seed) for a, b in cuts], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The columns in keep, and fp: the fingerprint as a long of the same bits."""

    def start():
        return lambda texts: [(int(np.uint64(fingerprint(t, words, seed)).astype(np.int64)),) for t in texts]

    return map_texts(docs, start, [T.StructField("fp", T.LongType())], list(keep))


def as_hex(fp: Column) -> Column:
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def masks(r: int, distance: int = DISTANCE) -> list[int]:
    """Every choice of r of distance + r blocks of the 64 bits, as signed longs."""
    edges = [64 * i // (distance + r) for i in range(distance + r + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [x - (1 << 64) if x >> 63 else x for x in (sum(c) for c in combinations(blocks, r))]


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The least r at which n unlike fingerprints meet at places of CROWD, at most, on average."""
    r = 1
    while n > CROWD * 2 ** (64 * r // (distance + r)) and r < 4:
        r += 1
    return r


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints, the same everywhere."""
    return np.random.default_rng(20250101).integers(0, 1 << 64, n, dtype=np.uint64)


def distance_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The Hamming distance of each fingerprint to each pivot: a row a pivot."""
    return np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in pivots]) if len(pivots) else np.zeros((0, len(fps)), np.int8)


def survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """The places of the pairs (a[i], b[i]) whose coordinates differ by distance at most at every pivot."""
    at = np.arange(len(a))
    for row in table:
        if not len(at):
            break
        at = at[np.abs(row[a[at]] - row[b[at]]) <= distance]
    return at


def linked(fps: np.ndarray, group: np.ndarray, side: np.ndarray, pivots: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (places a, b) that join what pairs of one group, within distance, join. Rows of a group stand together; a pair
    counts if side is -1 (all pairs of the group) or differs."""
    table = distance_table(fps, pivots)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(first, len(group)))
    left, right = [], []

    def close(a, b):
        return np.bitwise_count(fps[a] ^ fps[b]) <= distance

    left_in_group = np.repeat(first + sizes, sizes) - np.arange(len(group))
    some = np.flatnonzero(np.repeat(sizes, sizes) <= FEW)
    for step in range(1, int(min(sizes.max(initial=1), FEW))):  # small groups: all pairs that are step rows apart, of all groups at once
        some = some[left_in_group[some] > step]
        a, b = some, some + step
        wanted = (side[a] < 0) | (side[a] != side[b])
        a, b = a[wanted], b[wanted]
        at = survivors(table, a, b, distance)
        at = at[close(a[at], b[at])]
        left.append(a[at])
        right.append(b[at])
    for start, size in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        rest = np.arange(start, start + size)
        while len(rest):
            reached, rest = [int(rest[0])], rest[1:]
            while reached and len(rest):
                x = reached.pop()
                near = rest if side[x] < 0 else rest[side[rest] != side[x]]
                for row in table:  # the largest difference of coordinates, found one pivot after the other
                    if not len(near):
                        break
                    near = near[np.abs(row[near] - row[x]) <= distance]
                near = near[np.bitwise_count(fps[near] ^ fps[x]) <= distance]
                if len(near):
                    left.append(np.full(len(near), x))
                    right.append(near)
                    reached.extend(near.tolist())
                    rest = rest[~np.isin(rest, near, assume_unique=True)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(batches: Iterator[pa.RecordBatch], distance: int, n_pivots: int) -> Iterator[pa.RecordBatch]:
    """a, b of rows (choice, content, i, j, side, fp) that come in order of their meeting place (the first four): links that join."""
    pivots, held = references(n_pivots), None
    for batch in chain_last(batches):
        if batch is not None:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if held is None or not len(held[0]):
            continue
        moved = np.zeros(len(held[0]) - 1, bool)
        for x in held[:4]:
            moved |= x[1:] != x[:-1]
        group = np.concatenate(([0], np.cumsum(moved)))
        whole = len(group) if batch is None else int(np.searchsorted(group, group[-1]))  # the last group may go on
        if batch is not None and whole < ROWS // 4:
            continue
        fps = held[5][:whole].view(np.uint64)
        a, b = linked(fps, group[:whole], held[4][:whole], pivots, distance) if whole else (np.zeros(0, np.int64),) * 2
        nodes, low = roots(fps[a].view(np.int64), fps[b].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != low]), pa.array(low[nodes != low])], names=["a", "b"])
        held = [x[whole:] for x in held]


def chain_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None when they are over."""
    yield from batches
    yield None


def links(distinct: DataFrame, folder: str, distance: int = DISTANCE, n_pivots: int = PIVOTS) -> DataFrame:
    """a, b: links between the fingerprints of distinct (fp, once each) that join all that pairs within distance join."""
    ship(distinct.sparkSession)
    spark = distinct.sparkSession
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("content")) for i, m in enumerate(masks(blocks_for(distinct.count(), distance), distance))))
    dealt = distinct.select("fp", F.explode(choices).alias("c")).select("c.choice", "c.content", "fp")
    crowded = materialise(dealt.groupBy("choice", "content").count().filter(F.col("count") > CELL), f"{folder}/crowded")
    slices = F.ceil(F.col("count") / F.greatest(F.lit(float(CELL)), 32 * F.sqrt("count"))).cast("int")
    # Of n different fingerprints, n / CELL places a choice are crowded, so few that they are sent to all tasks if they are at most 100,000.
    crowded = crowded.select("choice", "content", slices.alias("slices"))
    cells = dealt.join(F.broadcast(crowded) if crowded.count() <= 100_000 else crowded, ["choice", "content"], "left")
    cells = cells.withColumn("slice", F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))
    side = F.when(F.col("slice") == F.col("other"), -1).otherwise(F.col("slice"))
    cells = cells.select("choice", "content", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), side.cast("int").alias("side"), "fp")
    place = ["choice", "content", "i", "j"]
    found = cells.repartition(*place).sortWithinPartitions(*place).mapInArrow(lambda batches: _links(batches, distance, n_pivots), "a long, b long")
    found = materialise(found, f"{folder}/links")
    drop_folder(spark, f"{folder}/crowded")
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, distance: int = DISTANCE, n_pivots: int = PIVOTS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 digits), component_id (the smallest doc_id that links reach, itself included)."""
    spark = docs.sparkSession
    folder = work_folder(spark)
    known = materialise(fingerprints(docs, words=words, seed=seed), f"{folder}/known")
    distinct = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), f"{folder}/distinct")
    labels = components(links(distinct.filter("least is not null").select("fp"), folder, distance, n_pivots), f"{folder}/labels")
    named = materialise(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), f"{folder}/named")
    least = materialise(named.groupBy("label").agg(F.min("least").alias("component_id")), f"{folder}/least")
    named = materialise(named.join(least, "label").select("fp", "rows", "component_id"), f"{folder}/names")
    for name in ("distinct", "links", "labels", "named", "least"):
        drop_folder(spark, f"{folder}/{name}")
    # A fingerprint that very many rows have is joined where the rows are, not where its own row is; of n rows, 1 / HEAVY such at most.
    heavy = F.broadcast(named.filter(F.col("rows") > HEAVY * known.count()).drop("rows"))
    often = known.join(heavy, "fp")
    rest = known.join(heavy, "fp", "left_anti").join(named.drop("rows"), "fp")
    return often.unionByName(rest).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
