"""Phrase collocation mining: count-min sketches find what may be frequent, exact counts follow for that alone.

Texts are cut into pieces at punctuation and line ends, pieces into words. All contiguous runs of 1 to `longest` words
in a piece are counted by language.

First pass: each group of texts counts its runs in a count-min sketch of ROWS rows. A sketch is sent as the
cells that are not empty, by blocks of BLOCK cells. Counts over 255 are sent as 255, which changes nothing below that.
Each block's sketches are merged by adding, and every group gets back which of its own cells have reached the least
frequency. A cell's count is never below that of a run that falls into it, so nothing frequent is lost. The number of
cells grows with the texts, so that the share of false survivors does not, and no task needs the whole sketch.

Second pass: each group counts, exactly, the runs whose cells all survived and whose own parts did too (a run is at most
as frequent as its parts). Words are told apart by themselves and longer runs by the run before and its last word, not
by hashes. Sums over all groups are exact counts; those under the least frequency go. Counts travel as lists, by buckets
of phrases: a phrase is a row only when its sum is known.

Then candidates are scored at their lowest-scoring cut, and dropped if a longer candidate that holds them is as
frequent. These are joins of the table of frequent runs.

The texts are stored once, compressed, a row for each language of a group; a group has about GROUP bytes of text, or one
long text. The first pass reads them as they lie; only the second deals them, to bring each group together with its
answers.

Defined results: a null text counts as empty, a null language as und; repeated rows count each; a table without frequent
phrases gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import materialise, small, work_folder
from .shingles import mix

# What ends a piece, what separates words.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
UNKNOWN = "und"
#: Words of a phrase; least frequency; phrases a language; per cent of a candidate's frequency from which a longer one subsumes it.
LONGEST, LEAST, TOP, SHARE = 5, 100, 2000, 100
#: Neighbouring groups (2 to the power of) that are counted together.
NEAR = 3
#: Languages up to which their totals are sent to all tasks.
LANGUAGES = 100_000
#: Rows of a sketch; cells of a block; bytes of text a group, and a cell; bytes that are cut into words at a time.
ROWS, BLOCK, GROUP, DENSITY, SLICE = 2, 1 << 21, 6_000_000, 64, 1 << 20

_table = bytes(ord("\n") if c in BREAKS else ord(" ") if c in GAPS else c for c in range(256))
_weights = np.random.default_rng(13).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_seeds = np.random.default_rng(31).integers(0, 1 << 64, 8, dtype=np.uint64)


class Words(dict):
    """Numbers of words, in the order in which they come; 0 ends a piece."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def plain(texts: list[str]) -> bytes:
    """Texts as bytes with a-z for A-Z, line ends where pieces end (after each text, too) and spaces between words."""
    return b"".join([t.encode("utf-8", "surrogatepass").lower().translate(_table) + b"\n" for t in texts])


def numbered(data: bytes, words: Words) -> np.ndarray:
    """The numbers of all words of plain texts, and 0 where a piece ends."""
    out, low = [np.zeros(0, np.int32)], 0
    while low < len(data):  # in slices that end between words
        ends = [x for x in (data.find(b" ", low + SLICE), data.find(b"\n", low + SLICE)) if x >= 0]
        high = min(ends, default=len(data) - 1) + 1
        tokens = data[low:high].replace(b"\n", b" \n ").split(b" ")
        out.append(np.fromiter((words[t] for t in tokens if t), np.int32))
        low = high
    return np.concatenate(out)


def word_hashes(words: Words, language: str) -> np.ndarray:
    """A hash of each numbered word in a language."""
    seed = xxhash.xxh64_intdigest(language.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def run_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words that begins at these places; hashes are those of the words in order."""
    total = hashes[at] * _weights[0]
    for i in range(1, n):
        total += hashes[at + i] * _weights[i]
    return mix(total + np.uint64(n))


def cells(runs: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each run in a row of the sketch."""
    return (runs ^ _seeds[row]) * _weights[15 - row] >> np.uint64(64 - bits)


def starts_of(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """n and the places at which runs of n words begin, for all n."""
    at = np.flatnonzero(ids)
    for n in range(1, longest + 1):
        if n > 1:
            at = at[at + n - 1 < len(ids)]
            at = at[ids[at + n - 1] != 0]
        yield n, at


def squeezed(data: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(data).tobytes(), "zstd", asbytes=True)


def unsqueezed(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.uint8)


def packed_cells(found: np.ndarray) -> bytes:
    """Cells in ascending order as differences of three bytes: all first bytes, all second ones, all third ones, compressed."""
    steps = np.diff(found, prepend=found[:1]).astype("<u4")
    return squeezed(steps.view(np.uint8).reshape(-1, 4)[:, :3].T)


def unpacked_cells(first: int, steps: bytes, n: int) -> np.ndarray:
    low, mid, high = unsqueezed(steps, 3 * n).reshape(3, n).astype(np.int64)
    return np.cumsum(low | mid << 8 | high << 16) + first


def _dealt(most: int):
    """grp, lang, n, said: groups of texts of about most bytes, in one compressed row for each language of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, filled, held = TaskContext.get().partitionId() << 32, 0, {}

        def rows() -> pa.RecordBatch:
            data = {lang: b"".join(said) for lang, said in held.items()}
            return pa.RecordBatch.from_arrays(_rows([(group, lang, len(d), pa.compress(d, "zstd", asbytes=True)) for lang, d in data.items()], TEXTS), schema=TEXTS)

        for batch in batches:
            for part in small(batch, most):
                for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.setdefault(lang, []).append(plain([text]))
                    filled += len(held[lang][-1])
                    if filled >= most:
                        yield rows()
                        group, filled = group + 1, 0
                        held.clear()
        if held:
            yield rows()

    return run


TEXTS = pa.schema([("grp", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("said", pa.binary())])
SKETCH = pa.schema([("grp", pa.int64()), ("row", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("steps", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("grp", pa.int64()), ("row", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("steps", pa.binary())])
COUNTS = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("phrase", pa.list_(pa.string())), ("f", pa.list_(pa.int64()))])
RUNS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]


def _sketch(bits: int, longest: int):
    """A group's sketch: of each row and block the cells that are not empty, which of them hold several, and how many."""

    def one(group: int, texts: list[tuple[str, bytes]]) -> pa.RecordBatch:
        found, out = [np.zeros(0, np.uint64)], []
        for lang, said in texts:
            words = Words()
            ids = numbered(said, words)
            hashes = word_hashes(words, lang)[ids]
            found += [run_hashes(hashes, at, n) for n, at in starts_of(ids, longest)]
        runs = np.concatenate(found)
        del found
        for row in range(ROWS):  # one after the other, so that a task holds the cells of one row
            cell, count = np.unique(cells(runs, row, bits), return_counts=True)
            count = np.minimum(count, 255).astype(np.uint8)
            block = cell // np.uint64(BLOCK)
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(cell) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                several = count[a:b] > 1
                out.append((group, row, int(block[a]), int(cell[a]), int(b - a), packed_cells(cell[a:b]), squeezed(np.packbits(several)), squeezed(count[a:b][several])))
        return pa.RecordBatch.from_arrays(_rows(out, SKETCH), schema=SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A group that a reader cuts in two gives two sketches, which are added like any others.
        group, texts = None, []
        for batch in batches:
            for g, lang, n, said in zip(*batch.columns, strict=True):
                if g.as_py() != group and texts:
                    yield one(group, texts)
                    texts = []
                group = g.as_py()
                texts.append((lang.as_py(), pa.decompress(said.as_buffer(), n.as_py(), "zstd", asbytes=True)))
        if texts:
            yield one(group, texts)

    return run


def _merge(least: int):
    """Of each group's cells in one block those whose merged count reaches the least frequency."""

    def run(table: pa.Table) -> pa.Table:
        base, row = table.column("block")[0].as_py() * BLOCK, table.column("row")[0].as_py()
        total, out = np.zeros(BLOCK, np.uint32), []

        def several(n, many, counts):
            where = np.unpackbits(unsqueezed(many, -(-n // 8)), count=n).astype(bool)
            return where, unsqueezed(counts, int(where.sum()))

        def parts():
            for g, f, n, steps, many, counts in zip(*(table.column(c) for c in ("grp", "first", "n", "steps", "many", "counts")), strict=True):
                n = n.as_py()
                yield g.as_py(), unpacked_cells(f.as_py() - base, steps.as_py(), n), *several(n, many.as_py(), counts.as_py())

        for _, at, many, counts in parts():
            total[at] += 1  # a sketch has a cell once
            total[at[many]] += counts - np.uint8(1)
        for g, at, _, _ in parts():
            at = at[total[at] >= min(least, 255)]
            if len(at):
                out.append((g, row, int(at[0]) + base, len(at), packed_cells(at)))
        return pa.Table.from_arrays(_rows(out, ANSWER), schema=ANSWER)

    return run


class Survivors:
    """Membership in ascending cells: one bit of a small map first, a search for what passes."""

    def __init__(self, found: np.ndarray):
        self.cells, self.map = found, np.zeros(1 << 22, bool)
        self.map[found & np.uint64((1 << 22) - 1)] = True

    def holds(self, wanted: np.ndarray) -> np.ndarray:
        out = self.map[wanted & np.uint64((1 << 22) - 1)]
        some = np.flatnonzero(out)
        at = np.searchsorted(self.cells, wanted[some])
        at[at == len(self.cells)] = 0
        out[some] = self.cells[at] == wanted[some] if len(self.cells) else False
        return out


def _count(bits: int, longest: int, buckets: int):
    """A group's exact counts of the runs that survive (the empty phrase: all its words), in lists by bucket."""

    def counted(lang: str, said: bytes, alive: list[Survivors]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
        """bucket, phrase, f of a language's runs, a size at a time."""
        words = Words()
        ids = numbered(said, words)
        hashes, names = word_hashes(words, lang)[ids], list(words)
        yield np.zeros(1, np.int64), [""], np.array([(ids != 0).sum()])
        at, one = np.flatnonzero(ids), ids.astype(np.int64)
        before: np.ndarray | None = None  # at each place the number of the run that begins there, -1 if it did not survive
        spelled: list[bytes] = []
        for n in range(1, longest + 1):
            if n > 1:
                at = at[at + n - 1 < len(ids)]
                at = at[(before[at] >= 0) & (before[at + 1] >= 0) & (one[at + n - 1] != 0)]
            runs = run_hashes(hashes, at, n)
            for row in range(ROWS):
                some = alive[row].holds(cells(runs, row, bits))
                at, runs = at[some], runs[some]
            key = one[at] if n == 1 else before[at] << 32 | one[at + n - 1]
            kinds, first, where, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            if not len(kinds):
                return
            spelled = [names[k] if n == 1 else spelled[k >> 32] + b" " + names[k & 0xFFFFFFFF] for k in kinds.tolist()]
            before = np.full(len(ids), -1, np.int64)
            before[at] = where
            yield (runs[first] % np.uint64(buckets)).astype(np.int64), [s.decode("utf-8", "surrogatepass") for s in spelled], counts

    def alive_in(answers: pa.Table, group: int) -> list[Survivors]:
        mine: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(ROWS)]
        for r, f, n, s in zip(*(answers.filter(pc.equal(answers.column("grp"), group)).column(c).to_pylist() for c in ("row", "first", "n", "steps")), strict=True):
            mine[r].append(unpacked_cells(f, s, n))
        return [Survivors(np.unique(np.concatenate(x)).astype(np.uint64)) for x in mine]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found = []
        for group in pc.unique(texts.column("grp")).to_pylist():  # neighbours, one after the other; what they count is added up here
            alive, rows = alive_in(answers, group), texts.filter(pc.equal(texts.column("grp"), group))
            for lang, n, said in zip(*(rows.column(c) for c in ("lang", "n", "said")), strict=True):
                lang = lang.as_py()
                for bucket, phrase, f in counted(lang, pa.decompress(said.as_buffer(), n.as_py(), "zstd", asbytes=True), alive):
                    found.append(pa.table({"bucket": bucket, "lang": pa.array([lang] * len(f), pa.string()), "phrase": pa.array(phrase, pa.string()), "f": f.astype(np.int64)}))
        total = pa.concat_tables(found).group_by(["bucket", "lang", "phrase"]).aggregate([("f", "sum")]).sort_by([("bucket", "ascending"), ("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()
        bucket, lang = total.column("bucket").to_numpy(), total.column("lang").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1]), [True]))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(starts), total.column(c).combine_chunks()) for c in ("phrase", "f_sum")]
        first = pa.array(starts[:-1])
        return pa.Table.from_arrays([total.column("bucket").take(first), total.column("lang").take(first), *lists], schema=COUNTS)

    return run


def _sum(least: int):
    """The runs of one bucket with their frequency in all groups, if it reaches the least."""

    def run(table: pa.Table) -> pa.Table:
        at = pc.list_parent_indices(table.column("f").combine_chunks())
        phrase, f = (pc.list_flatten(table.column(c).combine_chunks()) for c in ("phrase", "f"))
        rows = pa.Table.from_arrays([table.column("lang").combine_chunks().take(at), phrase, f], names=["lang", "phrase", "f"])
        total = rows.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        total = total.filter(pc.or_(pc.greater_equal(total.column("f_sum"), least), pc.equal(total.column("phrase"), "")))
        size = pc.if_else(pc.equal(total.column("phrase"), ""), 0, pc.add(pc.count_substring(total.column("phrase"), " "), 1))
        return pa.Table.from_arrays([total.column("lang"), size, total.column("phrase"), total.column("f_sum")], names=RUNS.names).cast(RUNS)

    return run


def frequent_runs(docs: DataFrame, folder: str, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, size, phrase, f of all runs of 1 to longest words with a frequency of least or more; with size 0, all words of a language."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, buckets = max(21, int(size // DENSITY).bit_length()), max(spark.sparkContext.defaultParallelism, size // GROUP // 8)
    texts = materialise(rows.mapInArrow(_dealt(GROUP), "grp long, lang string, n long, said binary"), f"{folder}/texts")
    sketches = texts.mapInArrow(_sketch(bits, longest), "grp long, row int, block long, first long, n long, steps binary, many binary, counts binary")
    answers = materialise(sketches.groupBy("row", "block").applyInArrow(_merge(least), "grp long, row int, first long, n long, steps binary"), f"{folder}/answers")
    near = F.shiftright("grp", NEAR)
    parts = texts.groupBy(near.alias("near")).cogroup(answers.groupBy(near.alias("near"))).applyInArrow(_count(bits, longest, buckets), "bucket long, lang string, phrase array<string>, f array<long>")
    return parts.groupBy("bucket").applyInArrow(_sum(least), "lang string, size int, phrase string, f long")


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) of columns of longs up to 10^17, in decimals of 38 digits: exact where products pass 64 bits."""
    whole = lambda c, digits=18: F.col(c).cast(f"decimal({digits},0)")
    above = (whole(a, 17) * whole(n, 17)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (whole(left) * whole(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, then frequency, then bytes.

    a is the phrase's frequency, l and r those of the parts at its lowest-scoring cut, n all words of the language,
    score floor(1000 a n / (l r))."""
    folder = work_folder(docs.sparkSession)
    runs = materialise(frequent_runs(docs, folder, least, longest), f"{folder}/runs")
    counted = runs.filter("size > 0").select("lang", "phrase", "f")
    totals = runs.filter("size = 0").select("lang", F.col("f").alias("n"))
    if totals.count() <= LANGUAGES:
        totals = F.broadcast(totals)
    words = F.split("phrase", " ")
    candidates = runs.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), words.alias("w"))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, f: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = scored.withColumn("score", score("a", "n", "l", "r"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    # All contiguous parts of two words or more of each candidate, with its frequency.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    held = candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
