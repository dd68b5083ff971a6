"""Fill-in-middle transformation by an event scan.

One Aho-Corasick automaton holds the ASCII characters at which the class of characters changes (white space) and the
sentinels. Its matches are the events of a text; what lies between two events is one gap. A unit is white space and the
word after it, so every gap that is not empty ends one unit, and the text's end ends the last one: the number of units is
arithmetic over gaps, and the end of the k-th unit is the end of the k-th such gap. No list of units is ever built.

Where a document is cut, and into which form, follows from a digest of the seed and its identifier; these are Spark's own
functions. The scan runs in Arrow batches, map-only; a task holds one batch and 16 bytes for each event of one text.

The sentinels mark the parts: the output can be turned back into the text by splitting it there. That is sure because a
text that has a sentinel stays plain, and because no sentinel's end is the start of another (checked), so none can arise
where a part and a sentinel meet.

Defined results: a null or empty text is plain with 0 units; a null identifier counts as the empty text; rows are independent,
so repeated rows give equal results; an empty table gives an empty one; other columns may be kept by name.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_texts

# White space, and what stands before prefix, suffix and middle.
SPACES = "\x20\t\n\x0b\x0c\r"
SENTINELS = ("<P>", "<S>", "<M>")
#: The seed; per cent of texts that are cut; per cent of those with the suffix first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80


def scanner(sentinels: tuple[str, ...] = SENTINELS) -> ahocorasick.Automaton:
    """The automaton of white space (0) and sentinels (1)."""
    out = ahocorasick.Automaton()
    for c in SPACES:
        out.add_word(c, 0)
    for s in sentinels:
        out.add_word(s, 1)
    out.make_automaton()
    return out


class Scan:
    """The events of one text: whether it has a sentinel, its number of units, and where each ends."""

    def __init__(self, automaton: ahocorasick.Automaton, text: str):
        events = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
        marked = events[:, 1] == 1
        self.marked, self.length = bool(marked.any()), len(text)
        spaces = events[~marked, 0] if self.marked else events[:, 0]
        self.ends = spaces[np.diff(spaces, prepend=-1) > 1]  # a gap that is not empty ends a unit
        self.units = len(self.ends) + (self.length > 0)

    def end(self, units: int) -> int:
        """The place at which so many units end."""
        if units <= 0:
            return 0
        return self.length if units >= self.units else int(self.ends[units - 1])


def rolls(identifier: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the digest of the seed and an identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def checked(sentinels: tuple[str, ...]) -> tuple[str, ...]:
    """The sentinels, if a text without them, cut and joined by them, can hold them only where they were put."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(c in s for s in sentinels for c in SPACES):
        raise ValueError("three different sentinels without white space are needed")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"sentinels overlap: {a!r} and {b!r}")
    return sentinels


FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
]


def fill_in_middle(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns in keep; n (units of the text), form (plain, psm: prefix, suffix, middle; spm: suffix, prefix, middle),
    prefix_chars and middle_chars (code points; null if plain) and output, the text to learn from."""
    before, behind, middle = checked(sentinels)

    def start():
        automaton = scanner(sentinels)

        def one(row):
            said = row["said"] or ""
            scan = Scan(automaton, said)
            if not said or scan.marked or row["h3"] % 100 >= rate:
                return scan.units, "plain", None, None, said
            a, b = sorted((row["h1"] % (scan.units + 1), row["h2"] % (scan.units + 1)))
            i, j = scan.end(a), scan.end(b)
            if row["h4"] % 100 < suffix_first:
                return scan.units, "spm", i, j - i, f"{behind}{said[j:]}{before}{said[:i]}{middle}{said[i:j]}"
            return scan.units, "psm", i, j - i, f"{before}{said[:i]}{behind}{said[j:]}{middle}{said[i:j]}"

        return lambda rows: [one(r) for r in rows]

    # The kept columns by place, so that none can clash with the row that the scan reads.
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.struct(F.col(text).alias("said"), *rolls(F.col(identifier), seed)).alias("row"))
    return map_texts(rows, start, FIELDS, kept, text="row").toDF(*keep, *(f.name for f in FIELDS))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in checked(sentinels)), -1)
    second, third, fourth = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(second, fourth, third)).when(form == "spm", F.concat(third, fourth, second)).otherwise(output)
