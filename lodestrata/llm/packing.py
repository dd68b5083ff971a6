"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A document is its token ids and an end id. Overlong documents are first cut into full windows; what remains is packed,
longest first, each into the open window with the least remaining capacity that still holds it. A segment tree over
the capacities finds that window in log(window) steps.

Windows are formed within each task's stream of documents, GROUP pieces at a time: nothing is shuffled, memory is
bounded, and a lost task is simply repeated (its part of the numbering depends on its partition alone). Each group
leaves a few windows partly filled; with tens of thousands of pieces a group that padding is far below one percent.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from ._common import small
from .byte_bpe import read_ranks

#: Pieces that are packed together at most.
GROUP = 1 << 16


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree: each node knows whether any capacity below it is there."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.there = bytearray(2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        node = capacity + self.size
        while node and not self.there[node]:
            self.there[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest (capacity, window) of at least that capacity, removed; None if there is none."""
        there, node = self.there, least + self.size
        if not there[node]:
            while node > 1 and (node & 1 or not there[node + 1]):  # climb until a right neighbour has something
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if there[2 * node] else 2 * node + 1
        capacity = node - self.size
        window = self.stacks[capacity].pop()
        if not self.stacks[capacity]:
            there[node] = 0
            while node > 1 and not (there[node] | there[node ^ 1]):
                node >>= 1
                there[node] = 0
        return capacity, window


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """The window of each piece, its offset there, and the number of windows. Ties keep their order."""
    where, offset, n, open_ = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_.take(lengths[i])
        if found is None:
            found, n = (window, n), n + 1
        capacity, where[i] = found
        offset[i] = window - capacity
        if capacity > lengths[i]:
            open_.put(capacity - lengths[i], where[i])
    return where, offset, n


class Tokens:
    """Token ids of texts as the tokenizers library gives them for a byte-level BPE file.

    The same vocabulary as ranks, if given, is encoded by tiktoken: the ids are the same and it takes a quarter of the
    time. A text with a special token's string goes to the tokenizers library itself.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.path, self.plain = path, None
        self.fast = None
        if ranks_path:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            if self.plain is None:  # most workers never need its memory
                os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.path)
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text)


_tokens: dict[tuple, Tokens] = {}


def tokens_for(*args) -> Tokens:
    if args not in _tokens:
        _tokens[args] = Tokens(*args)
    return _tokens[args]


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, its ids."""
    ship(docs.sparkSession)
    fields = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    out = T.StructType([docs.schema["doc_id"], *fields, *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, used, rows = tokens_for(tokenizer_path, ranks_path, pattern), TaskContext.get().partitionId() << 33, []

        def flush():
            nonlocal used, rows
            full = [r for r in rows if r[2] == window]
            rest = [r for r in rows if r[2] < window]
            where, offset, n = best_fit([r[2] for r in rest], window)
            columns = [*zip(*full, *rest, strict=True)] if rows else [[] for _ in range(5 + with_ids)]
            sequence = [*range(used, used + len(full)), *(used + len(full) + w for w in where)]
            used, rows = used + len(full) + n, []
            values = [*columns[:5], sequence, [0] * len(full) + offset, *columns[5:]]
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for part in small(batch, 8_000_000):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(tokens.ids(text or ""), end_id).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *([piece] if with_ids else [])))
                    if len(rows) >= GROUP:
                        yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, out)
