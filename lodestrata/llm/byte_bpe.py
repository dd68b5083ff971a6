"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece's bytes exactly one token can end its encoding. It is the token whose pairing with the last
token of the prefix before it is stable: merging the bytes of both again gives the same two tokens. So a table with one
token per prefix encodes a piece from left to right; bytes can be appended exactly, and after an edit only the part
from the edit on is computed again, up to where the table meets its old self.

Encoding is map-only. The vocabulary is broadcast by its file's path, which every executor must have; it is bounded by
its own size. Pieces that were encoded are remembered, MEMO at most in a worker.

Defined results: a null text counts as empty and has no tokens; rows are independent; an empty table gives an empty
one; other columns may be kept by name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import map_texts

MEMO = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixEncoder:
    """Encodes one piece at a time by its table of last tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.token_at, self.back = self._reversed()
        self.stable: dict[tuple[int, int], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}

    def _reversed(self) -> tuple[list[int], dict[int, int]]:
        """A trie of the tokens read backwards: the token (or -1) of each node, and from node * 256 + byte the next node."""
        token_at, back = [-1], {}
        for token, i in self.ranks.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                node = back.get(key, 0)
                if not node:
                    node = back[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = i
        return token_at, back

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """The plain merge loop down to so many parts, for the few bytes of a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts that stand at one edge of a token while it is merged, the smallest first, each with the rank of the
        merge that takes it up; none takes up the whole token."""
        key = (token, right)
        known = self.spines.get(key)
        if known is None:
            data, taken, known = self.bytes_of[token], 1 << 60, []
            while True:
                known.append((data, taken))
                if len(data) == 1:
                    break
                taken, data = self.ranks[data], self.split(data)[right]
            known = self.spines[key] = known[::-1]
        return known

    def split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes a token."""
        left, right = self.merge(token, 2)
        return left, right

    def fits(self, left: int, right: int) -> bool:
        """Whether these two tokens stay as they are when their bytes are merged together: no merge across the border
        may come before those that take up the parts on either side of it."""
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) >= 4 * MEMO:
                self.stable.clear()
            a, b, i, j, known = self.spine(left, True), self.spine(right, False), 0, 0, True
            while True:
                (x, x_taken), (y, y_taken) = a[i], b[j]
                across = self.ranks.get(x + y)
                if across is not None and across < x_taken and across <= y_taken:
                    known = False
                    break
                if x_taken <= y_taken:
                    i += 1
                else:
                    j += 1
                if i == len(a) or j == len(b):
                    break
            self.stable[left, right] = known
        return known

    def alone(self, token: bytes) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(token) == [token]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """last holds the last token of each prefix of data up to some length; gets those of the longer prefixes."""
        step, token_at, stable = self.back.get, self.token_at, self.stable
        for end in range(len(last) + 1, len(data) + 1):
            ids, start, node = [], end, 0
            while start:
                start -= 1
                node = step(node << 8 | data[start])
                if node is None:
                    break
                if token_at[node] >= 0:
                    ids.append((start, token_at[node]))
            while ids:  # a longer token is more often the right one
                start, token = ids.pop()
                if start:
                    before = last[start - 1]
                    ok = stable.get((before, token))
                    if ok or ok is None and self.fits(before, token):
                        last.append(token)
                        break
                elif self.alone(data[:end]):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token of the vocabulary can end {data[:end]!r}")
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self.tokens(self.extend(data, []))

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """data and its table with data[start:stop] replaced by new. Behind the edit the old table is taken up again once
        it has agreed for as many prefixes as the longest token has bytes."""
        out, table = data[:start] + new + data[stop:], last[:start]
        shift, agreed, most = len(new) - (stop - start), 0, max(map(len, self.ranks))
        while len(table) < len(out):
            self.extend(out[: len(table) + 1], table)
            old = len(table) - 1 - shift
            inside = old >= stop and len(self.bytes_of[table[-1]]) <= len(table) - start - len(new)
            agreed = agreed + 1 if inside and last[old] == table[-1] else 0
            if agreed >= most:
                return out, table + last[old + 1 :]
        return out, table


class TextEncoder:
    """Encodes texts: each match of the pattern separately. Pieces are remembered, the first MEMO that come; others for
    one batch. New pieces are encoded in order, so that each takes over the table of the prefix it shares with the last."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder, self.pattern = PrefixEncoder(ranks), regex.compile(pattern)
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def _learn(self, pieces: set[str]) -> None:
        encoder, bytes_of = self.encoder, self.encoder.bytes_of
        before, table = b"", []
        for data, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces):
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            before, table = data, encoder.extend(data, table[:same])
            ids = encoder.tokens(table)
            self.known[piece] = len(ids), ",".join(map(str, ids)), b"".join(map(bytes_of.__getitem__, ids))

    def batch(self, texts: list[str]):
        """For each text its pieces: number of tokens, their ids as text, and the bytes that these decode to."""
        pieces = [self.pattern.findall(t) for t in texts]
        new = set().union(*pieces).difference(self.known)
        self._learn(new)
        get = self.known.__getitem__
        for x in pieces:
            yield list(map(get, x))
        if len(self.known) > MEMO:
            for p in new:
                del self.known[p]

    def encode(self, text: str) -> list[int]:
        (pieces,) = self.batch([text])
        return ids_of(pieces)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.encoder.bytes_of.__getitem__, ids))


def ids_of(pieces: list[tuple[int, str, bytes]]) -> list[int]:
    return [int(i) for _, ids, _ in pieces for i in ids.split(",")]


_encoders: dict[tuple[str, str], TextEncoder] = {}


def encoder_for(path: str, pattern: str) -> TextEncoder:
    """One encoder a worker process and vocabulary; a worker serves many tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def _mapped(docs: DataFrame, path: str, pattern: str, fields: list[T.StructField], make: Callable[[list], tuple], keep: tuple[str, ...]) -> DataFrame:
    def start():
        encoder = encoder_for(path, pattern)
        return lambda texts: [make(pieces) for pieces in encoder.batch([t or "" for t in texts])]

    return map_texts(docs, start, fields, list(keep), most=4_000_000)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and ids: the token ids of the whole text."""
    return _mapped(docs, path, pattern, [T.StructField("ids", T.ArrayType(T.IntegerType()))], lambda pieces: (ids_of(pieces),), keep)


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and data: the bytes that ids stand for (null ids: no bytes)."""

    def start():
        encoder = encoder_for(path, pattern)
        return lambda rows: [(encoder.decode(ids or []),) for ids in rows]

    return map_texts(encoded, start, [T.StructField("data", T.BinaryType())], list(keep), text="ids")


def digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep; n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that
    the ids decode to). The ids themselves stay in the worker: one pass, nothing but digests moves."""

    def make(found):
        ids = ",".join([x[1] for x in found])
        decoded = b"".join([x[2] for x in found])
        return sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, path, pattern, fields, make, keep)
