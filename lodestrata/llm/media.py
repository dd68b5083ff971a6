"""Interleaved document sequences: text and media in the order of the page.

A page's HTML is parsed into ordered segments: text, or a reference to media by digest with its caption. Payloads lie in
a media store, one row a digest. A join on the digest resolves the references; position and caption stay with each
reference, so that nothing has to be aligned afterwards.

Media are stored losslessly as 8-bit grey PNG images of 64 samples a row. What a resolved reference needs of a payload
(sizes, digests, features) is read back from the stored bytes once a digest, before the join; the bytes themselves join
only where they are asked for. Copies of a payload are merged in each batch and each task first, and Spark splits a
digest that very many pages refer to, as both sides of the join are plain shuffles.

Defined results: a null html or text counts as empty; a reference without a digest of 64 hex digits, or whose payload is
not in the store, keeps its position with null payload columns; repeated rows are resolved each; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ._common import map_texts, materialise, small, work_folder

WIDTH = 64
SCHEME = "media:sha256/"
_signature = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def write_png(samples: bytes) -> bytes:
    """A grey image of WIDTH samples a row; their number is a positive multiple of WIDTH."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _signature + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples of an unfiltered 8-bit grey image, one row a line; checks every chunk's sum."""
    if data[:8] != _signature:
        raise ValueError("not a PNG image")
    at, body, shape = 8, [], None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", part)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey image")
            shape = height, width
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not supported")
    return lines[:, 1:]


def features(samples: np.ndarray) -> str:
    """size, mean, deviation, entropy in bits, and a 64-bit hash of which of 8 x 8 fields are brighter than the mean."""
    share = np.bincount(samples.ravel(), minlength=256) / samples.size
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() + 0.0
    rows = np.add.reduceat(samples.astype(np.int64), np.arange(8) * len(samples) // 8 if len(samples) >= 8 else [0], axis=0)
    fields = rows.reshape(len(rows), 8, WIDTH // 8).sum(axis=2)
    bits = (fields > fields.mean(axis=1, keepdims=True)).ravel()
    return f"{samples.shape[1]}x{samples.shape[0]} mean={samples.mean():.4f} dev={samples.std():.4f} entropy={entropy:.4f} hash={int(''.join(map(str, bits.astype(int))), 2):016x}"


DESCRIPTION = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
                            T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def media_store(docs: DataFrame) -> DataFrame:
    """digest (of the text), n_bytes, media: each text as a stored image; copies within a batch once."""
    ship(docs.sparkSession)
    out = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small(b, 8_000_000):
                texts = {t or "" for t in part.column(0).to_pylist()}
                data = [t.encode("utf-8", "surrogatepass") for t in sorted(texts)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array(map(len, data), pa.int64()), pa.array([write_png(padded(d)) for d in data], pa.binary())], names=out.names)

    return docs.select("text").mapInArrow(run, out)


def described(store: DataFrame) -> DataFrame:
    """The store without media, one row a digest, with what the stored bytes hold when they are read back."""

    def one(media: bytes) -> tuple:
        samples = read_png(media)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)

    rows = map_texts(store, lambda: lambda all_: [one(m) for m in all_], list(DESCRIPTION), ["digest", "n_bytes"], text="media")
    names = ["n_bytes", *DESCRIPTION.names]
    return rows.groupBy("digest").agg(F.max(F.struct(*names)).alias("d")).select("digest", *(f"d.{n}" for n in names))


class _Sequence(HTMLParser):
    """Collects text between block borders, and images; a figure's caption goes to its images."""

    BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure figcaption footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul video audio source".split())
    SILENT = frozenset(("script", "style", "template", "noscript", "title", "head"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.segments: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = "".join(self.words).strip()
        self.words = []
        if text and self.caption is not None:
            self.caption.append(text)
        elif text:
            self.segments.append({"pos": len(self.segments), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in self.SILENT:
            self.silent += tag != "head"
        if tag in self.BLOCKS:
            self._flush()
        if tag in ("img", "video", "audio", "source") and given.get("src"):
            self._flush()
            segment = {"pos": len(self.segments), "kind": "media", "text": None, "ref": given["src"], "caption": given.get("alt") or None}
            self.segments.append(segment)
            if self.figure is not None:
                self.figure.append(segment)
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.caption = []

    def handle_endtag(self, tag):
        if tag in self.SILENT and tag != "head":
            self.silent = max(0, self.silent - 1)
        if tag in self.BLOCKS:
            self._flush()
        if tag == "figcaption" and self.caption is not None:
            for s in self.figure or []:
                s["caption"] = " ".join(self.caption) or s["caption"]
            self.caption = None
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)


SEGMENT = T.StructType([T.StructField("pos", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])


def parse_sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.caption = None
    parser._flush()
    return parser.segments


def interleaved(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), html: str = "html") -> DataFrame:
    """The columns in keep, and segments: the page's text and media references in order."""
    return map_texts(pages, lambda: lambda all_: [(parse_sequence(h),) for h in all_], [T.StructField("segments", T.ArrayType(SEGMENT))], list(keep), text=html)


def references(sequences: DataFrame, key: str) -> DataFrame:
    """key, pos, caption, digest (null if the reference names none) of each media segment."""
    found = sequences.select(key, F.explode(F.filter("segments", lambda s: s["kind"] == "media")).alias("s"))
    return found.select(key, "s.pos", "s.caption", F.nullif(F.regexp_extract("s.ref", "^" + SCHEME + "([0-9a-f]{64})$", 1), F.lit("")).alias("digest"))


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """refs with the columns of a store (one row a digest); null where the store has no such digest."""
    return refs.join(store, "digest", "left")


def figure_pages(docs: DataFrame) -> DataFrame:
    """A page for each document: its text as a paragraph, then the same text as media by reference, with a caption."""

    def escaped(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    text = F.coalesce("text", F.lit(""))
    html = F.concat(F.lit("<article><p>"), escaped(text), F.lit(f'</p><figure><img src="{SCHEME}'), F.sha2(text, 256), F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("</figcaption></figure></article>"))
    return docs.select("doc_id", html.alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """Each document's text as media, through its page: doc_id, what was stored and read back, caption and position."""
    folder = work_folder(docs.sparkSession)
    refs = references(interleaved(figure_pages(docs), ("doc_id",)), "doc_id")
    store = materialise(described(media_store(docs)), f"{folder}/store")
    return resolve(refs, store).select("doc_id", "n_bytes", *DESCRIPTION.names, "pos", "caption")
