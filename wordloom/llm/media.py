"""Interleaved documents: ordered text and media references from HTML, payloads resolved by digest.

An HTML document becomes a sequence of structs: a position, and a text or a reference with its caption. References name
payloads by digest; a join by digest brings the stored payload's features back to each reference, so positions and
captions stay with what they belong to. A payload is stored as an 8-bit grey PNG image.

What is joined by digest has one row for each payload, never one per copy, and payloads themselves stay where they are:
only what was read from them travels. References are dealt out by digest and a salt; each such share asks for its payload
once, so that a hot payload is sent to a bounded number of tasks and fills none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import cut, map_batches, table, texts

#: Samples in a row of an image; a payload is filled up with FILL to a positive multiple of it.
WIDTH, FILL, LEVEL = 576, 255, 1
#: Shares that the references to one payload are dealt into.
SALTS = 64
_SIGN = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position:int,kind:string,text:string,ref:string>"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """Samples as a grey 8-bit image of this width, without loss; the payload is a positive multiple of it."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> np.ndarray:
    """The samples of a stored image, rows by columns; checksums are verified."""
    if stored[:8] != _SIGN:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], (0, 0)
    while at < len(stored):
        (length,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", stored, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError("checksum")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])[::-1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:]


def payload_of(text: str, unit: int = WIDTH) -> bytes:
    data = text.encode()
    return data + bytes([FILL]) * (-len(data) % unit or (unit if not data else 0))


class _Parser(HTMLParser):
    _BREAKS = frozenset({"p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "figure", "ul", "ol", "table"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, str, str | None]] = []
        self.words: list[str] = []
        self.quiet, self.caption, self.figure = 0, False, None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if self.caption and self.figure is not None:
            if text:
                self.items[self.figure] = ("media", text, self.items[self.figure][2])
        elif text:
            self.items.append(("text", text, None))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.quiet += 1
        elif tag in ("img", "video", "audio", "source"):
            self.flush()
            named = dict(attrs)
            if named.get("src"):
                self.items.append(("media", named.get("alt") or "", named["src"]))
                self.figure = len(self.items) - 1
        elif tag == "figcaption":
            self.flush()
            self.caption = True
        elif tag in self._BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)
        elif tag == "figcaption":
            self.flush()
            self.caption = False
        elif tag in self._BREAKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            self.words.append(data)


def interleaved(html: str) -> list[tuple[int, str, str, str | None]]:
    """position, kind (text or media), text or caption, reference; in document order."""
    parser = _Parser()
    parser.feed(html)
    parser.close()
    parser.flush()
    return [(i, *x) for i, x in enumerate(parser.items)]


def sequences(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id and items (an array of structs in order): one for each row. A null or empty page has no items; pages of any length are parsed whole."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string())]))
            items = [[dict(zip(("position", "kind", "text", "ref"), x, strict=True)) for x in interleaved(t)] for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(items, kind)], ["doc_id", "items"])

        return run

    return map_batches(texts(pages, page_id, html), make, f"doc_id long, items array<{ITEM}>", "text")


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's payload: doc_id, digest (of the unpadded bytes), n_bytes and media (the stored image)."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.column("text").to_pylist()
            raw = [t.encode() for t in own]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([hashlib.sha256(b).hexdigest() for b in raw]), pa.array([len(b) for b in raw], pa.int64()), pa.array([encode_png(payload_of(t)) for t in own], pa.binary())], ["doc_id", "digest", "n_bytes", "media"]
            )

        return run

    return map_batches(texts(docs, doc_id, text), make, "doc_id long, digest string, n_bytes long, media binary", "text")


def features(stored: DataFrame) -> DataFrame:
    """digest, n_bytes and what the stored bytes say once they are read back."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for media in batch.column("media").to_pylist():
                samples = decode_png(media)
                payload = samples.tobytes()
                counts = np.bincount(samples.ravel(), minlength=256)
                share = counts[counts > 0] / samples.size
                feature = f"png {samples.shape[1]}x{samples.shape[0]} mean={samples.mean():.4f} max={samples.max()} entropy={-(share * np.log2(share)).sum():.4f}"
                made.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*made, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

        return run

    return map_batches(stored.select("digest", "n_bytes", "media"), make, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "media")


def resolve(parsed: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per media item of parsed documents (doc_id, items), with its caption and its payload's features (null if no payload has the digest).

    docs: the texts that the payloads are made of (null: empty), with or without an id. Each is stored and read back where
    its row lies, so no payload is shuffled; of equal ones the features go on once, map-side first. Rows of parsed without
    items give none, and so do empty tables; items that are repeated are resolved each. A payload of any length is one image.
    """
    known = features(store(docs, doc_id, text)).dropDuplicates(["digest"])
    items = parsed.select("doc_id", F.explode("items").alias("item")).filter("item.kind = 'media'")
    items = items.select("doc_id", "item.position", F.col("item.text").alias("caption"), F.substring_index("item.ref", ":", -1).alias("digest"))
    items = cut(items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "position"), F.lit(SALTS))))  # pages are parsed once
    answers = items.select("digest", "salt").distinct().join(known, "digest")
    return items.join(answers, ["digest", "salt"], "left").drop("salt")


def rejoin(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Whole sequences again: doc_id and items in order, each with its payload's digest, size and feature (null for texts and unknown references).

    Both by the same documents, one row for each doc_id. A document without items stays, with none.
    """
    fields = ("digest", "payload_sha256", "media_bytes", "feature")
    known = resolved.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("position", F.struct(*fields)))).alias("media"))
    item = lambda x: F.struct(x["position"].alias("position"), x["kind"].alias("kind"), x["text"].alias("text"), *[F.try_element_at("media", x["position"])[f].alias(f) for f in fields])
    return parsed.join(known, "doc_id", "left").select("doc_id", F.transform("items", item).alias("items"))


def op4_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, reached through a page that refers to it by digest."""
    docs = texts(table(spark, sf_dir, "documents"))
    page = F.concat(F.lit('<article><h1>Document '), F.col("doc_id").cast("string"), F.lit('</h1><figure><img src="sha256:'), F.sha2("text", 256), F.lit('"><figcaption>text of '), F.col("doc_id").cast("string"), F.lit("</figcaption></figure></article>"))
    found = resolve(sequences(docs.select("doc_id", page.alias("html")), "doc_id"), docs)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


QUERIES = {"op4_interleaved_media": op4_interleaved_media}
