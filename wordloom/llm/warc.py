"""WARC archives: written with one gzip member per record, and read one record after the other.

The reader takes an archive in pieces, inflates one member at a time, frames each record by its content length and
verifies its digests; it holds one record. The writer gives equal payloads one response record and revisits for the rest.

Archives lie in a folder that all workers see. A writer fills a file under a name of its own and renames it when it is
done, so that a task that runs again leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import checkpoint_dir, cut, partitions, table

#: Bytes of records for one archive, before the next one is begun; bytes read at a time.
ARCHIVE, PIECE = 64_000_000, 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    pass


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str, record_id: str, payload: bytes, date: str, refers_to: str | None = None, level: int = 6) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head alone and names the record that has the payload."""
    block = _HEAD + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    if kind == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Payload-Length", str(len(payload))), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    unpacker, parts = None, []
    for piece in pieces:
        while piece:
            unpacker = unpacker or zlib.decompressobj(31)
            try:
                parts.append(unpacker.decompress(piece))
            except zlib.error as error:
                raise WarcError(f"not a gzip member: {error}") from error
            piece = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = None, []
    if unpacker:
        raise WarcError("the archive ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields (names in lower case) and its payload, framed by its length and verified by its digests."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC head")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise WarcError("the content length does not frame the record")
    if fields.get("warc-block-digest", "") != f"sha1:{sha1_base32(block)}":
        raise WarcError("block digest")
    _, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{sha1_base32(payload)}":
        raise WarcError("payload digest")
    return fields, payload


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive: int = ARCHIVE, date: str | None = None) -> DataFrame:
    """Write a record for each row (a null html is empty, a null url urn:page:<id>) and return the archives' path and number of records.

    Of records with equal payloads of at least `least` bytes that with the largest page_id is the response, the others
    revisit it. Roles go by page_id and payload, so rows that share an id but not a payload have roles of their own; a
    repeated row is written again each time, in its one role. A null page_id counts as the smallest. An empty table makes
    no archives; a payload of any length is one record. The largest page of a payload is found from digests alone; the
    pages themselves are dealt out by page_id and digest, so no payload is hot.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"digest": F.unhex(F.sha2("html", 256)), "key": F.coalesce("page_id", F.lit(-(1 << 63)))})
    keyed = own.filter(F.octet_length("html") >= least).select("key", "digest").groupBy("key", "digest").agg(F.count("*").alias("n"))
    leader = keyed.groupBy("digest").agg(F.max("key").alias("response"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    roles = keyed.drop("n").join(leader, "digest")
    dealt = own.join(roles.hint("shuffle_hash"), ["key", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        number, part, sink, paths, counts = TaskContext.get().partitionId(), 0, None, [], []

        def close() -> None:
            sink.close()
            store.move(temporary, final)
            paths.append(final)

        for batch in batches:
            for page, uri, text, response in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "response")], strict=True):
                if sink is None:
                    final = f"{at}/pages-{number:06d}-{part:06d}.warc.gz"
                    temporary = f"{final}.{uuid.uuid4().hex}"
                    sink, size = store.open_output_stream(temporary, compression=None), 0
                    counts.append(0)
                revisit = response is not None and response != page
                data = record("revisit" if revisit else "response", uri or f"urn:page:{page}", f"urn:page:{page}", text.encode(), date, f"urn:page:{response}" if revisit else None)
                sink.write(data)
                counts[-1] += 1
                size += len(data)
                if size >= archive:
                    close()
                    sink, part = None, part + 1
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return cut(dealt.select("page_id", "url", "html", "response").mapInArrow(run, "path string, records long"))


def read(archives: DataFrame, folder: str, piece: int = PIECE, keep_payload: bool = True) -> DataFrame:
    """The records of archives (a column `path`, as write() gives it): fields, and payload (null for a revisit or without keep_payload).

    An archive is read by one task, in pieces; a bad frame or digest stops the read with the archive's name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        names = ["record_id", "target_uri", "record_type", "payload_digest", "payload_length", "refers_to", "payload"]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    try:
                        for member in members(iter(lambda: source.read(piece), b"")):
                            fields, payload = parse(member)
                            kind = fields["warc-type"]
                            rows.append((fields["warc-record-id"][1:-1], fields["warc-target-uri"], kind, fields["warc-payload-digest"].removeprefix("sha1:"), len(payload) if kind == "response" else int(fields["warc-payload-length"]), fields.get("warc-refers-to", "<>")[1:-1] or None, payload if keep_payload and kind == "response" else None))
                            size += len(payload)
                            if size > 4_000_000 or len(rows) >= 5_000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                                rows, size = [], 0
                    except WarcError as error:
                        raise WarcError(f"{path}: {error}") from error
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = archives.select("path").repartition(partitions(archives.sparkSession))
    return spread.mapInArrow(run, "record_id string, target_uri string, record_type string, payload_digest string, payload_length long, refers_to string, payload binary")


def op5_sequential_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as the archives have it."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    found = read(write(table(spark, sf_dir, "pages"), folder), folder, keep_payload=False)
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return found.select(number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


QUERIES = {"op5_sequential_warc": op5_sequential_warc}
