"""WARC archives in Zstandard: written with a dictionary, read back record by record.

An archive is ``.warc.zst``: a leading skippable frame (magic 0x184D2A5D) with
the dictionary, itself compressed without one, then one frame to each record.
The reader loads that dictionary, decodes a frame at a time and checks it: the
version line, the headers a record needs, the block's length, the HTTP length
and the payload's digest. It raises ``WarcError`` on what doesn't hold.

Of records with equal payloads of at least ``SMALLEST`` bytes, that with the
least page id is a ``response``; the others are ``revisit`` records that refer
to it and store no payload, but its length and digest.

Only digests are grouped to find equal payloads. Those that occur more than
once are written to a table; the pages' join with it is a broadcast if that
table is under Spark's threshold, and else one whose hot digests are split.

Edge cases: a null payload is an empty one; a page with a null id can be a
revisit but nothing refers to it; rows repeated with the least id are all
responses; a null URL leaves its header out, and control characters in one are
percent-encoded; an empty table writes no archive; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.llm.shared import discard, fresh_dir, materialize, open_fs, publish, spread

MAGIC = 0x184D2A5D
SMALLEST = 100
DATE = "2024-01-01T00:00:00Z"
#: A dictionary, and the bytes and records at the start of an archive that it is trained on.
DICTIONARY = 16 << 10
TRAINED_ON = 1 << 20
TRAINED_RECORDS = 128
LEVEL = 3
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    if not (m := re.fullmatch(r"<urn:page:(null|-?\d+)>", record_id)):
        raise WarcError(f"record id {record_id!r}")
    return None if m[1] == "null" else int(m[1])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    block = http + payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a whole record, checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError(f"no WARC header: {data[:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon:
            raise WarcError(f"header line {line!r}")
        headers[name] = value
    if missing := [n for n in _NEEDED if n not in headers]:
        raise WarcError(f"no {', '.join(missing)}")
    if not headers["Content-Length"].isdigit() or len(rest) != (length := int(headers["Content-Length"])) + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes; Content-Length is {headers['Content-Length']}")
    kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: (\d+)", http)
    if kind not in ("response", "revisit") or not found or not http.startswith(b"HTTP/1.") or not size or not re.fullmatch("sha256:[0-9a-f]{64}", digest):
        raise WarcError(f"{kind} record without an HTTP response or a payload digest")
    revisit = kind == "revisit"
    if revisit and (headers.get("WARC-Profile") != PROFILE or "WARC-Refers-To" not in headers or payload):
        raise WarcError("revisit with a payload, or without a profile or reference")
    if not revisit and (len(payload) != int(size[1]) or hashlib.sha256(payload).hexdigest() != digest[7:]):
        raise WarcError("the payload is not of the length or digest that is given")
    return {"page_id": _page(headers["WARC-Record-ID"]), "payload_bytes": int(size[1]), "payload_digest": digest[7:], "record_type": kind, "refers_to": _page(headers["WARC-Refers-To"]) if revisit else None, "url": headers.get("WARC-Target-URI"), "payload": None if revisit else payload}


def write_archive(out, records: Iterator[bytes]) -> None:
    """A dictionary from the first records, and a frame for each record."""
    first: list[bytes] = []
    size = 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= TRAINED_ON or len(first) >= TRAINED_RECORDS:
            break
    options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
    compressor = zstandard.ZstdCompressor(**options)
    try:
        trained = zstandard.train_dictionary(DICTIONARY, [r[:CHUNK] for r in first], k=256, d=8)
    except zstandard.ZstdError:  # too few records
        trained = None
    if trained is not None:
        packed = compressor.compress(trained.as_bytes())
        out.write(struct.pack("<II", MAGIC, len(packed)) + packed)
        compressor = zstandard.ZstdCompressor(dict_data=trained, **options)
    for r in chain(first, records):
        out.write(compressor.compress(r))


def read_archive(source) -> Iterator[dict]:
    """The records of an open file. Holds a chunk and a record in memory."""
    data = source.read(CHUNK)
    dictionary = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        length = struct.unpack_from("<I", data, 4)[0]
        while len(data) < 8 + length:
            if not (more := source.read(CHUNK)):
                raise WarcError("the dictionary's frame is cut short")
            data += more
        dictionary, data = data[8 : 8 + length], data[8 + length :]
        if dictionary[:4] == b"\x28\xb5\x2f\xfd":
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
        dictionary = zstandard.ZstdCompressionDict(dictionary)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while data := data or source.read(CHUNK):
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from e
            if frame.eof:
                break
            if not (data := source.read(CHUNK)):
                raise WarcError("the last frame is cut short")
        data = frame.unused_data
        yield parse(b"".join(parts))


def write_archives(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> list[str]:
    """Writes a record for each page to archives below ``uri``; returns their URIs (one to a partition)."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= SMALLEST)
    repeated = materialize(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "repeated")
    marked = rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        archive = f"{uri}/pages-{TaskContext.get().partitionId():06d}.warc.zst"

        def records() -> Iterator[bytes]:
            for batch in chain([first], batches):
                for k in range(batch.num_rows):
                    yield record(*(c[k].as_py() for c in batch.columns))

        publish(archive, lambda out: write_archive(out, records()))
        yield pa.record_batch({"uri": [archive]})

    manifest = materialize(marked.mapInArrow(write, "uri string"), "warc-manifest")
    found = sorted(r.uri for r in manifest.collect())
    discard(spark, manifest, repeated)
    return found


def read_archives(spark: SparkSession, uris: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of each record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    rows = []
                    for r in read_archive(f):
                        r.pop("payload")
                        rows.append(r)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    if not uris:
        return spark.createDataFrame([], _READ)
    return spread(spark, [(u,) for u in uris], "uri string").mapInArrow(read, _READ)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, fresh_dir(spark, "warc")))
