"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about
:data:`FRAME_BYTES` plain bytes. A bundle is frames one after another and a footer:
a skippable frame with the compressed and plain size of each frame, as the public
seekable format lays it down. An index maps a record's identifier to its bundle,
frame, and offset and length in the frame's plain text, so a reader decompresses
the one frame it needs and cuts the record out.

Bundles are rows of a table with a binary column of about :data:`BUNDLE_BYTES`,
written by Spark to the shared folder, so any store and any loss of executors is
handled by Spark's committer; :func:`export_bundles` puts them out as files.

Of records with equal payloads of at least 100 bytes the one with the smallest
page_id is a response, the others revisit it. Payloads are grouped by SHA-256
with a partial minimum before the shuffle.

Defined results: a null html is the empty payload; a null page_id is never the
smallest unless all of its group are null, and then all are responses; all rows
that repeat the smallest page_id of a group are responses; rows that repeat a
page_id and a payload share an identifier, under which :func:`fetch` gives each; a
record longer than a frame has a frame of its own.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vellum.llm.rows import end_task, small_batches
from vellum.sources.scratch import Scratch

#: Plain bytes after which a bundle and a frame are closed, payload bytes from which equal records become revisits, Zstandard's level.
BUNDLE_BYTES, FRAME_BYTES, REVISIT_FROM, LEVEL = 4 << 20, 128 << 10, 100, 3
#: Fixed values of the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, payload_digest: str) -> str:
    """A record's identifier; the digest tells apart rows that repeat a page_id."""
    return f"urn:page:{'null' if page_id is None else page_id}:{payload_digest[:16]}"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit without payload that names the record and the payload it stands for."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}"] if url else []
    lines += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of a record; headers end at the first empty line, the body's length is as they say."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, plain) bytes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """(compressed start, compressed bytes, plain start, plain bytes) of each frame, from the bundle's last bytes."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    out, at, plain = [], 0, 0
    for c, d in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, c, plain, d))
        at, plain = at + c, plain + d
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    """A frame's plain bytes, decompressing no other frame."""
    at, size, _, plain = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + size], max_output_size=plain)


RECORDS = "page_id bigint, url string, payload binary, digest string, refers_to bigint"
BUNDLES = "bundle_id string, records int, bundle binary, index array<struct<record_id:string,frame:int,frame_offset:bigint,length:bigint>>"


class _Bundle:
    """A bundle as it fills: frames closed so far, the records of the open one, and the index of all."""

    def __init__(self) -> None:
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.in_open, self.plain = 0, 0
        self.index: list[dict] = []

    def add(self, name: str, record: bytes) -> None:
        if self.open and self.in_open + len(record) > FRAME_BYTES:
            self.close_frame()
        self.index.append({"record_id": name, "frame": len(self.frames), "frame_offset": self.in_open, "length": len(record)})
        self.open.append(record)
        self.in_open += len(record)
        self.plain += len(record)

    def close_frame(self) -> None:
        plain = b"".join(self.open)
        self.frames.append(self.squeeze.compress(plain))
        self.sizes.append((len(self.frames[-1]), len(plain)))
        self.open, self.in_open = [], 0

    def row(self) -> pa.RecordBatch:
        self.close_frame()
        data = b"".join(self.frames) + seek_table(self.sizes)
        name = hashlib.sha256("\n".join(x["record_id"] for x in self.index).encode()).hexdigest()[:24]
        values = (name, len(self.index), data, self.index)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BUNDLES)], schema=_BUNDLES)


_BUNDLES = pa.schema([
    ("bundle_id", pa.string()), ("records", pa.int32()), ("bundle", pa.binary()),
    ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("length", pa.int64())]))),
])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle = _Bundle()
    for batch in batches:
        for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
            bundle.add(record_id(page_id, digest), warc_record(page_id, url, payload, digest, refers_to))
            if bundle.plain >= BUNDLE_BYTES:
                yield bundle.row()
                bundle = _Bundle()
    if bundle.index:
        yield bundle.row()
    end_task()


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) for each row."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    equal = rows.where(F.octet_length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    groups = scratch.write(equal.where("rows > 1").select(F.col("digest").alias("_digest"), "first"), "groups")
    joined = rows.join(groups, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_bundles(pages: DataFrame, scratch: Scratch, **columns: str) -> DataFrame:
    """Write each row's record and return the table of bundles with their indexes."""
    small_batches(pages.sparkSession)
    return scratch.write(plan_records(pages, scratch, **columns).mapInArrow(_pack, BUNDLES), "bundles", keep=True)


def record_index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle_id, frame, frame_offset, length)."""
    return bundles.select("bundle_id", F.explode("index").alias("i")).select("i.record_id", "bundle_id", "i.frame", "i.frame_offset", "i.length")


def read_records(bundles: DataFrame) -> DataFrame:
    """Every record, read back through the bundles' seek tables: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    A response's length and digest come from its payload; a digest that differs
    from the record's header raises. A revisit has no payload and gives those of
    the payload that its headers name.
    """
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, index in zip(batch.column(0), batch.column(1)):
                rows = []
                for record in _cut(bundle.as_py(), index.as_py()):
                    headers, body = parse_record(record)
                    named, revisit = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha256(body).hexdigest() != named:
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                    page, to = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
                    rows.append((None if page is None else int(page), headers.get("WARC-Target-URI"), headers["WARC-Type"], None if revisit else body, int(headers["X-Payload-Length"]) if revisit else len(body), named, None if to is None else int(to)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
        end_task()

    small_batches(bundles.sparkSession)
    return bundles.select("bundle", "index").mapInArrow(unpack, "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint")


def _cut(bundle: bytes, index: list[dict]) -> Iterator[bytes]:
    """The records that ``index`` names, each found by its frame, offset and length; a frame is decompressed once. Raises where another record lies there."""
    frame, plain = -1, b""
    for at in sorted(index, key=lambda x: (x["frame"], x["frame_offset"])):
        if at["frame"] != frame:
            frame = at["frame"]
            plain = read_frame(bundle, frame)
        record = plain[at["frame_offset"] : at["frame_offset"] + at["length"]]
        if f"<{at['record_id']}>" not in record.partition(b"\r\n\r\n")[0].decode():
            raise ValueError(f"{at['record_id']} is not where the index says")
        yield record


def fetch(bundles: DataFrame, record_ids: DataFrame) -> DataFrame:
    """(record_id, record) for the ``record_ids`` asked for: the index finds bundle, frame, offset and length, and only frames that hold one are decompressed."""
    place = F.struct("record_id", "frame", "frame_offset", "length")
    hits = record_index(bundles).join(record_ids.select("record_id").distinct(), "record_id", "left_semi").groupBy("bundle_id").agg(F.collect_list(place).alias("hits"))

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, wanted in zip(batch.column(0), batch.column(1)):
                found = list(_cut(bundle.as_py(), wanted.as_py()))
                names = [x["record_id"] for x in sorted(wanted.as_py(), key=lambda x: (x["frame"], x["frame_offset"]))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary())], names=["record_id", "record"])
        end_task()

    small_batches(bundles.sparkSession)
    return bundles.select("bundle_id", "bundle").join(hits, "bundle_id").select("bundle", "hits").mapInArrow(pull, "record_id string, record binary")


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Put the bundles out as ``<bundle_id>.warc.zst`` in a folder that all executors mount; returns (path, bytes)."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            done = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f.name, path)
                done.append((path, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["path", "bytes"])

    return bundles.select("bundle_id", "bundle").mapInArrow(save, "path string, bytes bigint")


def warc_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write and read back: page_id, payload_bytes, payload_digest, record_type, refers_to for each row."""
    with Scratch(pages.sparkSession, "warc") as scratch:
        bundles = write_bundles(pages, scratch, **columns)
    return read_records(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
