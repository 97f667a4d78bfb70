"""WARC records in seekable Zstandard bundles.

Each task groups its records into independent Zstandard frames of about a megabyte and writes
them to bundle files. A bundle ends with a seek table in a skippable frame (the sizes of every
frame and a footer), so a reader finds any frame from the end of the file, and ordinary
decompressors read the whole file as one WARC stream. The index maps a record id to its bundle,
its frame and the offset and length inside the frame. Bundles are named by the task attempt;
only those that the index names count, so a lost or repeated task leaves nothing behind that
a reader would see.

Of records with equal payloads of at least `least` bytes the one with the largest id is the
response and the others revisit it. A missing payload is empty. Missing ids are smaller than all
others. Rows that repeat an id and payload are each a response or each a revisit. A record id
names the page, the payload's digest and the record's place, so that it is unique; a revisit
refers to the first two of its response. An empty table gives an empty index. Extra columns are
ignored.

Bundles are written and read by Arrow's file systems; the schemes that Spark's folders have for
the same stores are translated.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossblock.operators.lookup import sized_lookup
from crossblock.session import cut

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
#: Bytes of records that one task reads, about.
TASK_BYTES = 16 << 20
# Schemes of Hadoop and what Arrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "gs": "gs"}
INDEX = "record_id string, bundle string, frame int, offset long, length long"
RECORD = (
    "record_id string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def arrow_uri(folder: str) -> str:
    """The folder's address as Arrow's file systems spell it."""
    scheme, found, rest = folder.partition("://")
    if not found or scheme not in SCHEMES:
        return folder
    if scheme.startswith("wasb"):
        rest = rest.replace(".blob.", ".dfs.", 1)
    return f"{SCHEMES[scheme]}://{rest}"


def plan_records(pages: DataFrame, *, key: str, url: str, payload: str, least: int = 0) -> DataFrame:
    """Columns key, url, payload (binary), sha1, keeper (id of the response), kind."""
    rows = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    groups = cut(
        rows.groupBy("sha1").agg(F.max("key").alias("keeper"), F.count("*").alias("rows"))
    )
    found = sized_lookup(rows, groups, ["sha1"], "rows")
    again = (F.length("payload") >= least) & ~F.col("key").eqNullSafe(F.col("keeper"))
    return found.select(
        "key", "url", "payload", "sha1", "keeper",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
    )


def record_bytes(record_id: str, kind: str, url: str | None, page: int | None, keeper: int | None,
                 sha1: str, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit has no block but names the length of its payload."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page is None else page}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{keeper}:{digest}>",
        ]
    else:
        head.append("Content-Type: text/html")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Writes one bundle: frames, then the seek table."""

    def __init__(self, folder: str, frame_bytes: int):
        import zstandard

        self.store, root = fs.FileSystem.from_uri(arrow_uri(folder))
        self.store.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.frame_bytes, self.size = frame_bytes, 0
        self.frames: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset and length of the record."""
        if self.held and self.held + len(record) > self.frame_bytes:
            self.flush()
        at = (len(self.frames), self.held, len(record))
        self.open.append(record)
        self.held += len(record)
        return at

    def flush(self) -> None:
        if self.open:
            packed = self.press.compress(b"".join(self.open))
            self.out.write(packed)
            self.size += len(packed)
            self.frames.append((len(packed), self.held))
            self.open, self.held = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def seek_table(store: fs.FileSystem, path: str) -> list[tuple[int, int, int]]:
    """(offset in the file, compressed size, size) of every frame, read from the end."""
    size = store.get_file_info(path).size
    with store.open_input_file(path) as f:
        f.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        f.seek(size - 9 - 8 * count)
        sizes = struct.iter_unpack("<II", f.read(8 * count))
        frames, at = [], 0
        for packed, whole in sizes:
            frames.append((at, packed, whole))
            at += packed
    return frames


def read_frame(store: fs.FileSystem, path: str, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    at, packed, whole = frame
    with store.open_input_file(path) as f:
        f.seek(at)
        return zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=whole)


def parse(record: bytes) -> dict:
    """A record's columns, its payload's size and digest taken from the bytes where it has them."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
        if digest != told or len(block) != int(fields["X-Payload-Length"]):
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    page = fields.get("X-Page-ID", "")
    refers = fields.get("WARC-Refers-To", "").strip("<>").removeprefix("urn:page:").partition(":")[0]
    return {
        "record_id": fields["WARC-Record-ID"].strip("<>"),
        "page_id": int(page) if page else None,
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": int(refers) if refers else None,
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": told,
        "payload": block if kind == "response" else None,
    }


def write(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html",
          least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row into bundles below `folder`; returns the index, a written table."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle: Bundle | None = None
        rows: list[tuple] = []

        def done() -> pd.DataFrame:
            bundle.close()
            return pd.DataFrame(rows, columns=["record_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page, uri, kind, keeper, sha1, data in zip(
                batch["key"], batch["url"], batch["kind"], batch["keeper"], batch["sha1"], batch["payload"],
                strict=True,
            ):
                if bundle is None:
                    bundle = Bundle(folder, frame_bytes)
                page = None if pd.isna(page) else int(page)
                keeper = None if pd.isna(keeper) else int(keeper)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                place = f"{bundle.name.partition('.')[0]}-{len(rows)}"
                name = f"urn:page:{'none' if page is None else page}:{digest}:{place}"
                at = bundle.add(record_bytes(name, kind, uri, page, keeper, sha1, data))
                rows.append((name, bundle.name, *at))
                if bundle.size >= bundle_bytes:
                    yield done()
                    bundle, rows = None, []
        if bundle is not None:
            yield done()

    planned = plan_records(pages, key=key, url=url, payload=payload, least=least)
    return cut(planned.mapInPandas(pack, INDEX))


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names, read back by frame through the seek tables.

    Pass the rows of some record ids only to read just the frames that hold them.
    """
    # An index row is a few bytes and stands for its record: tasks follow the records' bytes.
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = index.repartition(max(1, -(-total // TASK_BYTES)), "bundle", "frame")
    frames = dealt.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("at"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(arrow_uri(folder))
        tables: dict[str, list] = {}
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for name, frame, at in zip(batch["bundle"], batch["frame"], batch["at"], strict=True):
                path = f"{root}/{name}"
                if name not in tables:
                    tables = {name: seek_table(store, path)}
                data = read_frame(store, path, tables[name][frame])
                found = [parse(data[x["offset"] : x["offset"] + x["length"]]) for x in at]
                out = pd.DataFrame(found, columns=columns)
                for c in ("page_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out

    return frames.sortWithinPartitions("bundle", "frame").mapInPandas(fetch, RECORD)
