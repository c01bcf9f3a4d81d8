"""Web archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with a seek table in a skippable frame
(the public seekable format), so usual tools read it too. The index maps a record identifier to bundle, frame and
offset inside the frame. Bundle names are new for every attempt of a task and the index lists only those of attempts
that were committed, so a lost executor leaves at most a bundle nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.scratch import new_folder, small_batches, stored
from holdfast.scale import lookup

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
# Frames read by one task at most; an archive of few frames is dealt over all cores.
FRAMES_PER_TASK = 1024
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
BASE32, HEX32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

INDEX_SCHEMA = "record_id string, bundle string, frame int, frame_offset long, offset int, length int"
RECORD_SCHEMA = ("record_id string, bundle string, frame int, offset int, page_id long, record_type string, "
                 "refers_to long, payload_digest string, payload_bytes long, payload binary")


@dataclass(frozen=True)
class Archive:
    """A folder of bundles and the committed index of its records."""

    folder: str
    index: DataFrame


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: five hexadecimal digits give four of base 32."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def filesystem(path: str):
    """The file system of a path and the path in it: local files, or any store Arrow knows."""
    from pyarrow import fs

    plain = path.removeprefix("file:")
    if plain.startswith("/"):
        return fs.LocalFileSystem(), "/" + plain.lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def page_urn(page_id: str | None) -> str:
    return f"urn:page:{page_id or ''}"


# ------------------------------------------------------------------ bytes of a bundle

def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record; a revisit keeps the HTTP head, with the length of the payload it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block)))]
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Fields and block of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    start, length = end + 4, int(fields["Content-Length"])
    return fields, data[start:start + length]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: compressed and decompressed size of every frame."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    body += struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of every frame of an open bundle; reads the footer only."""
    file.seek(-9, os.SEEK_END)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    file.seek(-9 - 8 * count, os.SEEK_END)
    sizes, offset, frames = file.read(8 * count), 0, []
    for packed, plain in struct.iter_unpack("<II", sizes):
        frames.append((offset, packed, plain))
        offset += packed
    return frames


class BundleWriter:
    """Fills frames and bundles and writes a bundle when it is full; holds one bundle in memory."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.start_bundle()
        self.frame: list[bytes] = []
        self.filled = 0

    def start_bundle(self) -> None:
        self.name, self.packed, self.sizes, self.entries = f"{uuid.uuid4().hex}.warc.zst", io.BytesIO(), [], []

    def add(self, record_id: str, data: bytes) -> None:
        self.entries.append((record_id, self.name, len(self.sizes), self.packed.tell(), self.filled, len(data)))
        self.frame.append(data)
        self.filled += len(data)
        if self.filled >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.packed.write(packed)
            self.sizes.append((len(packed), self.filled))
            self.frame, self.filled = [], 0

    def full(self) -> bool:
        return self.packed.tell() >= self.bundle_bytes

    def end_bundle(self) -> pd.DataFrame:
        self.end_frame()
        entries = self.entries
        if entries:
            self.packed.write(seek_table(self.sizes))
            system, path = filesystem(f"{self.folder}/{self.name}")
            with system.open_output_stream(path, compression=None) as out:
                out.write(self.packed.getbuffer())
        self.start_bundle()
        return pd.DataFrame(entries, columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])


# ------------------------------------------------------------------ tables

def planned_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` per page.

    Payloads are equal when SHA-256 and length are. Of equal ones of ``min_revisit_bytes`` or more the page with the
    largest id is the response and the others refer to it; repeated rows of that page are all responses, and a page
    without id refers to the others if they have one. NULL html is an empty payload.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    keyed = rows.withColumn("same", F.concat(F.sha2("payload", 256), F.lit(" "), F.length("payload")))
    groups = (keyed.where(F.length("payload") >= min_revisit_bytes).groupBy("same")
              .agg(F.count("*").alias("copies"), F.max("page_id").alias("first_id")).where("copies > 1"))
    found = lookup(keyed, stored(groups, "payloads"), ["same"], ["first_id"], size="copies", row_id="row")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return found.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", base32_sha1(F.col("payload")).alias("digest"), refers.cast("string").alias("refers_to"))


def write_archive(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0,
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> Archive:
    """Write one record per page into seekable bundles below ``folder`` and return the archive with its index.

    A record identifier names the page (``urn:page:12``); repeated rows of a page share it and all of them are found.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archive")
    small_batches(spark)
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = BundleWriter(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            for page, url, payload, digest, refers in zip(
                    batch.page_id, batch.url, batch.payload, batch.digest, batch.refers_to):
                own, target = page_urn(page), page_urn(refers) if refers else None
                writer.add(own, record(own, url, bytes(payload), digest, target))
                if writer.full():
                    yield writer.end_bundle()
        yield writer.end_bundle()

    planned = planned_records(pages, min_revisit_bytes)
    return Archive(folder, stored(planned.mapInPandas(write, INDEX_SCHEMA), "archive-index"))


def _number(urn: str) -> int | None:
    number = urn.removeprefix("urn:page:")
    return int(number) if number else None


def _decoded(bundle: str, frame: int, data: bytes, offsets: Iterable[int], with_payload: bool) -> Iterator[tuple]:
    for at in offsets:
        fields, block = parse_record(data, at)
        head, _, payload = block.partition(b"\r\n\r\n")
        revisit = fields["WARC-Type"] == "revisit"
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{bundle}: damaged record at frame {frame}, offset {at}")
        own, refers = (fields.get(f, "").strip("<>") for f in ("WARC-Record-ID", "WARC-Refers-To"))
        yield (own, bundle, frame, at, _number(own), fields["WARC-Type"], _number(refers), digest, length,
               payload if with_payload and not revisit else None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")], dtype=object)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archive(archive: Archive, with_payload: bool = True) -> DataFrame:
    """Every record of the archive, its payload (NULL for a revisit) checked against its digest."""
    return _read(archive.index, archive.folder, with_payload)


def fetch(archive: Archive, record_ids: DataFrame) -> DataFrame:
    """Only the records with the given ``record_id``: the footer and the frames that hold them are read."""
    return _read(archive.index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi"), archive.folder, True)


def _read(entries: DataFrame, folder: str, with_payload: bool) -> DataFrame:
    """Frames named by index entries, dealt to tasks frame by frame."""
    small_batches(entries.sparkSession)
    own = entries.select("bundle", "frame").distinct().count()
    # Index rows are few bytes and stand for much, so tasks are counted by frames: adaptive execution would make one.
    tasks = max(1, min(own, 2 * entries.sparkSession.sparkContext.defaultParallelism), -(-own // FRAMES_PER_TASK))
    frames = (entries.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame")
              .agg(F.collect_list("offset").alias("offsets")))

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, group in batch.groupby("bundle"):
                system, path = filesystem(f"{folder}/{bundle}")
                with system.open_input_file(path) as file:
                    table = read_seek_table(file)
                    for number, offsets in zip(group.frame, group.offsets):
                        start, packed, plain = table[number]
                        file.seek(start)
                        data = unpack.decompress(file.read(packed), max_output_size=plain)
                        yield _frame(list(_decoded(bundle, int(number), data, offsets, with_payload)))

    return frames.mapInPandas(read, RECORD_SCHEMA)
