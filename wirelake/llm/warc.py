"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, a record each, into the shared folder. Index: captures are sorted by reversed-host key over range partitions; a
partition's lines are packed into compressed blocks of a file, followed by that file's block directory (first key, offset and length of each block), and the list of
these files with their first keys, one entry for each range partition, is the upper level. Looking up: binary search in the list of files, then in the
file's directory, then in the block, with one range read each; then a range read of the record.

Files are named by attempt. Only those named in a committed table count, so a task that runs again after its executor is lost leaves at most an unused file.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, skew_join
from .url_filter import LOWER, UPPER

#: Equal payloads shorter than this are each stored.
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class WarcParams:
    block_lines: int = 3000
    level: int = 1
    captures_per_part: int = 200_000
    parts: int = 24


def surt(url: Column) -> Column:
    """Sort key of a url: host labels from last to first, ``)``, then path and query; scheme, port, user and fragment do not count. Empty for null."""
    rest = F.regexp_extract(url, r"^(?:[^:/?#]*://)?([^#]*)", 1)
    host = F.translate(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@|:\d*$", ""), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path)), F.lit(""))


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with an HTTP response in it (a revisit has its headers alone)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{'' if page_id is None else page_id}:{uuid.uuid4()}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + json.dumps(url)[1:-1])
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{refers_to}>"]
        body = http
    else:
        body = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "backslashreplace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """Headers of a record, with ``payload``; for responses the digest and length are those of the payload read, and must agree with the headers."""
    raw = zlib.decompress(data, 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    out: dict = dict(x.split(": ", 1) for x in lines[1:])
    body = body[: int(out["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    if out["WARC-Type"] == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if out["WARC-Payload-Digest"] != f"sha256:{digest}" or int(out["X-Payload-Length"]) != len(payload):
            raise ValueError("payload differs from its digest")
    out["payload"] = payload
    return out


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def mark(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, payload, digest and ``first``: the smallest page_id of equal payloads of 100 bytes or more that several rows have, else null."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest")
    groups = scratch.table(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    # A group of more than 1/2000 of all rows meets a broadcast copy; of such groups there are 2000 at the most.
    least = max(64, (groups.agg(F.sum("n")).first()[0] or 0) // 2000)
    hot = groups.where(F.col("n") >= least).select("digest")
    return skew_join(rows, groups.select("digest", "first"), "digest", "left", hot)


def write(pages: DataFrame, scratch: Scratch, p: WarcParams = WarcParams()) -> DataFrame:
    """Writes the archives; the captures as (surt, page_id, file, offset, length), a committed table."""
    marked = mark(pages, scratch).withColumn("surt", surt(F.col("url")))
    folder = f"{scratch.root}/archives"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        store.create_dir(path)
        name = f"{uuid.uuid4().hex}.warc.gz"
        at = 0
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            info = b"software: wirelake\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            data = gzip_member(head.encode() + info + b"\r\n\r\n", p.level)
            out.write(data)
            at += len(data)
            for b in batches:
                offsets, lengths = [], []
                for page_id, url, payload, digest, first in zip(b["page_id"].astype("Int64"), b["url"], b["payload"], b["digest"], b["first"].astype("Int64")):
                    page_id, first = (None if x is pd.NA else int(x) for x in (page_id, first))
                    revisit = first is not None and page_id != first
                    data = gzip_member(record("revisit" if revisit else "response", page_id, url, bytes(payload), digest, first), p.level)
                    out.write(data)
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                yield pd.DataFrame({"surt": b["surt"], "page_id": b["page_id"].astype("Int64"), "file": name, "offset": offsets, "length": lengths})

    return scratch.table(marked.mapInPandas(run, "surt string, page_id long, file string, offset long, length long"), "captures")


@dataclass(frozen=True)
class CaptureIndex:
    """The upper level: index files in the order of their first keys."""

    root: str
    firsts: list[tuple[str, int]]
    files: list[str]


#: Captures without page_id sort before all others.
NO_ID = -(2**63)


def build_index(captures: DataFrame, scratch: Scratch, p: WarcParams = WarcParams()) -> CaptureIndex:
    folder = f"{scratch.root}/index"
    parts = max(p.parts, captures.count() // p.captures_per_part + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        store.create_dir(path)
        name = f"{uuid.uuid4().hex}.idx"
        held: list[str] = []
        directory: list[tuple[str, int, int, int]] = []
        first: tuple[str, int] | None = None
        at = 0

        def flush() -> None:
            nonlocal at, held
            data = zlib.compress("\n".join(held).encode(), 6)
            out.write(data)
            directory.append((*begin, at, len(data)))
            at += len(data)
            held = []

        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            begin = ("", 0)
            for b in batches:
                for key, page_id, file, offset, length in b.itertuples(index=False):
                    here = (key, page_id)
                    first = first or here
                    begin = begin if held else here
                    held.append(json.dumps([key, page_id, file, offset, length]))
                    if len(held) == p.block_lines:
                        flush()
            if held:
                flush()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.write(struct.pack("<QQ", at, len(data)))
        if first:
            yield pd.DataFrame({"surt": [first[0]], "page_id": [first[1]], "file": [name]})

    lines = captures.withColumn("page_id", F.coalesce("page_id", F.lit(NO_ID))).repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    table = scratch.table(lines.select("surt", "page_id", "file", "offset", "length").mapInPandas(run, "surt string, page_id long, file string"), "index_files")
    # Binary order, as Spark sorts strings; one row for each range partition, which bounds what comes here.
    rows = sorted(((r["surt"].encode(), r["page_id"]), r["file"]) for r in table.collect())
    return CaptureIndex(scratch.root, [k for k, _ in rows], [f for _, f in rows])


class IndexReader:
    """Looks keys up; keeps the last directory and block, which sorted lookups use again."""

    def __init__(self, index: CaptureIndex):
        self.index = index
        self.store, self.path = _store(index.root)
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(4)(self._block)

    def _read(self, name: str, at: int, size: int) -> bytes:
        with self.store.open_input_file(f"{self.path}/{name}") as f:
            return f.read_at(size, at)

    def _directory(self, file: str) -> list[tuple[tuple[bytes, int], int, int]]:
        size = self.store.get_file_info(f"{self.path}/index/{file}").size
        at, length = struct.unpack("<QQ", self._read(f"index/{file}", 0, size)[-16:] if size <= 16 else self._read(f"index/{file}", size - 16, 16))
        return [((k.encode(), i), o, n) for k, i, o, n in json.loads(zlib.decompress(self._read(f"index/{file}", at, length)))]

    def _block(self, file: str, at: int, length: int) -> list[tuple[tuple[bytes, int], str, int, int]]:
        lines = zlib.decompress(self._read(f"index/{file}", at, length)).decode().split("\n")
        return [((k.encode(), i), f, o, n) for k, i, f, o, n in map(json.loads, lines)]

    def find(self, key: tuple[bytes, int]) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of all captures with this key and page_id. Equal keys may run over the borders of blocks and files."""
        part = max(0, bisect.bisect_left(self.index.firsts, key) - 1)
        while part < len(self.index.files) and self.index.firsts[part] <= key:
            file = self.index.files[part]
            directory = self.directory(file)
            k = max(0, bisect.bisect_left(directory, key, key=lambda x: x[0]) - 1)
            while k < len(directory) and directory[k][0] <= key:
                lines = self.block(file, directory[k][1], directory[k][2])
                i = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while i < len(lines) and lines[i][0] == key:
                    yield lines[i][1:]
                    i += 1
                k += 1
            part += 1


class ArchiveReader:
    def __init__(self, root: str):
        self.store, self.path = _store(f"{root}/archives")
        self.open = lru_cache(16)(lambda name: self.store.open_input_file(f"{self.path}/{name}"))

    def read(self, file: str, offset: int, length: int) -> dict:
        return parse(self.open(file).read_at(length, offset))


def lookup(keys: DataFrame, index: CaptureIndex, p: WarcParams = WarcParams()) -> DataFrame:
    """The records of all captures of the keys (surt, page_id), each key once, however often it is asked for.

    Keys are sorted over range partitions, so that a task reads a stretch of the index; the upper level goes to the tasks with their code.
    """
    held = keys.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, archives, last = IndexReader(held.value), ArchiveReader(held.value.root), None
        for b in batches:
            rows = []
            for surt_, page_id in b.itertuples(index=False):
                key = (surt_.encode(), page_id)
                if key == last:
                    continue
                last = key
                for file, offset, length in reader.find(key):
                    r = archives.read(file, offset, length)
                    revisit = r["WARC-Type"] == "revisit"
                    rows.append((None if page_id == NO_ID else page_id, int(r["X-Payload-Length"]), r["WARC-Payload-Digest"].removeprefix("sha256:"), r["WARC-Type"], int(r["WARC-Refers-To"].rsplit(":", 1)[1][:-1]) if revisit else None))
            got = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield got.assign(page_id=got["page_id"].astype("Int64"), refers_to=got["refers_to"].astype("Int64"))

    parts = max(p.parts, len(index.files))
    rows = keys.select("surt", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id")).repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return rows.mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """Writes all pages to archives, indexes them and reads every record back through the index.

    A null html is an empty payload; a null url has the empty key and no target in its record; rows that repeat the smallest page_id of their payload are responses too; a
    row without page_id counts as a revisit if another with its payload has an id; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    captures = write(pages, scratch, p)
    index = build_index(captures, scratch, p)
    return lookup(pages.select(surt(F.col("url")).alias("surt"), "page_id"), index, p)
