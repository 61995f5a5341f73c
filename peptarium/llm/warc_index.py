"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, a member per record, and reports where each member
lies. Records whose payload equals that of a later page (at least ``REVISIT_BYTES`` bytes) are revisits.

Indexing: captures are range-partitioned and sorted by (reversed-host key, page_id). Each range becomes one
shard: a file of compressed blocks of ``BLOCK_LINES`` capture lines, and a sparse directory file with the
first key and the place of each block. The only thing every task knows is the list of shards, one entry per
partition.

Reading: a lookup binary-searches the shard list, then that shard's directory, then reads one block by range
and searches in it. Places found are grouped by archive and read in order, again by range.

All files live in the shared folder and are reached through pyarrow's file systems, so any task on any
machine sees them. A task that is run twice writes under a new name; only the names that reach the written
capture table are ever read.

Defined cases: null html is an empty payload; a null or blank url has the empty key; a null page_id sorts
first; rows that repeat a page_id get a record each; pages whose equal payload is shared by several rows of
the largest page_id are revisits of that id, all its rows being responses; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptarium.llm.common import NULL_ID, id_key, id_of, partitions, slices, stored
from peptarium.session import shared_scratch

REVISIT_BYTES = 1000
BLOCK_LINES = 512
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "<urn:x-page:%s>"


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.org/x?y`` is ``org,a,www)/x?y``."""
    clean = quote((url or "").strip(), safe=":/?#[]@!$&'()*+,;=%-._~")
    if not clean:
        return ""
    try:
        parts = urlsplit(clean if "//" in clean else f"//{clean}")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:  # not a url: filed under itself
        return clean
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + rest


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. ``digest`` is hex SHA-1 of the payload."""
    name = {NULL_ID: "null"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        "WARC-Record-ID: " + _RECORD % name.get(page, page),
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (quote((url or "").strip(), safe=":/?#[]@!$&'()*+,;=%-._~") or "about:blank"),
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", "WARC-Refers-To: " + _RECORD % name.get(refers_to, refers_to)]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, page, kind, refers_to, payload (None for revisits), its length and hex digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = lambda x: None if x is None else NULL_ID if x.endswith(":null>") else int(x[len(_RECORD) - 3 : -1])
    kind = headers["WARC-Type"]
    if kind == "response":
        digest_now = hashlib.sha1(payload).hexdigest()
        if len(payload) != length or digest_now != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    return {
        "headers": headers,
        "page": page(headers["WARC-Record-ID"]),
        "kind": kind,
        "refers_to": page(headers.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
        "bytes": length,
        "digest": digest,
    }


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """_id, url, html, digest, refers_to. Digests meet on narrow rows; payloads move once, by page."""
    narrow = pages.select(
        id_key("page_id").alias("_id"), F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")
    ).where(F.col("n") >= least)
    shared = narrow.groupBy("digest").agg(F.max("_id").alias("refers_to"), F.min("_id").alias("_low")).where("_low < refers_to").select("digest", "refers_to")
    revisits = narrow.join(shared, "digest").where("_id < refers_to").select("_id", "digest", "refers_to").distinct()
    whole = pages.select(id_key("page_id").alias("_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    return whole.join(revisits, ["_id", "digest"], "left").select("_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, root: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write all pages below ``root``; returns the written capture table (_id, key, file, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for piece in slices(batches, "html"):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            ids, urls, digests, olds = (piece.column(c).to_pylist() for c in ("_id", "url", "digest", "refers_to"))
            lengths, offsets = [], []
            for i, url, html, digest, old in zip(ids, urls, piece.column(2), digests, olds, strict=True):
                member = gzip.compress(record(i, url, html.as_buffer().to_pybytes(), digest, old), 3, mtime=0)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([surt(u) for u in urls], pa.string()), pa.array([name] * len(ids), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["_id", "key", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    made = with_revisits(pages, least).mapInArrow(run, "_id bigint, key string, file string, offset bigint, length bigint")
    return stored(made, "captures")


def write_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, int, str]]:
    """Write shards below ``root``; returns the shard list: first key, first page, name; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        name, out, at = uuid.uuid4().hex, None, 0
        lines: list[tuple] = []
        directory: list[tuple] = []

        def flush() -> None:
            nonlocal at, lines
            block = zlib.compress(json.dumps(lines).encode(), 3)
            out.write(block)
            directory.append((lines[0][0], lines[0][1], at, len(block)))
            at, lines = at + len(block), []

        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.blocks", compression=None)
            for line in zip(*(batch.column(c).to_pylist() for c in ("key", "_id", "file", "offset", "length")), strict=True):
                lines.append(line)
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with fs.open_output_stream(f"{base}/{name}.directory", compression=None) as f:
            f.write(zlib.compress(json.dumps(directory).encode(), 3))
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name])], ["key", "_id", "name"])

    dealt = captures.repartitionByRange(partitions(captures.sparkSession), "key", "_id").sortWithinPartitions("key", "_id")
    shards = stored(dealt.select("key", "_id", "file", "offset", "length").mapInArrow(run, "key string, _id bigint, name string"), "shards")
    return sorted((r["key"], r["_id"], r["name"]) for r in shards.collect())


class Index:
    """Lookups in written shards; holds one directory and one block at a time."""

    def __init__(self, root: str, shards: list[tuple[str, int, str]]):
        self.fs, self.base = pafs.FileSystem.from_uri(root)
        self.shards, self.firsts = shards, [s[:2] for s in shards]
        self.shard, self.directory, self.block_at, self.block, self.file = None, [], None, [], None

    def _open(self, k: int) -> None:
        if self.shard != k:
            name = self.shards[k][2]
            with self.fs.open_input_stream(f"{self.base}/{name}.directory", compression=None) as f:
                self.directory = [tuple(x) for x in json.loads(zlib.decompress(f.read()))]
            if self.file is not None:
                self.file.close()
            self.file = self.fs.open_input_file(f"{self.base}/{name}.blocks")
            self.shard, self.block_at = k, None

    def _read(self, j: int) -> list[tuple]:
        if self.block_at != j:
            self.block = [tuple(x) for x in json.loads(zlib.decompress(self.file.read_at(self.directory[j][3], self.directory[j][2])))]
            self.block_at = j
        return self.block

    def find(self, key: str, page: int) -> list[tuple[str, int, int]]:
        """(file, offset, length) of all captures of this key and page."""
        out: list[tuple[str, int, int]] = []
        want = (key, page)
        k = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while k < len(self.shards) and self.firsts[k] <= want:
            self._open(k)
            j = max(0, bisect.bisect_left(self.directory, want) - 1)
            while j < len(self.directory) and self.directory[j][:2] <= want:
                lines = self._read(j)
                i = bisect.bisect_left(lines, want)
                while i < len(lines) and lines[i][:2] == want:
                    out.append(lines[i][2:])
                    i += 1
                if i < len(lines):
                    return out
                j += 1
            k += 1
        return out


def find_captures(wanted: DataFrame, root: str, shards: list[tuple[str, int, str]]) -> DataFrame:
    """(file, offset, length) for rows (key, _id); sorted lookups touch each block once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(root, shards)
        for batch in batches:
            found = [x for key, i in zip(batch.column("key").to_pylist(), batch.column("_id").to_pylist(), strict=True) for x in index.find(key, i)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "offset", "length"])

    n = partitions(wanted.sparkSession)
    sorted_rows = wanted.distinct().repartitionByRange(n, "key", "_id").sortWithinPartitions("key", "_id").select("key", "_id")
    return sorted_rows.mapInArrow(run, "file string, offset bigint, length bigint")


def read_records(places: DataFrame, root: str) -> DataFrame:
    """_id, payload_bytes, payload_digest, record_type, refers_to, read from the archives by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        name, file = None, None
        for batch in batches:
            got = []
            for f, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, fs.open_input_file(f"{base}/{f}")
                r = parse(gzip.decompress(file.read_at(length, offset)))
                got.append((r["page"], r["bytes"], r["digest"], r["kind"], r["refers_to"]))
            columns = list(zip(*got, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # one archive is read in stretches of 64 MB, so a large one is shared among tasks
    stretch = (F.col("offset") / F.lit(64 << 20)).cast("long")
    dealt = places.repartition(partitions(places.sparkSession), "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def key_of() -> Column:
    @F.pandas_udf("string")
    def keys(urls: pd.Series) -> pd.Series:
        return urls.map(surt)

    return keys("url")


def round_trip(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write every page, index the archives, look every page up by its url and read it back."""
    root = shared_scratch(pages.sparkSession, "warc")
    shards = write_index(write_archives(pages, f"{root}/archives", least), f"{root}/index")
    places = find_captures(pages.select(key_of().alias("key"), id_key("page_id").alias("_id")), f"{root}/index", shards)
    read = read_records(places, f"{root}/archives")
    return read.select(id_of("_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to"))
