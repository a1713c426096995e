"""WARC archives with a two-level capture index.

Writing: every row becomes one WARC record, a gzip member of its own, in an archive of its task. Equal payloads are stored once: the
row with the smallest id keeps the payload as a ``response``, the others become ``revisit`` records that name it.

Index: captures are sorted by their URL key (host labels reversed, then path) over range partitions. Each partition writes one index file:
compressed blocks of ``BLOCK_LINES`` captures, then a sparse directory with the first key and the place of each block. A list of the index
files with their first keys (one entry for each partition) is the upper level.

Reading: a request finds its index file by binary search in that list, its block by binary search in the file's directory, reads this block
alone, and then only the byte range of the record.

Archives and index lie in the shared folder and are reached through its URI, so a folder in an object store works as well. A task that
is run again writes a new file; only files that the stored table of captures names are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import new_folder, stored
from textloom.llm.url_filters import host_of
from textloom.scale import bounded_broadcast

#: Captures in one compressed index block; bytes after which a task begins a new archive.
BLOCK_LINES, ARCHIVE_BYTES = 1000, 1 << 30
#: Open archives of one reading task, places that it looks up before it reads them, and bytes of archive for one task.
OPEN_FILES, PLACES, TASK_BYTES = 32, 4096, 64 << 20
#: Digests of payloads that occur more than once which are broadcast at most; beyond that they are joined by a shuffle.
SHARED_DIGESTS = 200_000

CAPTURE = "surt STRING, page_id LONG, file STRING, offset LONG, length LONG"
RECORD = ("page_id LONG, url STRING, payload_bytes LONG, payload_digest STRING, record_type STRING, refers_to LONG, "
          "payload STRING")


def surt_key(url: Column) -> Column:
    """Reversed-host sort key: ``http://a.b.c/x?y`` becomes ``c,b,a)/x?y``. Null or no ``://``: ``)`` and the text as it is."""
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    return F.concat(host, F.lit(")"), F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*", ""))


def order_key(page_id: Column) -> Column:
    """Ids in order, null first."""
    return F.coalesce(page_id.cast("long"), F.lit(-(1 << 63)))


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of the capture, with the length of the payload, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("X-Page-ID", "" if page_id is None else str(page_id))]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("X-Refers-To-Page-ID", str(first))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The fields of ``RECORD``; raises if the payload does not fit its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record of page {fields['X-Page-ID']}")
    number = lambda s: int(s) if s else None
    return (number(fields["X-Page-ID"]), fields["WARC-Target-URI"], size, digest, kind, number(fields.get("X-Refers-To-Page-ID")),
            payload.decode() if kind == "response" else None)


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 0, key: str = "page_id", url: str = "url",
                   html: str = "html") -> DataFrame:
    """Write a record for each row below ``folder`` and return the stored table of captures (``CAPTURE``).

    Payloads of fewer than ``revisit_bytes`` bytes are always responses. Null html is an empty payload, a null URL an empty target. Rows that
    share id and payload with the response are responses themselves. Null ids stand after all others: they revisit when the payload has a
    numbered row, and are responses when it has none.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), surt_key(F.col(url)).alias("surt"),
                        body.alias("body"), F.sha1(body.cast("binary")).alias("sha"))
    shared = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Only payloads that occur again need to meet; their digests go to the pages as long as that is proven cheap. In a shuffled join Spark splits a digest
    # with many rows over several tasks.
    rows = rows.join(bounded_broadcast(shared, SHARED_DIGESTS), "sha", "left").withColumn(
        "revisit", (F.octet_length("body") >= revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        try:
            for batch in batches:
                found = []
                for r in batch.itertuples(index=False):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(r.sha)).decode()
                    page_id = None if pd.isna(r.page_id) else int(r.page_id)
                    data = gz(record_bytes(page_id, r.url, r.body.encode(), digest, None if pd.isna(r.first) else int(r.first), r.revisit))
                    found.append((r.surt, page_id, f"{folder}/{name}", out.tell(), len(data)))
                    out.write(data)
                    if out.tell() >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                frame = pd.DataFrame(found, columns=["surt", "page_id", "file", "offset", "length"])
                yield frame.astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    ready = rows.select("page_id", "url", "surt", "body", "sha", "first", "revisit")
    return stored(ready.mapInPandas(write, CAPTURE), "captures")


def range_count(captures: DataFrame) -> int:
    """Range partitions for work on the records: two for each core at least, and one for each ``TASK_BYTES`` of archive. The slim rows that name the records
    say nothing about the bytes behind them, so the number is not left to their size."""
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return max(2 * captures.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, parts: int | None = None) -> list[tuple]:
    """Sort the captures into index files below ``folder``; returns (first surt, first id, file) of each, in key order.

    The list has one entry for each range partition. Equal keys may go on in the next block or file; file and offset complete the sort key, so a
    URL with any share of the captures is cut like all others.
    """
    ordered = captures.withColumn("id", order_key(F.col("page_id")))
    keys = ["surt", "id", "file", "offset"]
    ordered = ordered.repartitionByRange(parts or range_count(captures), *keys).sortWithinPartitions(*keys)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        name, lines, directory, out = f"{uuid.uuid4().hex}.cdx.gz", [], [], None

        def flush() -> None:
            data = gz("\n".join(json.dumps(x) for x in lines).encode())
            directory.append((lines[0][0], lines[0][1], out.tell(), len(data)))
            out.write(data)
            lines.clear()

        for batch in batches:
            if out is None and len(batch):
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            for r in batch[["surt", "id", "file", "offset", "length"]].itertuples(index=False):
                lines.append((r.surt, int(r.id), r.file, int(r.offset), int(r.length)))
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            at, tail = out.tell(), gz(json.dumps(directory).encode())
            out.write(tail + at.to_bytes(8, "big"))
            out.close()
            yield pd.DataFrame([(directory[0][0], directory[0][1], f"{folder}/{name}")], columns=["surt", "id", "file"])

    files = stored(ordered.mapInPandas(write, "surt STRING, id LONG, file STRING"), "index-files")
    return sorted(tuple(r) for r in files.collect())


class Archive:
    """Reads captures by key: index file, block, record, each by its byte range."""

    def __init__(self, files: list[tuple]):
        self.files, self.firsts = files, [f[:2] for f in files]
        self.handles: OrderedDict[str, object] = OrderedDict()
        self.directory: tuple[str, list] = ("", [])
        self.block: tuple[tuple, list] = ((), [])

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.handles:
            if len(self.handles) >= OPEN_FILES:
                self.handles.popitem(last=False)[1].close()
            fs, path = opened(file)
            self.handles[file] = fs.open_input_file(path)
        self.handles.move_to_end(file)
        handle = self.handles[file]
        handle.seek(handle.size() + offset if offset < 0 else offset)
        return handle.read(length)

    def blocks(self, file: str) -> list:
        if self.directory[0] != file:
            at = int.from_bytes(self.read(file, -8, 8), "big")
            size = self.handles[file].size() - 8 - at
            entries = json.loads(zlib.decompress(self.read(file, at, size), 31))
            self.directory = file, [((s, i), o, n) for s, i, o, n in entries]
        return self.directory[1]

    def lines(self, file: str, offset: int, length: int) -> list:
        if self.block[0] != (file, offset):
            text = zlib.decompress(self.read(file, offset, length), 31).decode()
            self.block = (file, offset), [json.loads(x) for x in text.split("\n")]
        return self.block[1]

    def captures(self, key: tuple[str, int]) -> Iterator[tuple]:
        """(file, offset, length) of all captures with this key."""
        f = max(bisect_left(self.firsts, key) - 1, 0)
        while f < len(self.files) and self.firsts[f] <= key:
            file = self.files[f][2]
            blocks = self.blocks(file)
            b = max(bisect_left(blocks, key, key=lambda x: x[0]) - 1, 0)
            while b < len(blocks) and blocks[b][0] <= key:
                for surt, i, *place in self.lines(file, *blocks[b][1:]):
                    if (surt, i) == key:
                        yield tuple(place)
                b += 1
            f += 1


def lookup(requests: DataFrame, files: list[tuple], key: str = "page_id", url: str = "url", payload: bool = True, parts: int | None = None) -> DataFrame:
    """All records (``RECORD``) whose URL and id a row of ``requests`` names; repeated requests count once.

    Requests are sorted by key over ``parts`` range partitions, so that a task reads each index block once, in order. The records that some thousand requests
    name are read by archive and offset, so that each archive is opened once for them.
    """
    keyed = requests.select(surt_key(F.col(url)).alias("surt"), order_key(F.col(key)).alias("id")).distinct()
    keyed = keyed.repartitionByRange(parts or 2 * requests.sparkSession.sparkContext.defaultParallelism, "surt", "id").sortWithinPartitions("surt", "id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, names = Archive(files), [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            found, size = [], 0
            places = (p for surt, i in zip(batch["surt"], batch["id"]) for p in archive.captures((surt, int(i))))
            while some := sorted(islice(places, PLACES)):
                for place in some:
                    fields = parse_record(zlib.decompress(archive.read(*place), 31))
                    found.append(fields if payload else (*fields[:-1], None))
                    size += fields[2] if payload else 64
                    if size > 16 << 20:
                        yield frame(found, names)
                        found, size = [], 0
            yield frame(found, names)

    return keyed.mapInPandas(read, RECORD)


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def archived(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write all pages, index the archives, and read every page back through the index.

    One row for each row of ``pages``: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to. Null html is an empty payload,
    a null URL an empty target; a null id is carried through and never the one that others refer to. Rows that agree in URL and id are found by one request,
    all of them. An empty table gives no archive and no row; extra columns are not read.
    """
    folder = new_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archive", revisit_bytes)
    parts = range_count(captures)
    return lookup(pages, build_index(captures, f"{folder}/index", parts=parts), payload=False, parts=parts).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
