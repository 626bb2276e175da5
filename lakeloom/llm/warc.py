"""Web archives with a two-level capture index.

Pages become WARC records, one gzip member each, in files in the shared folder. The index sorts captures by reversed
host; its shards hold compressed blocks of sorted lines, and after them a sparse directory with the first key of each
block. A look-up finds the shard among the shards' first keys, the block in its directory and the line in the block,
by binary search each time, and reads the record's range of bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import new_path, over_texts, table, tune, written

#: Payloads of fewer bytes are always stored, as a revisit record would be as long.
LEAST = 1000
#: Lines in a block of the index.
BLOCK = 256
#: Bytes of the archive that one task reads back, about.
PART_BYTES = 16 << 20
NAMES = uuid.UUID("6f0c2b52-6c55-4c0f-9d5d-0f3e8f1d4c11")
FOOTER = "<QQ8s"
MARK = b"CAPIDX01"


def surt(url: str | None) -> str:
    """A URL with its host reversed, so that captures of a domain sort together; no fragment, port or 'www.'."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url
    path = parts.path or "/"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + path + query


def key(url: str | None, page_id: int | None) -> str:
    """What the index sorts by, as UTF-8 bytes: the SURT and the page's number, null before all."""
    return f"{surt(url)}\t{0 if page_id is None else page_id + (1 << 63) + 1:020d}"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, compressed as a gzip member. A revisit holds the HTTP head alone."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = (url or "urn:page:" + str(page_id)).replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"X-Page-Id: {json.dumps(page_id)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {json.dumps(refers_to)}",
        ]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(member: bytes) -> dict:
    """The fields of a record as read from its range of bytes; raises if a digest isn't that of what is stored."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"][5:]:
        raise ValueError(f"the record of page {fields['X-Page-Id']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of page {fields['X-Page-Id']} is damaged")
    return {
        "page_id": json.loads(fields["X-Page-Id"]), "uri": fields["WARC-Target-URI"], "payload_bytes": length,
        "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": json.loads(fields["X-Refers-To-Page-Id"]) if revisit else None, "payload": None if revisit else payload,
    }


class Files:
    """Open files of the shared folder, the last few kept; ranges are read without reading the rest."""

    def __init__(self, keep: int = 16) -> None:
        self.open: OrderedDict[str, object] = OrderedDict()
        self.keep = keep

    def _file(self, uri: str):  # noqa: ANN202
        if uri not in self.open:
            system, path = fs.FileSystem.from_uri(uri)
            self.open[uri] = system.open_input_file(path)
            if len(self.open) > self.keep:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        return self.open[uri]

    def range(self, uri: str, offset: int, length: int) -> bytes:
        return self._file(uri).read_at(length, offset)

    def size(self, uri: str) -> int:
        return self._file(uri).size()


def _create(folder: str, suffix: str):  # noqa: ANN202
    """A new file for this task attempt; what a failed attempt leaves is in no manifest."""
    context = TaskContext.get()
    uri = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in map(str.split, ddl.split(", "))])


def payload_of(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def typed(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): which rows are revisits, by digest and length of the whole payload.

    Only digests that occur more than once are joined back, so a hot payload costs a row of the smaller side; Spark
    broadcasts that side if its written size allows, and splits the hot key if not.
    """
    size = F.length(payload_of(F.col("html")))
    digests = pages.select("page_id", F.sha1(payload_of(F.col("html"))).alias("digest"), size.alias("size")).where(F.col("size") >= LEAST)
    groups = digests.groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    groups = written(groups.select("digest", "size", "response"), "payloads")
    rows = pages.select("page_id", "url", "html", F.sha1(payload_of(F.col("html"))).alias("digest"), size.alias("size"))
    joined = rows.join(groups, ["digest", "size"], "left")
    revisit = F.col("response").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("response"), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"))


MANIFEST = "key string, file string, offset long, length long"


def archive(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row of pages; the manifest is (key, file, offset, length) for each.

    Of rows with equal payloads of LEAST bytes or more the one with the largest page_id is a response, the others
    revisits of it; rows that share that page_id and payload are all responses, as are rows whose group has no page_id.
    A null html is an empty payload, a null url an empty key. The manifest is a written table.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, uri, out, at = _arrow(MANIFEST), "", None, 0
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for page_id, url, html, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    uri, out = _create(f"{folder}/archive", ".warc.gz")
                    info = b"software: lakeloom\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    first = packer.compress(head.encode() + info + b"\r\n\r\n") + packer.flush()
                    out.write(first)
                    at = len(first)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, revisit, date)
                out.write(data)
                for column, value in zip(made, (key(url, page_id), uri, at, len(data)), strict=True):
                    column.append(value)
                at += len(data)
            yield _batch(made, schema)
        if out is not None:
            out.close()

    return written(typed(pages).mapInArrow(run, MANIFEST), "manifest")


SHARD = "first string, file string, n long"


def index(manifest: DataFrame, folder: str) -> DataFrame:
    """Sorts the manifest into shards of compressed blocks; (first, file, n) for each shard, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[bytes] = []
        first, directory, at, n, out, uri = "", [], 0, 0, None, ""
        opening = ""

        def flush() -> None:
            nonlocal at, lines
            data = zlib.compress(b"\n".join(lines), 3)
            directory.append([opening, at, len(data)])
            out.write(data)
            at += len(data)
            lines = []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    uri, out = _create(f"{folder}/index", ".idx")
                    first = row[0]
                if not lines:
                    opening = row[0]
                lines.append(json.dumps(row).encode())
                n += 1
                if len(lines) == BLOCK:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        data = zlib.compress(json.dumps(directory).encode(), 3)
        out.write(data + struct.pack(FOOTER, at, len(data), MARK))
        out.close()
        yield _batch([[first], [uri], [n]], _arrow(SHARD))

    ordered = manifest.repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInArrow(run, SHARD), "shards")


class Index:
    """Reads the index: shards by their first keys, then a shard's directory, then a block."""

    def __init__(self, shards: list[tuple[str, str]], files: Files) -> None:
        self.shards = sorted((k.encode(), uri) for k, uri in shards)
        self.firsts = [k for k, _ in self.shards]
        self.files = files
        self.known: tuple[int, list, list] = (-1, [], [])
        self.block: tuple[tuple[int, int], list, list] = ((-1, -1), [], [])

    def _directory(self, shard: int) -> tuple[list, list]:
        if self.known[0] != shard:
            uri = self.shards[shard][1]
            end = self.files.size(uri)
            offset, length, mark = struct.unpack(FOOTER, self.files.range(uri, end - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
            if mark != MARK:
                raise ValueError(f"{uri} isn't a shard of the index")
            rows = json.loads(zlib.decompress(self.files.range(uri, offset, length)))
            self.known = (shard, [r[0].encode() for r in rows], rows)
        return self.known[1], self.known[2]

    def _lines(self, shard: int, block: int) -> tuple[list, list]:
        if self.block[0] != (shard, block):
            _, offset, length = self._directory(shard)[1][block]
            data = zlib.decompress(self.files.range(self.shards[shard][1], offset, length))
            rows = [json.loads(x) for x in data.split(b"\n")]
            self.block = ((shard, block), [r[0].encode() for r in rows], rows)
        return self.block[1], self.block[2]

    def find(self, wanted: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture under a key."""
        want = wanted.encode()
        shard = max(0, bisect_left(self.firsts, want) - 1)
        while shard < len(self.shards) and self.firsts[shard] <= want:
            firsts, _ = self._directory(shard)
            block = max(0, bisect_left(firsts, want) - 1)
            while block < len(firsts) and firsts[block] <= want:
                keys, rows = self._lines(shard, block)
                for row in rows[bisect_left(keys, want) : bisect_right(keys, want)]:
                    yield row[1], row[2], row[3]
                block += 1
                firsts, _ = self._directory(shard)
            shard += 1


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def look_up(keys: DataFrame, shards: DataFrame, payload: bool = False, parts: int | None = None) -> DataFrame:
    """The records of keys (key), read back through the index; each key once, all captures under it.

    Keys are dealt in the index's order, so that a task reads few shards, each block once; into `parts` if given, as
    keys say nothing about the size of the records behind them. The shards' first keys, one for each task that wrote
    the index, go to every task.
    """
    firsts = [(r["first"], r["file"]) for r in shards.select("first", "file").collect()]
    ddl = FOUND + ", payload binary" * payload
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        found = Index(firsts, files)
        for batch in batches:
            rows = [parse(files.range(*where)) for k in batch.column(0).to_pylist() for where in found.find(k)]
            yield _batch([[r[n] for r in rows] for n in names], _arrow(ddl))

    parted = [parts] if parts else []
    ordered = keys.select("key").distinct().repartitionByRange(*parted, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, ddl)


def _keys(ids: list, urls: list) -> list:
    return [[key(u, i) for i, u in zip(ids, urls, strict=True)]]


def keys_of(pages: DataFrame) -> DataFrame:
    return over_texts(pages, ["page_id", "url"], "key string", _keys)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives pages, indexes the archive and reads every page back by its key: one row per row of pages.

    page_id is cast to long. Repeated rows have records each; a null url is one of its own, a null html is empty.
    Payloads of any length are one record, written and read whole in one worker. An empty table gives an empty result;
    other columns are not read, whatever their names.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    manifest = archive(pages, folder)
    size = manifest.agg(F.sum("length")).first()[0] or 0
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES)
    return look_up(keys_of(pages), index(manifest, folder), parts=parts)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last FROM p)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN CAST(last AS BIGINT) END AS refers_to
FROM r
"""
