"""WARC archives as a PySpark Python data source (``format("warc")``), with revisit records for equal payloads.

Writing: each task writes files of its own, rolled at ``roll_bytes``, one gzip member a record; a member's
extra field ``sl`` holds its compressed and plain length, so a reader can go from record to record.
The commit writes a manifest, so files of failed attempts are never read.

Reading: partitions are runs of whole files of about ``split_bytes``. Predicates on the record type and on
header columns are pushed down. Of each record the header block is decoded first; the payload is decoded
only if the predicates hold and the option ``payload`` is not ``false``.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from quarrygraph.llm.common import persist, scratch_root, spread_join, table

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length bigint, headers map<string,string>, payload binary"
#: Columns that hold one header each.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
_ARROW = pa.schema([*((k, pa.string()) for k in HEADERS), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_MANIFEST = "_manifest.json"
_BATCH_BYTES = 8 << 20
_HEAD = 2048


def _filesystem(uri: str):
    """A file system and the path in it: local ones directly, others by Arrow."""
    if uri.startswith("file:"):
        return None, "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return None, uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _open(uri: str, mode: str):
    system, path = _filesystem(uri)
    if system is None:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    return system.open_output_stream(path) if mode == "wb" else system.open_input_file(path)


def _listed(uri: str) -> list[tuple[str, int]]:
    """Archive files below a folder with their sizes; those of the manifests if there are any."""
    system, path = _filesystem(uri)
    if system is None:
        found = {n: os.path.getsize(os.path.join(path, n)) for n in os.listdir(path)} if os.path.isdir(path) else {os.path.basename(path): os.path.getsize(path)}
        base = uri if os.path.isdir(path) else os.path.dirname(uri)
    else:
        from pyarrow import fs

        found = {i.base_name: i.size for i in system.get_file_info(fs.FileSelector(path)) if i.is_file}
        base = uri
    manifests = [n for n in found if n.endswith(_MANIFEST)]
    names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
    if manifests:
        names = []
        for m in manifests:
            with _open(f"{base}/{m}", "rb") as f:
                names += json.loads(f.read())
    return sorted((f"{base}/{n}", found[n]) for n in names)


#: The largest length that a member's header can name.
_LONGEST = 0xFFFFFFFF


def encode_record(headers: dict[str, str], payload: bytes, level: int = 6) -> bytes:
    """One record as a gzip member; its header names the member's length, but for members over 4 GiB, whose end
    a reader finds by decoding them."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers.items() if v is not None)
    block = (head + f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = packer.compress(block) + packer.flush()
    tail = data + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)
    whole = 10 + 2 + 12 + len(tail)
    if whole > _LONGEST:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(block) & 0xFFFFFFFF) + tail


def _clean(value: str) -> str:
    """Header values stay on one line."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _parse_head(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name:
            out[name.strip()] = value.strip().replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return out


def read_records(f, wanted, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records whose headers ``wanted`` accepts. ``f`` is a seekable binary file, gzip members or plain."""
    while True:
        at = f.tell()
        mark = f.read(10)
        if len(mark) < 10:
            return
        if mark[:2] != b"\x1f\x8b":
            f.seek(at)
            yield from _plain(f, wanted, payload)
            return
        size = None
        if mark[3] & 4:
            extra = f.read(struct.unpack("<H", f.read(2))[0])
            if extra[:4] == b"sl\x08\0":
                size = struct.unpack("<I", extra[4:8])[0]
        if size is None:  # a member of unknown length is decoded to its end
            f.seek(at)
            unpack, block = zlib.decompressobj(31), bytearray()
            while not unpack.eof and (more := f.read(1 << 16)):
                block += unpack.decompress(more)
            f.seek(-len(unpack.unused_data), os.SEEK_CUR)
            head, _, body = bytes(block).partition(b"\r\n\r\n")
            headers = _parse_head(head)
            if wanted(headers):
                yield headers, body[: int(headers["Content-Length"])] if payload else None
            continue
        left = size - (f.tell() - at) - 8
        data = f.read(min(left, _HEAD))
        unpack = zlib.decompressobj(-15)
        block = unpack.decompress(data, _HEAD * 4)
        read = len(data)
        while b"\r\n\r\n" not in block:
            if unpack.unconsumed_tail:
                block += unpack.decompress(unpack.unconsumed_tail, _HEAD * 4)
            elif read < left:
                more = f.read(min(left - read, _HEAD * 8))
                read += len(more)
                block += unpack.decompress(more, _HEAD * 4)
            else:
                raise ValueError("a record without the end of its headers")
        head, _, body = block.partition(b"\r\n\r\n")
        headers = _parse_head(head)
        if wanted(headers):
            if payload:
                body += unpack.decompress(unpack.unconsumed_tail + f.read(left - read)) + unpack.flush()
                yield headers, body[: int(headers["Content-Length"])]
            else:
                yield headers, None
        f.seek(at + size)


def _plain(f, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    while True:
        head = bytearray()
        while not head.endswith(b"\r\n\r\n"):
            line = f.readline()
            if not line:
                return
            if line.strip() or head:
                head += line
        headers = _parse_head(bytes(head[:-4]))
        n = int(headers["Content-Length"])
        if wanted(headers):
            yield headers, f.read(n) if payload else None
            if not payload:
                f.seek(n, os.SEEK_CUR)
        else:
            f.seek(n, os.SEEK_CUR)


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(0)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.split_bytes = int(options.get("split_bytes", 16 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", IsNotNull: "there"}
        for one in filters:
            name = one.attribute[0] if getattr(one, "attribute", None) and len(one.attribute) == 1 else None
            if type(one) in kinds and name in HEADERS:
                self.tests.append((kinds[type(one)], HEADERS[name], getattr(one, "value", None)))
            else:
                yield one

    def partitions(self):
        runs: list[list[str]] = []
        held = self.split_bytes
        for name, size in _listed(self.path):
            if held + size > self.split_bytes:
                runs.append([])
                held = 0
            runs[-1].append(name)
            held += size
        return [WarcPartition(r) for r in runs or [[]]]

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            got = headers.get(name)
            if got is None or kind == "eq" and got != value or kind == "in" and got not in value or kind == "starts" and not got.startswith(value):
                return False
        return True

    def read(self, partition):
        rows, held = [], 0
        for name in partition.files:
            with _open(name, "rb") as f:
                for headers, body in read_records(f, self.wanted, self.payload):
                    rows.append((*(headers.get(h) for h in HEADERS.values()), int(headers["Content-Length"]), list(headers.items()), body))
                    held += len(body or b"") + 500
                    if held > _BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _ARROW)], schema=_ARROW)


class WarcCommit(WriterCommitMessage):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of (headers map<string,string>, payload binary)."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.level = int(options.get("level", 6))
        self.roll_bytes = int(options.get("roll_bytes", 64 << 20))

    def write(self, iterator):
        files, out, size = [], None, 0
        for batch in iterator:
            headers, payloads = batch.column("headers"), batch.column("payload")
            for h, p in zip(headers, payloads):
                if out is None or size >= self.roll_bytes:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = _open(f"{self.path}/{files[-1]}", "wb"), 0
                data = encode_record(dict(h.as_py()), p.as_py() or b"", self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return WarcCommit(files)

    def commit(self, messages):
        with _open(f"{self.path}/{uuid.uuid4().hex}{_MANIFEST}", "wb") as f:
            f.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages):
        """Files without a manifest are not read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(headers, payload) of one record a row. Of equal payloads of ``min_bytes`` or more, the smallest id
    is a response and the others are revisits without a payload.

    A null html is an empty payload. A null id counts as larger than any other; where all ids of a group
    are null, and for rows that repeat the smallest id, each is a response. Extra columns are ignored.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    shared = persist(base.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "warc-shared")
    linked = spread_join(base, shared.select("digest", "first"), shared, "digest", F.struct("id", "uri"), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    pairs = {
        "WARC-Type": F.when(again, "revisit").otherwise("response"),
        "WARC-Record-ID": urn("id"),
        "WARC-Target-URI": F.coalesce("uri", F.lit("")),
        "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest")),
        "WARC-Payload-Length": F.col("bytes").cast("string"),
        "Content-Type": F.lit("text/html; charset=utf-8"),
        "WARC-Refers-To": F.when(again, urn("first")),
        "WARC-Profile": F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
    }
    headers = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return linked.select(headers.alias("headers"), F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))


def _page(column: str):
    """The id in ``<urn:page:ID>``; null for a null id."""
    return F.regexp_extract(F.col(column), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the whole ``pages`` table as archives in the shared folder and reads them back.

    Responses are read with their payloads, whose digest and length are computed anew; of revisits only
    the headers are decoded.
    """
    register(spark)
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    responses = spark.read.format("warc").load(path).filter("record_type = 'response'")
    responses = responses.select(_page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")
    revisits = revisits.select(_page("record_id").alias("page_id"), F.col("headers")["WARC-Payload-Length"].cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", _page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN p.n >= 100 AND p.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 100 AND p.page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
