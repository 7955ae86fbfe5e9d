"""WARC archives as a Spark data source, and pages written as response and revisit records.

``register(spark)`` adds the format ``warc``.  Reading plans one input partition for each group of
files, takes predicates on record type and headers down to the reader, parses the headers of a
record first, and passes over the payload of a record that no predicate wants: plain files are
seeked past, compressed members carry their length in the ``sl`` field of the gzip header.
Members without that field are read through.  Paths are opened with ``pyarrow.fs``.

Columns: ``record_id warc_type target_uri warc_date content_type payload_digest refers_to
payload_length content_length headers payload``.  ``payload_length`` is what the record states of
the full payload; a revisit states that of the record it refers to.  Option ``payload=false``
leaves ``payload`` null and undecoded.

Defined cases: no files give no rows; a null payload is written as an empty one; null headers are
left out; control characters in headers are percent-encoded; repeated rows become repeated records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare, table, written_at

SCHEMA = (
    "record_id string, warc_type string, target_uri string, warc_date string, content_type string,"
    " payload_digest string, refers_to string, payload_length long, content_length long,"
    " headers map<string,string>, payload binary"
)
HEADERS = {
    "record_id": "warc-record-id",
    "warc_type": "warc-type",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "payload_length": "x-payload-length",
    "content_length": "content-length",
}
NUMBERS = ("payload_length", "content_length")
MANIFEST = "_records.json"
FILE_BYTES, BATCH_BYTES, CHUNK = 32 << 20, 4 << 20, 1 << 14
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


# --- records -------------------------------------------------------------------------------

def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def encode_record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {_clean(v)}" for k, v in headers.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + END + block + END


def compress_member(record: bytes, level: int = 6) -> bytes:
    """One gzip member whose header states its own compressed and plain length."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 24 + len(body) + 8
    if max(size, len(record)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, size, len(record))
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra))
    return head + extra + body + tail


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class _Source:
    """Bytes taken on demand: what is asked for is decoded, nothing beyond a chunk more."""

    def __init__(self, pull):
        self.pull, self.have = pull, b""

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark))
            if not (more := self.pull()):
                return None
            self.have += more
        out, self.have = self.have[:found], self.have[found + len(mark):]
        return out

    def take(self, size: int, keep: bool = True) -> bytes:
        parts, missing = [], size
        while missing:
            if not self.have and not (more := self.pull()):
                raise ValueError("a record ends early")
            if not self.have:
                self.have = more
            part, self.have = self.have[:missing], self.have[missing:]
            missing -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP header, where there is one."""
    if headers.get("content-type", "").startswith("application/http"):
        head, found, body = block.partition(END)
        return body if found else b""
    return block


def read_records(handle, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of each record that ``wanted`` accepts by its headers."""
    size = handle.size()
    start = handle.read(4)
    if not start:
        return
    if not start.startswith(b"\x1f\x8b"):
        yield from _stream(handle, size, wanted, payloads, plain=True)
        return
    at = 0
    while at < size:
        handle.seek(at)
        head = handle.read(24)
        if len(head) < 24 or head[3] != 4 or head[12:14] != b"sl":
            handle.seek(at)
            yield from _stream(handle, size, wanted, payloads, plain=False)
            return
        length = struct.unpack("<I", head[16:20])[0]
        left = [length - 32]
        inflate = zlib.decompressobj(-15)

        def pull():
            while left[0] > 0:
                raw = handle.read(min(CHUNK, left[0]))
                if not raw:
                    return b""
                left[0] -= len(raw)
                if out := inflate.decompress(raw):
                    return out
            return inflate.flush()

        source = _Source(pull)
        headers = parse_headers(source.until(END) or b"")
        if wanted(headers):
            yield headers, _payload(headers, source.take(int(headers["content-length"]))) if payloads else None
        at += length


def _stream(handle, size, wanted, payloads, plain):
    """Records one after the other; what isn't wanted is seeked past in a plain file."""
    if plain:
        handle.seek(0)
    raw = handle if plain else gzip.GzipFile(fileobj=handle)
    source = _Source(lambda: raw.read(CHUNK))
    while True:
        while source.have[:2] == b"\r\n":
            source.have = source.have[2:]
        if not source.have and not (more := source.pull()):
            return
        elif not source.have:
            source.have = more
            continue
        head = source.until(END)
        if head is None:
            return
        headers = parse_headers(head)
        length = int(headers.get("content-length", 0))
        if wanted(headers) and payloads:
            yield headers, _payload(headers, source.take(length))
        else:
            if wanted(headers):
                yield headers, None
            if plain and length > len(source.have):
                handle.seek(handle.tell() + length - len(source.have))
                source.have = b""
            else:
                source.take(length, keep=False)
        if len(source.have) < 4:
            source.have += source.pull()


# --- the data source -----------------------------------------------------------------------

def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Files(ds.InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


#: Filters taken over whole: name of the class to a test of (header value, filter value).
TESTS = {
    "EqualTo": lambda v, x: v is not None and v == x,
    "EqualNullSafe": lambda v, x: v == x,
    "In": lambda v, x: v is not None and v in x,
    "GreaterThan": lambda v, x: v is not None and v > x,
    "GreaterThanOrEqual": lambda v, x: v is not None and v >= x,
    "LessThan": lambda v, x: v is not None and v < x,
    "LessThanOrEqual": lambda v, x: v is not None and v <= x,
    "StringStartsWith": lambda v, x: v is not None and v.startswith(x),
    "StringEndsWith": lambda v, x: v is not None and v.endswith(x),
    "StringContains": lambda v, x: v is not None and x in v,
    "IsNotNull": lambda v, x: v is not None,
    "IsNull": lambda v, x: v is None,
}


def header_value(headers: dict[str, str], column: str):
    value = headers.get(HEADERS[column])
    if column in NUMBERS:
        return int(value) if value is not None and value.isdigit() else None
    if value is not None and column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value


class WarcReader(ds.DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = options.get("payload", "true") != "false"
        self.split = int(options.get("splitBytes", FILE_BYTES))
        self.pushed: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            kind, column = type(f).__name__, ".".join(getattr(f, "attribute", ()))
            value = tuple(v) if isinstance(v := getattr(f, "value", None), list) else v
            if kind in TESTS and column in HEADERS and not (value is None and kind not in ("IsNull", "IsNotNull")):
                self.pushed.append((column, kind, value))
            else:
                yield f

    def partitions(self):
        fs, base = _open(self.path)
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.File:
            return [_Files([base])]
        if info.type == pafs.FileType.NotFound:
            raise ValueError(f"no such path: {self.path}")
        if fs.get_file_info(f"{base}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                found = [(f"{base}/{name}", size) for name, size in json.loads(f.read())]
        else:
            found = [
                (x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(base, recursive=True))
                if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))
            ]
        groups: list[list[str]] = []
        room = 0
        for name, size in sorted(found):
            if size > room:
                groups.append([])
                room = self.split
            groups[-1].append(name)
            room -= size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition):
        fs, _ = _open(self.path)
        tests = [(c, TESTS[k], v) for c, k, v in self.pushed]
        wanted = lambda headers: all(t(header_value(headers, c), v) for c, t, v in tests)
        rows, held = [], 0
        for name in partition.files:
            with fs.open_input_file(name) as handle:
                for headers, payload in read_records(handle, wanted, self.payloads):
                    rows.append((*[header_value(headers, c) for c in HEADERS], headers, payload))
                    held += 500 + len(payload or b"")
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if c in NUMBERS else pa.string() for c in HEADERS]
    kinds += [pa.map_(pa.string(), pa.string()), pa.binary()]
    columns = list(zip(*rows))
    columns[-2] = [list(h.items()) for h in columns[-2]]
    arrays = [pa.array(v, k) for v, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[*HEADERS, "headers", "payload"])


class _Wrote(ds.WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(ds.DataSourceArrowWriter):
    """Each task attempt writes files of its own; the commit lists those of the attempts that count."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gz = options.get("compress", "true") != "false"
        self.level = int(options.get("level", 6))
        self.limit = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator):
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        files: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    record = encode_row(row)
                    record = compress_member(record, self.level) if self.gz else record
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gz, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(record)
                    size += len(record)
                    if size >= self.limit:
                        out.close()
                        files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return _Wrote(files)

    def commit(self, messages):
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        found: list = []
        if not self.overwrite and fs.get_file_info(f"{base}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                found = json.loads(f.read())
        found += [x for m in messages if m is not None for x in m.files]
        with fs.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps(found).encode())

    def abort(self, messages):
        """Files of a failed job are listed nowhere and so never read."""


def encode_row(row: dict) -> bytes:
    """A record of a row with the columns of :data:`SCHEMA` (``headers`` and lengths are optional)."""
    payload = row.get("payload") or b""
    http = row["warc_type"] in ("response", "revisit")
    digest = row.get("payload_digest") or "sha1:" + hashlib.sha1(payload).hexdigest()
    length = row.get("payload_length")
    bracket = lambda v: None if v is None else f"<{v}>"
    headers = {
        "WARC-Type": row["warc_type"],
        "WARC-Record-ID": bracket(row.get("record_id") or f"urn:uuid:{uuid.uuid4()}"),
        "WARC-Date": row.get("warc_date") or "1970-01-01T00:00:00Z",
        "WARC-Target-URI": row.get("target_uri"),
        "Content-Type": "application/http; msgtype=response" if http else row.get("content_type"),
        "WARC-Payload-Digest": digest,
        "WARC-Refers-To": bracket(row.get("refers_to")),
        "X-Payload-Length": str(len(payload) if length is None else length),
    }
    if row["warc_type"] == "revisit":
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    more = row.get("headers")
    for name, value in (more.items() if isinstance(more, dict) else more or ()):
        if name.lower() not in HEADERS.values():
            headers.setdefault(name, value)
    block = io.BytesIO()
    if http:
        block.write(HTTP % len(payload))
    block.write(payload)
    return encode_record(headers, block.getvalue())


class WarcDataSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


# --- pages ---------------------------------------------------------------------------------

PAGE_URN = "urn:x-page:"


def page_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """A record for each page.  Of equal payloads of ``least`` bytes or more, the one with the
    largest ``page_id`` is the response and the others revisit it.

    Rows that repeat that page_id are responses too; a null ``page_id`` is smaller than any other.
    The choice is made on digests alone, with partial sums; the join that carries payloads may be
    split at a hot digest.  Digests that occur once don't reach the right side.
    """
    rows = pages.select(
        "page_id",
        F.col("url").alias("target_uri"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({
        "payload_digest": F.sha1("payload"),
        "payload_length": F.octet_length("payload").cast("long"),
    })
    large = rows.where(F.col("payload_length") >= least).select("page_id", "payload_digest")
    kept = large.groupBy(F.col("payload_digest").alias("digest")).agg(
        F.max("page_id").alias("kept"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    joined = rows.join(
        kept, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_length") >= least), "left"
    )
    revisit = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    urn = lambda c: F.concat(F.lit(PAGE_URN), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select(
        urn("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        "target_uri",
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
        F.when(revisit, urn("kept")).alias("refers_to"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").option("path", path).save()


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as an archive and read it back: responses with their payload, revisits by
    their headers alone."""
    prepare(spark)
    path = written_at(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    archive = spark.read.format("warc").option("path", path)
    responses = archive.load().where(F.col("warc_type") == "response").select(
        number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = (
        spark.read.format("warc").option("path", path).option("payload", "false").load()
        .where(F.col("warc_type") == "revisit")
        .select(
            number("record_id").alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
            F.col("warc_type").alias("record_type"),
            number("refers_to").alias("refers_to"),
        )
    )
    return responses.unionByName(revisits)


OP9_SQL = """with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
k as (select payload_digest, max(page_id) as kept from d where payload_bytes >= 1000 group by all)
select d.page_id, d.payload_bytes, d.payload_digest,
 case when k.kept is null or k.kept = d.page_id then 'response' else 'revisit' end as record_type,
 case when k.kept <> d.page_id then k.kept end as refers_to
from d left join k on k.payload_digest = d.payload_digest and d.payload_bytes >= 1000"""
