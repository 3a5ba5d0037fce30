"""WARC archives: one gzip member per record, written and read back sequentially.

Writing: payload digests are compared in a table of (page_id, digest, size); of equal payloads
of at least ``min_revisit_bytes`` the smallest page_id is the response and the others are
revisit records without a payload. Tasks write archives of bounded size under names of
their own and list them in a manifest, so files of failed or repeated attempts are ignored.

Reading: ``Records`` walks a stream of compressed pieces, decompresses them step by step,
frames each block by its Content-Length and verifies block and payload digests.

Defined results: a null html is an empty payload; a null url leaves the target field out;
rows that repeat the smallest page_id are all responses; a null page_id is a response unless
another page with the same payload has an id. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.llm.common import table
from visitwise.llm.registry import query
from visitwise.sources.workspace import new_path, stage

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 16 * 1024 * 1024
PIECE = 64 * 1024
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


class BadArchive(ValueError):
    """The bytes do not hold whole, verified WARC records."""


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _fields(text: bytes) -> tuple[str, dict[str, str]]:
    # A byte that is not UTF-8 spoils its own field only.
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _needed(fields: dict[str, str], name: str) -> str:
    if name not in fields:
        raise BadArchive(f"a record has no {name}")
    return fields[name]


def _size(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise BadArchive(f"not a length: {text[:20]!r}")
    return int(text)


#: The digest algorithms that are verified; others are taken as they are.
ALGORITHMS = ("md5", "sha1", "sha256", "sha512")


def _hasher(declared: str):
    """The algorithm a digest field names, or None."""
    name = declared.partition(":")[0].strip().lower().replace("-", "")
    return hashlib.new(name) if name in ALGORITHMS else None


def _holds(declared: str, hasher) -> bool:
    """Whether the digest is the declared one, written in hexadecimal or base 32."""
    value, found = declared.partition(":")[2].strip(), hasher.digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _sha256(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit that leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = block.encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Block-Digest: {_sha256(block)}",
        f"WARC-Payload-Digest: {_sha256(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # Anything outside printable ASCII is percent-encoded, so a field stays one line.
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + END + block + END) + packer.flush()


class Records:
    """Sequential reader over pieces of one compressed archive."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces = iter(pieces)
        self.waiting = b""

    def _more(self) -> bool:
        if not self.waiting:
            self.waiting = next(self.pieces, b"")
        return bool(self.waiting)

    def _members(self) -> Iterator[Iterator[bytes]]:
        while self._more():
            yield self._inflate()

    def _inflate(self) -> Iterator[bytes]:
        """Decompressed pieces of the next gzip member."""
        member = zlib.decompressobj(31)
        while not member.eof:
            if not self._more():
                raise BadArchive("the archive ends inside a record")
            try:
                out = member.decompress(self.waiting, PIECE)
            except zlib.error as error:
                raise BadArchive(str(error)) from None
            self.waiting = member.unused_data if member.eof else member.unconsumed_tail
            if out:
                yield out

    def __iter__(self) -> Iterator[Record]:
        for member in self._members():
            yield self._record(member)

    def _record(self, member: Iterator[bytes]) -> Record:
        head = bytearray()
        while (cut := head.find(END)) < 0:
            piece = next(member, None)
            if piece is None:
                raise BadArchive("a record has no header")
            head += piece
        version, fields = _fields(bytes(head[:cut]))
        if not version.startswith("WARC/"):
            raise BadArchive(f"not a WARC record: {version[:20]!r}")
        _needed(fields, "warc-type")
        size = _size(_needed(fields, "content-length"))
        body = bytearray(head[cut + len(END) :])
        declared = fields.get("warc-block-digest", "")
        hasher = _hasher(declared)
        if hasher:
            hasher.update(body[:size])
        for piece in member:
            missing = size - len(body)
            if hasher and missing > 0:
                hasher.update(piece[:missing])
            body += piece
            if len(body) > size + len(END):
                break
        if len(body) != size + len(END) or body[size:] != END:
            raise BadArchive("a block does not have its Content-Length")
        if hasher and not _holds(declared, hasher):
            raise BadArchive("a block digest is wrong")
        record = Record(fields, bytes(body[:size]))
        if "application/http" in fields.get("content-type", ""):
            http, _, record.payload = record.block.partition(END)
            _, record.http = _fields(http)
            if fields["warc-type"] == "response":
                declared = fields.get("warc-payload-digest", "")
                hasher = _hasher(declared)
                if hasher:
                    hasher.update(record.payload)
                    if not _holds(declared, hasher):
                        raise BadArchive("a payload digest is wrong")
                if _size(record.http.get("content-length", str(len(record.payload)))) != len(record.payload):
                    raise BadArchive("a payload does not have its Content-Length")
        return record


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to: pages whose payload another page holds refer to it."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    ready = pages.select("page_id", "url", payload.alias("payload"))
    first = (
        ready.select("page_id", F.sha2("payload", 256).alias("_digest"), F.octet_length("payload").alias("_bytes"))
        .where(F.col("_bytes") >= min_bytes)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 AND _first IS NOT NULL")
        .drop("_n")
    )
    # Written out, so that the join knows the size of its small side; a large one is joined by shuffle.
    first = stage(first, "warc-first").withColumnRenamed("_digest", "_d")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    joined = ready.withColumn("_digest", F.sha2("payload", 256)).join(first, F.col("_digest") == F.col("_d"), "left")
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to) rows below ``folder``; the manifest (file, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64())})

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    ordered = records.select("page_id", "url", "payload", "refers_to")
    return stage(ordered.mapInArrow(write, "file string, records bigint"), "warc-manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Every record of the archives: file, page_id, url, record_type, refers_to, digest, size, payload, problem.

    An archive that cannot be read to its end gives its whole records and one row that names
    the problem. With a manifest, only listed files count, and a problem in one is an error.
    """
    schema = (
        "file string, page_id bigint, url string, record_type string, refers_to bigint, "
        "payload_digest string, payload_bytes bigint, payload binary, problem string"
    )
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in schema.split(", ")]

    def page_of(urn: str | None) -> int | None:
        found = (urn or "").strip("<>").rpartition(":")[2]
        return int(found) if found.isascii() and found.removeprefix("-").isdigit() else None

    def rows(file: str, content: memoryview) -> Iterator[tuple]:
        try:
            for record in Records(bytes(content[i : i + PIECE]) for i in range(0, len(content), PIECE)):
                fields = record.fields
                yield (
                    file,
                    page_of(fields.get("warc-record-id")),
                    urllib.parse.unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
                    fields["warc-type"],
                    page_of(fields.get("warc-refers-to")),
                    fields.get("warc-payload-digest", "").rpartition(":")[2],
                    _size(record.http.get("content-length", str(len(record.payload)))),
                    record.payload,
                    None,
                )
        except BadArchive as error:
            yield (file, *[None] * 7, str(error))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                held: list[tuple] = []
                size = 0
                for row in rows(path.as_py().rpartition("/")[2], memoryview(content.as_buffer())):
                    held.append(row)
                    size += len(row[7] or b"")
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    found = files.mapInArrow(read, schema)
    if manifest is None:
        return found
    listed = manifest.select(F.col("file").alias("_listed"))
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "problem")))
    return found.join(listed, F.col("file") == F.col("_listed"), "left_semi").withColumn("problem", checked)


ORACLE = f"""
WITH sized AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM sized),
first AS (
  SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f
  FROM digests)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM first
"""


@query("op4_warc", ORACLE)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    if manifest.isEmpty():
        return spark.createDataFrame(
            [], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
        )
    # The problem column is part of the filter so that a damaged archive fails the query.
    found = read_archives(spark, folder, manifest).where("problem IS NULL")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
