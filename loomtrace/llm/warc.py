"""WARC archives: written one gzip member per record, read back by a splittable reader.

Reading. Spark's text source, told that lines end in the three bytes that begin a gzip member,
is a scan of byte ranges: each task searches its own range for these bytes and owns what starts
inside it, reading on over the end of its range. The bytes also occur by chance, and inside
payloads that are gzip files themselves. So each place is only a candidate: it is a member if
its header can be decoded and what it inflates to begins a WARC record. A member that has not
come to its end at the next candidate runs on through it.

A task cannot know whether a record of the range before reaches into its own. That task does
know, as its last member is not complete at the end of its range. Files with such a member
(few, as a false candidate must fall on the border) are read again, each in order as one stream.

Writing. The text source also writes: a row is the member's bytes, and what ends a row is an
empty gzip member, so that the file is nothing but members. Files thus go through Spark's own
committed writer to any file system.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import map_batches, new_folder, saved, table

# The bytes that begin a gzip member, those that begin a record, and a member without content.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
EMPTY_MEMBER = MAGIC + bytes(6) + b"\x03" + b"\x03" + bytes(9)

# Fixed value: the name of this kind of revisit in the WARC standard.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_BYTES = "ISO-8859-1"  # a character for each byte
_GZIP = 31  # zlib's number for the gzip format
_BATCH_BYTES = 16 << 20

RECORD = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, digest_ok boolean"
)
_PLACED = f"file string, block long, unfinished boolean, {RECORD}"


# ---- Writing

def with_revisits(captures: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``captures`` (key, target_uri, payload) with payload_digest, record_type and refers_to, refers_to_uri.

    Of captures with equal payloads of at least ``min_bytes``, that with the largest key is a
    response and the others revisit it; all smaller ones are responses. Rows that share the
    largest key are all responses, as a record cannot revisit itself; a null key is less than any
    other, and null keys alone are responses. Payloads are equal if their SHA-256 and length are;
    only these are shuffled, unless the repeated payloads are too many to be sent to all tasks.
    """
    sized = captures.select(
        "key", "target_uri", F.coalesce("payload", F.lit(b"")).alias("payload"),
    ).withColumns({"_name": F.sha2("payload", 256), "_length": F.octet_length("payload")})
    again = sized.where(F.col("_length") >= min_bytes).groupBy("_name", "_length").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("key", "target_uri")).alias("last"),
    ).where("n > 1 AND last.key IS NOT NULL").select("_name", "_length", "last")
    again = saved(again, "warc-again")
    revisits = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last.key"))
    return sized.join(again, ["_name", "_length"], "left").select(
        "key", "target_uri", "payload", F.sha1("payload").alias("payload_digest"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("last.key")).alias("refers_to"),
        F.when(revisits, F.col("last.target_uri")).alias("refers_to_uri"),
    )


def _uri(text: str | None) -> str:
    """A URI that fits on a header line; what must not stand in one is percent-encoded."""
    return quote(text or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")


def member(record_id: str, record_type: str, uri: str | None, date: str, payload: bytes, digest: str,
           refers_to: str | None = None, refers_to_uri: str | None = None) -> bytes:
    """A gzip member with one record; a revisit has the HTTP header but not the payload."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if record_type == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(uri)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if record_type == "revisit":
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{refers_to}>",
                  f"WARC-Refers-To-Target-URI: {_uri(refers_to_uri)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    return packer.compress("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def write_warc(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``records`` as archives below ``folder``, one file a task.

    Columns: record_id, record_type, target_uri, payload, payload_digest (SHA-1 in hexadecimal),
    refers_to, refers_to_uri. An empty table gives a folder without records.
    """
    def pack(cols: dict[str, list]) -> dict[str, list]:
        rows = zip(*(cols[c] for c in names), strict=True)
        return {"member": [member(i, kind, uri, date, body, digest, to, to_uri)
                           for i, kind, uri, body, digest, to, to_uri in rows]}

    names = ["record_id", "record_type", "target_uri", "payload", "payload_digest", "refers_to", "refers_to_uri"]
    packed = map_batches(records.select(*names), pack, "member binary")
    (packed.select(F.col("member").cast("string").alias("value")).write.mode("overwrite")
     .option("encoding", _BYTES).option("lineSep", EMPTY_MEMBER.decode(_BYTES)).text(folder))


# ---- Reading

class Members:
    """Members among the candidates of one byte stream, given in order by ``add``."""

    def __init__(self):
        self.held: list[bytes] = []  # the candidates of the open member
        self.content = bytearray()
        self.unpack = None

    @property
    def unfinished(self) -> bool:
        return self.unpack is not None

    def _feed(self, part: bytes) -> bool:
        """Inflate one more candidate of the open member; False if that shows that it is no record."""
        if self.unpack is None:
            self.unpack, self.held, self.content = zlib.decompressobj(_GZIP), [], bytearray()
        self.held.append(part)
        try:
            self.content += self.unpack.decompress(part)
        except zlib.error:
            return False
        return VERSION.startswith(bytes(self.content[:len(VERSION)]))

    def add(self, candidate: bytes) -> Iterator[bytes]:
        """The inflated content of each record that is complete with this candidate."""
        waiting = [candidate]
        while waiting:
            good = self._feed(waiting.pop())
            if good and not self.unpack.eof:
                continue
            if good and self.content:
                yield bytes(self.content)
            elif not good:
                # The first was no record; the others, taken for its inside, are candidates again.
                waiting += reversed(self.held[1:])
            self.unpack = None


def _headers(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; lines that begin with white space go on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _hexadecimal(digest: str | None) -> str | None:
    """A sha1 header value (base 32 or hexadecimal, with or without its label) as lower-case hexadecimal."""
    bare = (digest or "").split(":", 1)[-1].strip()
    if len(bare) == 32:
        try:
            return base64.b32decode(bare.upper()).hex()
        except ValueError:
            return None
    return bare.lower() or None


def parse(content: bytes) -> dict | None:
    """The fields of RECORD of an inflated member; None if it is not a record."""
    head, found, rest = content.partition(b"\r\n\r\n")
    if not found:
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = _headers(lines[1:])
    length = fields.get("content-length", "")
    block = rest[:int(length)] if length.isdigit() else rest
    kind = fields.get("warc-type")
    payload, size = block, len(block)
    if "application/http" in fields.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = _headers(http.decode("latin-1").split("\r\n")[1:]).get("content-length", "")
        size = int(stated) if kind == "revisit" and stated.isdigit() else len(payload)
    digest = _hexadecimal(fields.get("warc-payload-digest"))
    own = None if kind == "revisit" else hashlib.sha1(payload).hexdigest()
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>") or None, "record_type": kind,
        "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": own or digest, "payload_bytes": size,
        "payload": None if kind == "revisit" else payload,
        "digest_ok": None if own is None or digest is None else own == digest,
    }


def _rows(batches: Iterable[pa.RecordBatch], by_block: bool) -> Iterator[dict]:
    """Records, and a row with ``unfinished`` for each range that ends inside a member."""
    at, members, first = None, Members(), False

    def end() -> Iterator[dict]:
        if at is not None and members.unfinished:
            yield {"file": at[0], "block": at[1], "unfinished": True}

    for batch in batches:
        for line, file, block in zip(*(batch.column(c).to_pylist() for c in ("line", "file", "block")), strict=True):
            here = (file, block if by_block else 0)
            if here != at:
                yield from end()
                at, members, first = here, Members(), block == 0
            if first:  # what stands before the first magic of the file
                first = False
                continue
            for content in members.add(MAGIC + line):
                record = parse(content)
                if record is not None:
                    yield record | {"file": file, "block": block, "unfinished": False}
    yield from end()


def _decoded(lines: DataFrame, by_block: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_PLACED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in _rows(batches, by_block):
            held.append(row)
            size += 1000 + len(row.get("payload") or b"")
            if size > _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return lines.mapInArrow(run, _PLACED)


def _candidates(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """What follows each magic, with its file and the start of the byte range that owns it."""
    return (
        spark.read.schema("value string").option("encoding", _BYTES).option("lineSep", MAGIC.decode(_BYTES)).text(paths)
        .select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"))
    )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives in ``folder``: RECORD, one row each.

    ``payload_digest`` is the SHA-1 of the payload in hexadecimal, that of the header for
    revisits, whose ``payload_bytes`` is the length that their HTTP header states and whose
    payload is null. ``digest_ok`` tells whether payload and header agree (null if one is
    missing). Members that are not WARC records, damaged members and an incomplete last member
    give no row. Names must not end in .gz, as Hadoop would inflate such files itself; a record
    must fit into memory. A folder without records gives no row.
    """
    placed = saved(_decoded(_candidates(spark, folder), by_block=True), "warc-records")
    # As many names as files at most, which the driver has listed for the scan.
    again = [r["file"] for r in placed.where("unfinished").select("file").distinct().collect()]
    names = [c.strip().split(" ")[0] for c in RECORD.split(",")]
    if not again:
        return placed.where("NOT unfinished").select(*names)
    streams = (
        _candidates(spark, again).withColumn("place", F.monotonically_increasing_id())
        .repartition("file").sortWithinPartitions("file", "block", "place")
    )
    whole = _decoded(streams, by_block=False).where("NOT unfinished")
    marks = spark.createDataFrame([(f,) for f in again], "file string")
    return placed.where("NOT unfinished").join(marks, "file", "left_anti").select(*names).unionByName(
        whole.select(*names))


# ---- The query

_PAGE = "urn:page:"


def _page_of(record_id: Column) -> Column:
    return F.nullif(F.substring(record_id, len(_PAGE) + 1, 20), F.lit("")).cast("long")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record: written to archives and read back."""
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("long").alias("key"), F.col("url").cast("string").alias("target_uri"),
        F.col("html").cast("string").cast("binary").alias("payload"),
    )
    records = with_revisits(pages).withColumns({
        "record_id": F.concat(F.lit(_PAGE), F.coalesce(F.col("key").cast("string"), F.lit(""))),
        "refers_to": F.concat(F.lit(_PAGE), F.col("refers_to").cast("string")),
    })
    folder = new_folder(spark, "warc-archives")
    write_warc(records, folder)
    return read_warc(spark, folder).select(
        _page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _page_of(F.col("refers_to")).alias("refers_to"), "target_uri", "digest_ok",
    )


ORACLE_SQL = """
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest,
           strlen(coalesce(html, '')) AS n
    FROM pages
), last AS (
    SELECT html, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY html
)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN response IS NULL OR response IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response IS DISTINCT FROM p.page_id THEN response END AS refers_to,
       p.url AS target_uri,
       CASE WHEN response IS NULL OR response IS NOT DISTINCT FROM p.page_id THEN true END AS digest_ok
FROM p LEFT JOIN last ON p.html = last.html AND p.n >= 1000
"""
