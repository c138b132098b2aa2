"""WARC archives: writing, a normaliser for monolithic gzip, and reading by index.

``write_archives`` writes records as one gzip stream a file, with Spark's own
writer.  ``normalise`` inflates each such stream once, rewrites every record as
a gzip member of its own, and writes a sidecar index of offsets.
``read_archives`` opens members by the index.  Files are opened through
pyarrow's file systems by the URI of the shared folder; each attempt of a task
writes files of its own name, and only those that a finished task has listed
are read, so a lost executor costs a repeated task and no record.

Equal payloads of ``LEAST`` bytes or more are stored once: the record with the
least page id is a response, others are revisits that refer to it.  Rows that
repeat that least id are responses too.  A null payload is empty; a null id or
url is left out; a null id revisits like any other, and payloads that only null
ids have are all responses.  An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.common import BROADCAST_ROWS, map_batches, release, scratch, scratch_path, small_batches

LEAST = 100
LEVEL = 1
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_CRLF = "\r\n"


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to), the last null for responses.

    Digests that occur more than once, with their first id, are found on digests
    and ids alone.  If they are few enough they are broadcast, and no payload is
    shuffled; else payloads meet them by digest, those of no repeated digest
    dealt evenly, those of a very common one by broadcast.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    again = p.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("em_n")).filter("em_n > 1 and first_id is not null")
    again = scratch(again, "repeated")
    if again.count() <= BROADCAST_ROWS:
        joined = p.join(F.broadcast(again), "digest", "left")
    else:
        hot = again.orderBy(F.desc("em_n"), "digest").limit(BROADCAST_ROWS)
        first = p.join(F.broadcast(hot), "digest", "left")
        rest = again.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select(F.col("digest").alias("em_digest"), F.col("first_id").alias("em_first"))
        spread = F.when(F.col("first_id").isNull() & (F.col("size") >= least), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
        joined = first.withColumn("em_key", spread).join(rest.hint("merge"), F.col("em_key") == F.col("em_digest"), "left").withColumn("first_id", F.coalesce("first_id", "em_first"))
    repeats = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "size", "digest", F.when(repeats, F.col("first_id")).alias("refers_to"))


def record(date: str = "1970-01-01T00:00:00Z") -> Column:
    """The text of a WARC record without its last line feed, from the columns of ``decide``."""
    clean = F.regexp_replace("url", r"[\r\n]", "")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(_CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("size").cast("string"), F.lit(_CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(f"WARC/1.0{_CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(_CRLF),
        F.coalesce(F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.url_encode(F.col("page_id").cast("string")), F.lit(f">{_CRLF}")), F.lit("")),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), clean, F.lit(_CRLF)), F.lit("")),
        F.lit(f"WARC-Date: {date}{_CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(_CRLF),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{_CRLF}WARC-Refers-To: <urn:page:"), F.url_encode(F.col("refers_to").cast("string")), F.lit(f">{_CRLF}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), length.cast("string"), F.lit(_CRLF * 2),
    )
    return F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n\r"))


def write_archives(decided: DataFrame, path: str) -> None:
    """One gzip stream a file; the writer's line feed ends each record."""
    decided.select(record().alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def opened(uri: str):
    """(file system, path) of a URI as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of one or more gzip members, at most a few MB at a time."""
    d = zlib.decompressobj(31)
    for c in chunks:
        while c:
            yield d.decompress(c, 4 << 20)
            if d.eof:
                c, d = d.unused_data, zlib.decompressobj(31)
            else:
                c = d.unconsumed_tail


def records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; an incomplete one raises ValueError."""
    buf, at = bytearray(), 0
    need = None
    for p in pieces:
        buf += p
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                m = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", bytes(buf[at : end + 2]))
                if not m:
                    raise ValueError("a record has no Content-Length")
                need = end + 4 - at + int(m[1]) + 4
            if len(buf) - at < need:
                break
            yield bytes(buf[at : at + need])
            at, need = at + need, None
        if at > CHUNK:
            del buf[:at]
            at = 0
    if bytes(buf[at:]).strip():
        raise ValueError("the stream ends within a record")


def headers(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields, in lower case, and the block."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split(_CRLF)[1:])}
    return fields, rest[: int(fields["content-length"])]


def normalise_file(uri: str, out_dir: str) -> tuple[str, str, int]:
    """Rewrite one archive; (archive, index, records).  The index has a line for each record: offset, length, type, id."""
    source, path = opened(uri)
    target, base = opened(out_dir)
    target.create_dir(base, recursive=True)
    name = f"{base}/{uuid.uuid4().hex}.warc.gz"
    offset, n = 0, 0
    with source.open_input_stream(path, compression=None) as f, target.open_output_stream(name, compression=None) as out, target.open_output_stream(f"{name}.idx", compression=None) as idx:
        for rec in records(inflate(iter(lambda: f.read(CHUNK), b""))):
            c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = c.compress(rec) + c.flush()
            fields, _ = headers(rec)
            out.write(member)
            idx.write(f"{offset}\t{len(member)}\t{fields.get('warc-type', '')}\t{fields.get('warc-record-id', '')}\n".encode())
            offset += len(member)
            n += 1
    scheme = out_dir[: len(out_dir) - len(base)] if out_dir.endswith(base) else ""
    return scheme + name, scheme + name + ".idx", n


def normalise(spark: SparkSession, in_dir: str, out_dir: str) -> DataFrame:
    """(archive, index, records) of the rewritten files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(in_dir).select("path")

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                a, i, n = normalise_file(uri, out_dir)
                yield {"archive": [a], "index": [i], "records": [n]}

    return scratch(map_batches(files, run, "archive string, index string, records long"), "archives")


def read_archives(archives: DataFrame, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of all members; a wrong digest raises ValueError.

    Ids are given back as ``id_type``.  Every payload is read and held against its digest; without ``payloads`` the column is null.
    """
    page = lambda v: unquote_plus(m[1]) if v and (m := re.fullmatch(r"<urn:page:(.*)>", v)) else None

    def run(batches):
        for b in batches:
            for archive, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = opened(archive)
                at_fs, at = opened(index)
                rows: list[tuple] = []
                size = 0
                with at_fs.open_input_stream(at, compression=None) as idx, fs.open_input_file(path) as f:
                    for line in idx.read().decode().splitlines():
                        offset, length, kind, _ = line.split("\t")
                        fields, block = headers(zlib.decompress(f.read_at(int(length), int(offset)), 31))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{archive} at {offset}: the payload isn't that of the digest")
                        full = int(re.search(rb"(?i)Content-Length:[ \t]*(\d+)", http)[1])
                        rows.append((page(fields.get("warc-record-id")), full, digest, kind, page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), payload if payloads and kind == "response" else None))
                        size += len(payload) if payloads else 256
                        if size > 8 << 20:
                            yield emit(rows)
                            rows, size = [], 0
                if rows:
                    yield emit(rows)

    def emit(rows):
        return dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"), map(list, zip(*rows, strict=True)), strict=True))

    # the list of archives is small, so its partitions would be joined into one: ask for one an archive
    dealt = archives.select("archive", "index").repartition(max(1, archives.count()), "archive")
    rows = map_batches(dealt, run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write, normalise and read back all pages."""
    spark = pages.sparkSession
    small_batches(spark)
    whole, members = scratch_path(spark, "monolithic"), scratch_path(spark, "members")
    write_archives(decide(pages, least), whole)
    release(spark)
    return read_archives(normalise(spark, whole, members), payloads=False, id_type=pages.schema["page_id"].dataType.simpleString())
