"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bitset
from .common import col, cut, new_path

#: Fixed by the WARC format.
VERSION, GZIP_MAGIC = b"WARC/1.1", b"\x1f\x8b\x08"
START, ANY_START = re.compile(rb"WARC/1\.[01]\r\n"), re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
DATE = "1970-01-01T00:00:00Z"  # the tables carry no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 32 << 20
FILTER_BITS = 1 << 26
CHUNK = 1 << 20  # compressed bytes that are read at a time


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(headers: dict[str, str], block: bytes, compress: bool = False) -> bytes:
    """One record; compressed, a gzip member of its own."""
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in (headers | {"Content-Length": str(len(block))}).items())]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return record
    z = zlib.compressobj(wbits=31)
    return z.compress(record) + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Bytes that no valid record covers."""

    offset: int
    length: int
    reason: str


class _Archive:
    """Records at given places of some bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.blank = data, -1

    def parse(self, at: int) -> tuple[Record, int] | str:
        """The record at this place and where it ends, or what is wrong there."""
        data = self.data
        if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
            return "no version line"
        # Headers may be of any length. The blank line that was found last is still the next one as long as it lies ahead.
        if self.blank < at:
            self.blank = data.find(b"\r\n\r\n", at)
            if self.blank < 0:
                self.blank = len(data)
        end = self.blank
        if end == len(data):
            return "header without end"
        headers: dict[str, str] = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, colon, value = line.partition(b":")
            if not colon or not re.fullmatch(rb"[!#-'*+.0-9A-Z^-z|~-]+", name):
                return "malformed header"
            headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            return "no content length"
        start = end + 4
        stop = start + int(size)
        if data[stop : stop + 4] != b"\r\n\r\n":
            return "record cut short or of wrong length"
        block = data[start:stop]
        digest = headers.get("warc-block-digest", "")
        if digest.startswith("sha1:") and digest[5:] != payload_digest(block):
            return "block digest differs"
        return Record(at, headers, block), stop + 4

    def member(self, at: int) -> tuple[bytes, int] | str:
        """What the gzip member at this place holds and where it ends. It is read in pieces, so members cost what they are long."""
        z, out, view, fed = zlib.decompressobj(wbits=31), [], memoryview(self.data), at
        try:
            while not z.eof and fed < len(view):
                out.append(z.decompress(view[fed : fed + CHUNK]))
                fed = min(len(view), fed + CHUNK)
        except zlib.error:
            return "damaged member"
        return (b"".join(out), fed - len(z.unused_data)) if z.eof else "member cut short"


def _plain(data: bytes) -> Iterator[Record | Gap]:
    """The records of an archive or a member, none of them compressed, and gaps."""
    archive, at, gap, why = _Archive(data), 0, None, ""
    while at < len(data):
        found = archive.parse(at)
        if not isinstance(found, str):
            if gap is not None:
                yield Gap(gap, at - gap, why)
                gap = None
            yield found[0]
            at = found[1]
            continue
        if gap is None:
            gap, why = at, found
        following = START.search(data, at + 1)
        at = following.start() if following else len(data)
    if gap is not None:
        yield Gap(gap, len(data) - gap, why)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records of an archive, compressed by member, as a whole or not, in order, and the gaps between them.

    Where a check fails (magic, version line, header, length, block digest, gzip checksum), the next
    member or version line is searched for that starts a valid record; the bytes up to there are a
    gap, with the reason of the failure at its start. A sound member may hold any number of records,
    which have its offset; a gap within it is told as such, its length being that of the bytes in it.
    """
    archive, at, gap, why = _Archive(data), 0, None, ""
    while at < len(data):
        packed = data[at : at + 3] == GZIP_MAGIC
        found = archive.member(at) if packed else archive.parse(at)
        if packed and not isinstance(found, str):
            inner = list(_plain(found[0]))
            if not any(isinstance(x, Record) for x in inner):
                found = inner[0].reason if inner else "empty member"
        if not isinstance(found, str):
            if gap is not None:
                yield Gap(gap, at - gap, why)
                gap = None
            if packed:
                yield from (Record(at, x.headers, x.block) if isinstance(x, Record) else Gap(at, x.length, f"{x.reason}, in a member") for x in inner)
            else:
                yield found[0]
            at = found[1]
            continue
        if gap is None:
            gap, why = at, found
        following = ANY_START.search(data, at + 1)
        at = following.start() if following else len(data)
    if gap is not None:
        yield Gap(gap, len(data) - gap, why)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row of pages into uncompressed archives below path.

    The payload is the html in UTF-8, null being empty. Of payloads of at least min_revisit_bytes
    bytes that are equal, the rows with the smallest id are responses, all others revisit them;
    smaller payloads are always responses.

    Spark's text writer puts the records' bytes down as they are, each ended by the blank lines that
    end a WARC record, so archives appear by Spark's commit protocol on any file system. A task begins
    another archive when the last has archive_bytes. Payloads are told apart by digest: groups of equal
    ones are aggregated partially, rows of other payloads take no part in any join, and of the groups
    only one payload each is shuffled, that of the response.
    """
    payload = F.coalesce(col(html_col), F.lit("")).cast("binary")
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.length("payload"))
    groups = rows.filter(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = cut(groups.select("sha", "first", F.lit(True).alias("shared")), "payloads")
    at_sha, at_row = (F.pmod(F.xxhash64(*c), F.lit(FILTER_BITS)) for c in (["sha"], ["sha", "id"]))
    many = bitset.build(groups, at_sha, FILTER_BITS)
    looked = rows.filter(bitset.has(many, at_sha)).select("id", "url", "sha", "size").join(groups, "sha", "left")
    looked = cut(looked.withColumn("revisit", F.col("shared").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))), "looked")
    stays = looked.filter("NOT revisit").select("sha", "id").distinct()
    whole = bitset.build(stays, at_row, FILTER_BITS)
    kept = stays.select(F.col("sha").alias("_sha"), F.col("id").alias("_id"))
    responses = rows.filter(bitset.has(many, at_sha) & bitset.has(whole, at_row)).join(kept, (F.col("sha") == F.col("_sha")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    responses = rows.filter(~bitset.has(many, at_sha)).unionByName(responses).select("id", "url", "sha", "size", F.lit(None).cast(pages.schema[id_col].dataType).alias("refers"), F.lit(False).alias("revisit"), "payload")
    rows = responses.union(looked.filter("revisit").select("id", "url", "sha", "size", F.col("first").alias("refers"), "revisit", F.lit(None).cast("binary")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, archive, filled = TaskContext.get().partitionId(), 0, 0
        for pdf in batches:
            out, where, size = [], [], 0
            for r in pdf.itertuples(index=False):
                # A null id, or a null to refer to, has no header; integers may come as floats beside nulls.
                block = b"" if r.revisit else bytes(r.payload)
                target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r.url) if r.url else None
                headers = {
                    "WARC-Type": "revisit" if r.revisit else "response",
                    "WARC-Date": DATE,
                    "WARC-Target-URI": target,
                    "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes(r.sha)).decode()}",
                    "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
                    "WARC-Profile": PROFILE if r.revisit else None,
                    "X-Page-Id": None if pd.isna(r.id) else r.id,
                    "X-Refers-To-Page-Id": None if pd.isna(r.refers) else r.refers,
                    "X-Payload-Length": r.size,
                }
                headers["WARC-Record-ID"] = f"<urn:sha1:{hashlib.sha1(repr(headers).encode()).hexdigest()}>"
                record = frame({k: str(v) for k, v in headers.items() if v is not None}, block)[:-4]
                if filled and filled + len(record) + 4 > archive_bytes:
                    archive, filled = archive + 1, 0
                filled, size = filled + len(record) + 4, size + len(record)
                out.append(record)
                where.append(f"{task:06d}-{archive:06d}")
                if size > 4 << 20:
                    yield pd.DataFrame({"record": out, "archive": where})
                    out, where, size = [], [], 0
            yield pd.DataFrame({"record": out, "archive": where})

    ids = [F.col(c).cast("string").alias(c) for c in ("id", "refers")]
    records = rows.select(*ids, "url", "sha", "size", "revisit", "payload").mapInPandas(run, "record binary, archive string")
    # The cast keeps bytes as they are; the line separator is what ends a record. A folder for each archive holds one file.
    records.select(F.col("record").cast("string").alias("value"), "archive").write.option("lineSep", "\r\n\r\n").partitionBy("archive").text(path)


def read_archives(df: DataFrame) -> DataFrame:
    """Records and gaps of archives, given as rows with path and content (as the binaryFile source gives them).

    One row per record: path, offset, length null, reason null, type, headers, block; one row per gap:
    path, offset, length, reason, all else null.
    """
    schema = "path string, offset long, length long, reason string, type string, headers map<string,string>, block binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                some, size = [], 0
                for x in salvage(bytes(content) if content is not None else b""):
                    some.append((path, x.offset, None, None, x.headers.get("warc-type"), x.headers, x.block) if isinstance(x, Record) else (path, x.offset, x.length, x.reason, None, None, None))
                    if (size := size + (len(x.block) if isinstance(x, Record) else 0)) > 4 << 20 or len(some) >= 2000:
                        yield _frame(some)
                        some, size = [], 0
                yield _frame(some)

    def _frame(some: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(some, columns=["path", "offset", "length", "reason", "type", "headers", "block"]).astype({"length": "Int64"})

    return df.select("path", "content").mapInPandas(run, schema)


def round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes pages as archives, reads them back, and returns one row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Nulls: a null html is an empty payload, a null url has no target header. A row with a null id
    takes part in its group of equal payloads as the last of all; if all ids of a group are null, all
    are responses. Rows with equal ids and payloads are responses or revisits together. An empty
    table gives no rows; other columns of pages are ignored. Gaps are an error here, as the archives are new.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, **columns)
    found = read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path))
    h = lambda name: F.element_at("headers", name)
    fine = F.when(F.col("reason").isNull(), h("x-page-id")).otherwise(F.raise_error(F.concat(F.lit("gap in new archive "), "path")))
    digest = F.regexp_replace(h("warc-payload-digest"), "^sha1:", "")
    return found.select(fine.cast("long").alias("page_id"), h("x-payload-length").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), h("x-refers-to-page-id").cast("long").alias("refers_to"), h("warc-target-uri").alias("url"))
