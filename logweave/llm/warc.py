"""WARC archives written and read through a chunked record table.

Writing: records become rows (record, chunk number, bytes) of at most ``SEGMENT`` bytes; a longer payload
is a ``response`` record and ``continuation`` records (segment number, origin, total length of the
blocks), so no record in an archive is larger than a segment. Every record has an id of its own. Blocks are
HTTP messages with chunked transfer coding whose chunks are cut inside any ``WARC/1.1`` of the payload, so
record starts are unmistakable: archives are written and read by Spark's text source with a record
separator, on any file system Spark knows, as one gzip stream a file or, with ``compression="none"``,
plain. Payloads that an earlier record holds are ``revisit`` records.

Reading: every archive row becomes a row (record, chunk number, bytes); a payload of one chunk is
digested on the spot, the chunks of longer ones are sorted by record and number and streamed
through one incremental digest. No step holds a whole oversized payload besides the
source row itself. Archives of others are read if they are WARC/1.1 and hold ``WARC/1.1`` and a line end only at
record starts: records of other types are passed over, plain and chunked bodies are understood, ids that are
not this writer's give a null page_id, a revisit's unstated length is null, and ``intact`` is null where no
SHA-256 in hexadecimal digits is stated.

Which record is the response is decided on digests alone (html is not shuffled for that), then
html is fetched for responses only.

Defined cases: null html is an empty payload; payloads under ``LEAST`` bytes are always responses;
rows that repeat both page_id and a payload of at least that size: one response, the rest
revisit it; null page_id is kept, and refers are to the smallest known id; null urls are left out;
line ends and a record start in urls are percent-encoded; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import drop_table, salted_left_join, write_table
from logweave.sources.shared import shared_folder

SEGMENT = 1 << 20
LEAST = 100
#: The tables hold no time of capture.
DATE = "1970-01-01T00:00:00Z"
#: Archives are split at this line when read. It occurs nowhere else: blocks and urls never hold it whole. It must not
#: begin with what a record ends with, or a match across two read buffers would be missed.
START = b"WARC/1.1\r\n"
END = "\r\n\r\n"
CHUNKS = "record string, page_id long, record_type string, refers_to long, chunk int, bytes long, digest string, payload_bytes long, payload_digest string, data binary"


def records_of(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, digest, bytes, html (short payloads only), record_type, refers_to: a row a record."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), F.when(F.octet_length(html) < least, html).alias("html"))
    long = rows.where(F.col("bytes") >= least)
    shared = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = salted_left_join(long, shared, "digest", F.col("page_id"))
    head = F.col("first_id").isNotNull() & (F.col("page_id") == F.col("first_id"))
    names = ["page_id", "url", "digest", "bytes", "html", "record_type", "refers_to"]
    kind = F.when(F.col("first_id").isNull(), "response").otherwise("revisit")
    others = met.where(~F.coalesce(head, F.lit(False))).withColumn("record_type", kind).withColumn("refers_to", F.col("first_id")).select(*names)
    heads = met.where(head).groupBy("page_id", "digest", "bytes").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n"))
    heads = heads.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("html", F.lit(None).cast("binary"))
    heads = heads.withColumn("record_type", F.when(F.col("copy") == 1, "response").otherwise("revisit")).withColumn("refers_to", F.when(F.col("copy") > 1, F.col("page_id"))).select(*names)
    short = rows.where(F.col("bytes") < least).withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")).select(*names)
    return others.unionByName(heads).unionByName(short)


def _header(fields: list[tuple[str, object]]) -> bytes:
    return START + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _chunked(data: bytes) -> bytes:
    """HTTP chunks of ``data``, cut so that no ``WARC/1.1`` is left in one piece."""
    cuts, at = [0], data.find(b"WARC/1.1")
    while at >= 0:
        cuts.append(at + 5)
        at = data.find(b"WARC/1.1", at + 5)
    parts = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts if p)


def record_name(page_id: int | None, tag: object, chunk: int = 0) -> str:
    """The id of a record; a page's id can be read from it."""
    return f"<urn:page:{'' if page_id is None else page_id}:{tag}{f':{chunk}' if chunk else ''}>"


def record_bytes(page_id: int | None, tag: object, url: str | None, digest: str, size: int, record_type: str, refers_to: int | None, chunk: int, chunks: int, data: bytes | None, before: int) -> tuple[bytes, int]:
    """The WARC record of one chunk without its closing empty lines, and the bytes of its page's blocks so far (``before``: of the chunks before)."""
    url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A").replace("WARC/1.1", "WARC%2F1.1")
    origin = record_name(page_id, tag)
    common = [("WARC-Record-ID", record_name(page_id, tag, chunk)), ("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", size)]
    if record_type == "revisit":
        refers = [("WARC-Refers-To", record_name(refers_to, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return _header([("WARC-Type", "revisit"), *common, *refers, ("Content-Length", 0)]), 0
    block = _chunked(data or b"")
    if chunk == 0:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + block
    if chunk == chunks - 1:
        block += b"0\r\n\r\n"
    upto = before + len(block)
    parts = [] if chunks == 1 else [("WARC-Segment-Number", chunk + 1)]
    if chunk:
        parts += [("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Total-Length", upto if chunk == chunks - 1 else None)]
    kind = [("WARC-Type", "continuation" if chunk else "response")]
    return _header([*kind, *common, *parts, ("Content-Type", None if chunk else "application/http; msgtype=response"), ("Content-Length", len(block))]) + block, upto


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, compression: str = "gzip") -> None:
    """Write the pages as WARC files under ``path``; every file is a run of whole records."""
    # The one response of a long payload is named by page and digest, so revisits can refer to it; others by a number.
    known = (F.col("record_type") == "response") & (F.col("bytes") >= least) & F.col("page_id").isNotNull()
    numbered = records_of(pages, least).withColumn("row", F.monotonically_increasing_id())
    named = numbered.withColumn("tag", F.when(known, F.col("digest")).otherwise(F.col("row").cast("string"))).drop("row")
    records, scratch = write_table(named, "records")
    # Html of responses only; rows that repeat (page_id, digest) fetch it once.
    html = pages.select(F.col("page_id").cast("long").alias("h_page"), F.col("html").cast("binary").alias("h_html")).where(F.octet_length("h_html") >= least).withColumn("h_digest", F.sha2("h_html", 256))
    wanted = records.where((F.col("record_type") == "response") & (F.col("bytes") >= least)).drop("html")
    # The window asks for the partitioning and the order that the join leaves, so html is dealt out once.
    met = wanted.join(html, (F.col("page_id") == F.col("h_page")) & (F.col("digest") == F.col("h_digest")))
    first = Window.partitionBy("page_id", "digest").orderBy("page_id")
    once = met.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "h_page", "h_digest").withColumnRenamed("h_html", "html")
    unnamed = html.where(F.col("h_page").isNull()).groupBy("h_digest").agg(F.first("h_html").alias("html"))
    nameless = wanted.where(F.col("page_id").isNull()).join(unnamed, F.col("digest") == F.col("h_digest")).drop("h_digest")
    rest = records.where((F.col("record_type") == "revisit") | (F.col("bytes") < least))
    rows = once.unionByName(nameless).unionByName(rest)
    # Rows (record, chunk number, bytes): what leaves the JVM is never longer than a segment. Chunks of a record stay in order.
    count = F.greatest(F.ceil(F.octet_length("html") / segment), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(F.col("html"), k * segment + 1, F.lit(segment)))
    facts = ["page_id", "tag", "url", "digest", "bytes", "record_type", "refers_to"]
    pieces = F.when(F.col("html").isNull(), F.array(F.lit(None).cast("binary"))).otherwise(cut)
    dealt = rows.select(*facts, F.coalesce(count, F.lit(1)).alias("chunks"), F.posexplode(pieces).alias("chunk", "data")).select(*facts, "chunk", "chunks", "data")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, upto = [], 0, 0
        for b in batches:
            for row in zip(*b.columns, strict=True):
                fields = [x.as_py() for x in row]
                record, upto = record_bytes(*fields, upto if fields[7] else 0)
                held.append(record)
                size += len(record)
                if size > 4 * segment:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    made = dealt.mapInArrow(make, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", END).option("compression", compression).text(path)
    drop_table(pages.sparkSession, scratch)


def _dechunk(block: bytes) -> bytes:
    out, at = [], 0
    while at < len(block):
        end = block.index(b"\r\n", at)
        size = int(block[at:end], 16)
        if size == 0:
            break
        out.append(block[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def parse_record(row: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields (lower-case names) and payload part of one archive row; None for an empty row.

    A continuation's block goes on in its response's transfer coding, which its own fields cannot tell: chunked where it
    states ``X-Payload-Length`` (this writer's), else plain.
    """
    if not row.strip():
        return None
    at = row.index(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in row[:at].decode("utf-8", "replace").split("\r\n"))}
    block = row[at + 4 : at + 4 + int(fields["content-length"])]
    chunked = fields.get("warc-type") == "continuation" and "x-payload-length" in fields
    if block.startswith(b"HTTP/") and fields.get("warc-type") in ("response", "revisit"):
        head, _, block = block.partition(b"\r\n\r\n")
        chunked = any(x.lower().startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(b"\r\n"))
    return fields, _dechunk(block) if chunked else block


def _page(name: str | None) -> int | None:
    """The page id in a ``record_name``; None for other ids."""
    got = re.fullmatch(r"<urn:page:(-?\d+):[^>]*>", name or "")
    return int(got[1]) if got else None


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table: a row for each record or segment; data only for payloads of several chunks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ["record", "page_id", "record_type", "refers_to", "chunk", "bytes", "digest", "payload_bytes", "payload_digest", "data"]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            rows, size = [], 0
            for value in b.column(0):
                got = parse_record(value.as_py())
                if got is None or got[0].get("warc-type") not in ("response", "revisit", "continuation"):
                    continue
                f, data = got
                alone = "warc-segment-number" not in f
                kind = "response" if f["warc-type"] == "continuation" else f["warc-type"]
                origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                stated = f.get("warc-payload-digest", "")
                stated = stated[7:].lower() if re.fullmatch(r"(?i)sha256:[0-9a-f]{64}", stated) else None
                length = int(f["x-payload-length"]) if "x-payload-length" in f else None
                digest = hashlib.sha256(data).hexdigest() if alone else None
                rows.append((origin, _page(origin), kind, _page(f.get("warc-refers-to")), int(f.get("warc-segment-number", 1)) - 1, len(data), digest, length, stated, None if alone else data))
                size += 0 if alone else len(data)
                if size > 4 * SEGMENT:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    text = spark.read.option("lineSep", START.decode()).text(path)
    return text.select(F.col("value").cast("binary").alias("value")).mapInArrow(parse, CHUNKS)


def whole_records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact: chunks of long payloads run through one digest."""
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    alone = chunks.where(F.col("data").isNull())
    revisit = F.col("record_type") == "revisit"
    right = (F.col("digest") == F.col("payload_digest")) & F.coalesce(F.col("bytes") == F.col("payload_bytes"), F.lit(True))
    single = alone.select("page_id", F.when(revisit, F.col("payload_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.col("payload_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to", (revisit | right).alias("intact"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size, current = hashlib.sha256(), 0, None
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]

        def done(first: tuple) -> tuple:
            _, page, declared, wanted = first
            got = state.hexdigest()
            return page, size, got, "response", None, None if wanted is None else got == wanted and declared in (None, size)

        for b in batches:
            rows = []
            for *first, data in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("record", "page_id", "payload_bytes", "payload_digest", "data")), strict=True):
                if current is None or first[0] != current[0]:
                    if current is not None:
                        rows.append(done(current))
                    state, size, current = hashlib.sha256(), 0, tuple(first)
                state.update(data)
                size += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(current), types, strict=True)], names)

    parts = chunks.where(F.col("data").isNotNull()).repartition("record").sortWithinPartitions("record", "chunk")
    return single.unionByName(parts.mapInArrow(digest, out))


def archive_round_trip(pages: DataFrame, least: int = LEAST, segment: int = SEGMENT) -> DataFrame:
    """Write the pages as archives in the shared folder, read these back and return a row a record."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least, segment)
    chunks, _ = write_table(read_chunks(spark, path), "chunks")
    drop_table(spark, path)
    return whole_records(chunks)
