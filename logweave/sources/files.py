"""Files, streams of lines and in-memory lines as numbered lines: source_id, seq, raw."""

from __future__ import annotations

import json
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import count, islice
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.detect import detect_format, looks_like_array
from logweave.operators.order import numbered_lines
from logweave.sources.shared import shared_folder

PROBE_BYTES = 16 * 1024
PROBE_LINES = 64
ARRAY_BYTES = 64 << 20
#: Lines of standard input that the driver holds at a time.
SPOOL_LINES = 200_000
#: Bytes of spooled lines in a row group, which the driver holds, and in a file, of which one at a time is on its disk.
SPOOL_GROUP, SPOOL_FILE = 8 << 20, 64 << 20
LINES = "source_id int, seq long, raw string"
SPOOLED = pa.schema([("source_id", pa.int32()), ("seq", pa.int64()), ("raw", pa.string())])
GZIP, ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
SUFFIXES = {"gzip": ".gz", "zstd": ".zst"}


def compression_of(head: bytes) -> str | None:
    """By the first bytes, whatever the name says; only the outer layer."""
    return "gzip" if head.startswith(GZIP) else "zstd" if head.startswith(ZSTD) else None


def head_of(spark: SparkSession, path: str, size: int = PROBE_BYTES) -> bytes:
    """The first bytes of a file on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(target).isDirectory():
        inner = sorted(str(s.getPath().toString()) for s in fs.listStatus(target) if not s.getPath().getName().startswith(("_", ".")))
        return head_of(spark, inner[0], size) if inner else b""
    stream = fs.open(target)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def unpacked_head(head: bytes) -> bytes:
    """What a compressed head holds, as far as it goes."""
    kind = compression_of(head)
    try:
        if kind == "gzip":
            return zlib.decompressobj(wbits=31).decompress(head, PROBE_BYTES)
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(head)[:PROBE_BYTES]
    except Exception:
        return b""
    return head


def probe_format(spark: SparkSession, paths: list[str]) -> str | None:
    """The format of the first file that is not standard input, from one bounded read (compressed files are unpacked first)."""
    path = next((p for p in paths if p != "-"), None)
    if path is None:
        return None
    head = unpacked_head(head_of(spark, path))
    if not head:
        return None
    if looks_like_array(head):
        return "ndjson"
    return detect_format(x.removesuffix(b"\r") for x in head.split(b"\n")[:PROBE_LINES])


def _cleaned(lines: DataFrame, keep_cr: bool) -> DataFrame:
    value = F.col("value") if keep_cr else F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return lines.withColumn("raw", value).where("raw <> ''").drop("value")


def text_lines(spark: SparkSession, path: str, source_id: int = 0, keep_cr: bool = False) -> DataFrame:
    """Non-empty lines of a text file or folder, plain or with a codec's suffix, read in splits and numbered in file order."""
    read = spark.read.option("lineSep", "\n").text(path)
    placed = read.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    # A task reads one full split or several ends of files, so there are no more splits than tasks and files.
    splits = read.rdd.getNumPartitions() + len(read.inputFiles())
    numbered = numbered_lines(_cleaned(placed, keep_cr), most_splits=splits)
    return numbered.select(F.lit(source_id).alias("source_id"), "seq", "raw")


def unpacked_lines(spark: SparkSession, path: str, source_id: int = 0, keep_cr: bool = False) -> DataFrame:
    """Lines of a compressed file whose name hides its codec: each file is unpacked by one task, in pieces."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = memoryview(content.as_buffer())
                kind, rest, n = compression_of(bytes(data[:4])), b"", 0
                for piece in _pieces(data, kind):
                    *whole, rest = (rest + piece).split(b"\n")
                    if whole:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(whole)), pa.array(range(n, n + len(whole)), pa.int64()), pa.array(whole, pa.binary())], ["_path", "n", "value"])
                        n += len(whole)
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([rest], pa.binary())], ["_path", "n", "value"])

    made = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "_path string, n long, value binary")
    kept = _cleaned(made.withColumn("value", F.col("value").cast("string")).withColumn("_block", F.expr("n div 1048576")), keep_cr)
    return numbered_lines(kept.drop("n")).select(F.lit(source_id).alias("source_id"), "seq", "raw")


def _pieces(data: memoryview, kind: str | None, size: int = 1 << 20) -> Iterator[bytes]:
    if kind == "gzip":
        box = zlib.decompressobj(wbits=31)
        left = data
        while len(left):
            out = box.decompress(left[:size])
            left = left[size:]
            if out:
                yield out
            if box.eof:  # another member may follow
                left = memoryview(box.unused_data + bytes(left))
                box = zlib.decompressobj(wbits=31)
    elif kind == "zstd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True) as reader:
            while piece := reader.read(size):
                yield piece
    else:
        for at in range(0, len(data), size):
            yield bytes(data[at : at + size])


def array_lines(spark: SparkSession, path: str, source_id: int = 0, limit: int = ARRAY_BYTES) -> DataFrame:
    """The objects of a JSON-array file, one a line, keys in order, other elements dropped; larger files are refused."""

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    value = json.loads(content.as_py())
                except ValueError as e:
                    raise ValueError(f"JSON array parse error: {e}") from None
                if not isinstance(value, list):
                    raise ValueError("top-level value is not an array")
                rows = [json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for x in value if isinstance(x, dict)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([0] * len(rows), pa.int64()), pa.array(rows, pa.string())], ["_path", "_block", "raw"])

    files = spark.read.format("binaryFile").load(path)
    if any(r["length"] > limit for r in files.select("length").collect()):
        raise ValueError(f"JSON-array file is over {limit >> 20} MB; split it into one object a line first")
    made = files.select("path", "content").mapInArrow(flatten, "_path string, _block long, raw string")
    return numbered_lines(made).select(F.lit(source_id).alias("source_id"), "seq", "raw")


def _kept(lines: Iterable[str]) -> Iterator[str]:
    return (x for x in (y.removesuffix("\n").removesuffix("\r") for y in lines) if x)


def given_lines(spark: SparkSession, lines: Iterable[str], source_id: int = 0) -> DataFrame:
    """Lines in memory."""
    return spark.createDataFrame([(source_id, i, x) for i, x in enumerate(_kept(lines))], LINES)


def _batch(source_id: int, held: list[tuple[int, str]]) -> pa.RecordBatch:
    numbers, texts = zip(*held, strict=True)
    try:
        raw = pa.array(texts, pa.string())
    except UnicodeEncodeError:  # bytes that are no UTF-8 are lone surrogates in Python's standard input
        raw = pa.array([x.encode("utf-8", "surrogatepass").decode("utf-8", "replace") for x in texts], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([source_id] * len(held), pa.int32()), pa.array(numbers, pa.int64()), raw], schema=SPOOLED)


def spooled_rows(spark: SparkSession, rows: Iterable[tuple[int, str]], source_id: int = 0, piece: int = SPOOL_LINES) -> DataFrame:
    """Numbered lines that are read once: the driver takes ``piece`` of them at a time and holds no more than these and a row group.

    Row groups go to a file on the driver's disk; each file is moved to the shared folder once it has SPOOL_FILE bytes.
    """
    rows = iter(rows)
    held = list(islice(rows, piece))
    if len(held) < piece:
        return spark.createDataFrame([(source_id, *r) for r in held], LINES)
    jvm = spark.sparkContext._jvm
    path = f"{shared_folder(spark)}/spool-{uuid.uuid4().hex}"
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with tempfile.TemporaryDirectory(prefix="logweave-") as folder:
        for n in count():
            name, size = f"part-{n:06d}.parquet", 0
            with pq.ParquetWriter(f"{folder}/{name}", SPOOLED) as out:
                while held and size < SPOOL_FILE:
                    group, most = [], size + SPOOL_GROUP
                    while held and size < most:
                        group.append(_batch(source_id, held))
                        size += group[-1].nbytes
                        held = list(islice(rows, piece))
                    out.write_table(pa.Table.from_batches(group), row_group_size=sum(g.num_rows for g in group))
            fs.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(jvm.java.io.File(f"{folder}/{name}").toURI()), jvm.org.apache.hadoop.fs.Path(path, name))
            if not held:
                return spark.read.schema(LINES).parquet(path)


def spooled_lines(spark: SparkSession, lines: Iterable[str], source_id: int = 0, piece: int = SPOOL_LINES) -> DataFrame:
    """Lines of a stream that is read once, such as standard input, by ``spooled_rows``."""
    return spooled_rows(spark, enumerate(_kept(lines)), source_id, piece)


def open_lines(spark: SparkSession, path: str, source_id: int = 0, keep_cr: bool = False, array_limit: int = ARRAY_BYTES) -> tuple[DataFrame, str]:
    """Numbered lines of any input, and how it was read: plain, compressed, array or stdin."""
    if path == "-":
        return spooled_lines(spark, sys.stdin, source_id), "stdin"
    head = head_of(spark, path, 64)
    kind = compression_of(head)
    if kind:
        named = Path(path).suffix == SUFFIXES[kind]
        return (text_lines if named else unpacked_lines)(spark, path, source_id, keep_cr), "compressed"
    if looks_like_array(head[:16]):
        return array_lines(spark, path, source_id, array_limit), "array"
    return text_lines(spark, path, source_id, keep_cr), "plain"
