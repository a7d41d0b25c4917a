"""Live ingest: micro-batches of parsed records appended to a growing table, and windows over the stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from logweave.operators.aggregates import COUNTERS
from logweave.operators.formats import SourceSpec

TICK = "500 milliseconds"
#: Parts of a long file that are taken at once; each is a query with a Python worker of some 75 MB and buffers on the driver.
LANES = 2
_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"


def append_records(stream: DataFrame, path: str, checkpoint: str, tick: str | None = TICK) -> StreamingQuery:
    """Append to a Parquet table, exactly once a batch; ``tick`` None takes what is there and stops."""
    _watch(stream.sparkSession)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    with _plain_renames(stream.sparkSession, checkpoint):
        return (writer.trigger(processingTime=tick) if tick else writer.trigger(availableNow=True)).start()


@contextmanager
def _plain_renames(spark: SparkSession, folder: str) -> Iterator[None]:
    """On a local file system, let queries started here rename their logs through ``FileSystem``: ``FileContext`` starts a process for every name it looks at."""
    if spark.conf.get(_MANAGER, None) or _hadoop(spark, folder)[0].getUri().getScheme() != "file":
        yield
        return
    spark.conf.set(_MANAGER, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    try:
        yield
    finally:
        spark.conf.unset(_MANAGER)


def _hadoop(spark: SparkSession, *path: str) -> tuple:
    """File system and path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(*path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Following:
    """The queries that append one followed file, each its part of it, to folders of one table."""

    def __init__(self) -> None:
        self.queries: list[StreamingQuery] = []
        self.folders: list[str] = []
        self.schema: StructType | None = None

    def add(self, stream: DataFrame, folder: str, checkpoint: str, tick: str | None) -> None:
        self.queries.append(append_records(stream, folder, checkpoint, tick))
        self.folders.append(folder)
        self.schema = stream.schema

    def processAllAvailable(self) -> None:
        for q in self.queries:
            q.processAllAvailable()

    def progress(self) -> int:
        return sum(progress(q) for q in self.queries)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    def table(self, spark: SparkSession) -> DataFrame:
        """What the batches that ended have appended; each folder has its own log of them."""
        return reduce(DataFrame.unionByName, (spark.read.schema(self.schema).parquet(f) for f in self.folders))


def append_file(spark: SparkSession, file: str, path: str, checkpoint: str, tick: str | None = TICK, spec: SourceSpec | None = None, max_bytes: int = 8 << 20, lanes: int = LANES) -> Following:
    """Append a followed file as ``append_records`` does, each batch of at most ``max_bytes``.

    A batch costs the same time whatever it holds, so what the file holds at the start is cut into parts of at least 16 batches,
    at most ``lanes``, whose batches run beside each other; the last part goes on with what is appended. Rows come by ``line_id`` within a part only.
    """
    from logweave.plans.engine import follow

    following = Following()
    try:
        for k, part in enumerate(_parts(spark, file, checkpoint, max_bytes, lanes)):
            following.add(follow(spark, file, spec, max_bytes=max_bytes, part=part), f"{path}/part-{k}", f"{checkpoint}/part-{k}", tick)
    except BaseException:
        following.stop()
        raise
    return following


def _parts(spark: SparkSession, file: str, checkpoint: str, max_bytes: int, lanes: int) -> list[tuple[dict, int | None]]:
    """The parts of the file, kept beside the checkpoints: a restart goes on with those it began with."""
    from logweave.streaming import tail

    fs, kept = _hadoop(spark, checkpoint, "parts.json")
    if fs.exists(kept):
        held = fs.open(kept)
        try:
            return [tuple(part) for part in json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))]
        finally:
            held.close()
    made = tail.cut(file, lanes, 16 * max_bytes)
    _, draft = _hadoop(spark, checkpoint, "parts.json.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(made).encode()))
    finally:
        out.close()
    if not fs.rename(draft, kept):
        raise OSError(f"{kept.toString()}: not written")
    return made


def live_histogram(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by severity in windows of fixed width over the stream; rows later than ``late`` are left out."""
    timed = stream.where(F.col("ts_micros").isNotNull()).withColumn("ts", F.timestamp_micros("ts_micros")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("count"), *(F.count_if(F.col("severity") == k).alias(c) for k, c in enumerate(COUNTERS)))


class _Counter(StreamingQueryListener):
    """Rows of every batch of every query of a session, as the batches end."""

    def __init__(self) -> None:
        self.rows: dict[str, dict[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.setdefault(str(p.runId), {})[p.batchId] = p.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


_COUNTERS: dict[str, _Counter] = {}


def _watch(spark: SparkSession) -> None:
    if spark.sparkContext.applicationId not in _COUNTERS:
        spark.streams.addListener(_COUNTERS.setdefault(spark.sparkContext.applicationId, _Counter()))


def progress(query: StreamingQuery) -> int:
    """Rows that a query of ``append_records`` has ingested so far.

    Spark itself keeps the last batches only, so a listener counts those before; the two overlap by batch number.
    """
    rows = dict(next((c.rows[str(query.runId)] for c in _COUNTERS.values() if str(query.runId) in c.rows), {}))
    return sum((rows | {p["batchId"]: p["numInputRows"] for p in query.recentProgress}).values())


def fold_stream(lines: DataFrame, spec: SourceSpec, timeout_ms: int = 1000) -> DataFrame:
    """Join continuation lines of a stream (source_id, seq, raw). A record closes when the next head comes, or after ``timeout_ms`` of silence.

    State is the one open record of each source.
    """
    marked = lines.withColumn("continues", spec.line_format().continues())

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq, raw = state.get
            state.remove()
            yield pd.DataFrame({"source_id": [key[0]], "seq": [seq], "raw": [raw]})
            return
        rows = pd.concat(batches).sort_values("seq")
        numbers, texts = rows["seq"].to_numpy(), rows["raw"].tolist()
        if state.exists:
            seq, raw = state.get
            numbers, texts = [seq, *numbers], [raw, *texts]
            heads = [True, *~rows["continues"].to_numpy(bool)]
        else:
            heads = [True, *~rows["continues"].to_numpy(bool)[1:]]
        starts = [i for i, head in enumerate(heads) if head]
        joined = ["\n".join(texts[a:b]) for a, b in zip(starts, [*starts[1:], len(texts)], strict=True)]
        state.update((int(numbers[starts[-1]]), joined[-1]))
        state.setTimeoutDuration(timeout_ms)
        closed = pd.DataFrame({"source_id": key[0], "seq": [numbers[i] for i in starts[:-1]], "raw": joined[:-1]})
        yield closed.astype({"source_id": "int32", "seq": "int64", "raw": "object"})

    return marked.groupBy("source_id").applyInPandasWithState(fold, "source_id int, seq long, raw string", "seq long, raw string", "append", GroupStateTimeout.ProcessingTimeTimeout)
