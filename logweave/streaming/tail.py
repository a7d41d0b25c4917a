"""A streaming source that tails one growing file.

Offsets are {inode, pos, seq}. A batch reads at most ``maxBytes`` and never past the last line end, so a line
that is still being written waits for its rest. Another inode under the path (rotation) or a file
shorter than the position (truncation in place) starts again at 0. A restart repeats what an
unfinished batch read as long as the file keeps those bytes.

A file that is long already can be cut at line ends (``cut``) into parts that several readers take at once, each in
batches of the same bound: all but the last end at ``stop`` and give nothing after a rotation or truncation.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "seq long, raw string"


class TailSource(DataSource):
    """``readStream.format("logtail").option("path", …)``; options: maxBytes, fromEnd, keepCr, start (an offset as JSON), stop (a position)."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        o = self.options
        part = json.loads(o.get("start", "null")), json.loads(o.get("stop", "null"))
        return ArrowTailReader(o["path"], int(o.get("maxBytes", 8 << 20)), o.get("fromEnd", "false").lower() == "true", o.get("keepCr", "false").lower() == "true", *part)


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, max_bytes: int, from_end: bool = False, keep_cr: bool = False, start: dict | None = None, stop: int | None = None):
        self.path, self.max_bytes, self.from_end, self.keep_cr, self.start, self.stop = path, max_bytes, from_end, keep_cr, start, stop

    def initialOffset(self) -> dict:
        if self.start:
            return self.start
        if self.from_end and os.path.exists(self.path):
            s = os.stat(self.path)
            return {"inode": s.st_ino, "pos": s.st_size, "seq": 0}
        return {"inode": 0, "pos": 0, "seq": 0}

    def _lines(self, data: bytes) -> list[str]:
        lines = (x if self.keep_cr else x.removesuffix(b"\r") for x in data.split(b"\n")[:-1])
        return [x.decode("utf-8", "replace") for x in lines if x]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        try:
            with open(self.path, "rb") as f:
                s = os.fstat(f.fileno())
                same = s.st_ino == start["inode"] and s.st_size >= start["pos"]
                if self.stop is not None and not same:  # the rest of this part is gone
                    return iter(()), start
                pos = start["pos"] if same else 0
                f.seek(pos)
                data = f.read(self._room(pos))
                while data and b"\n" not in data and (more := f.read(self._room(pos + len(data)))):  # one line longer than a batch
                    data += more
        except FileNotFoundError:  # between a rename and the new file
            return iter(()), start
        data = data[: data.rfind(b"\n") + 1]
        lines = self._lines(data)
        end = {"inode": s.st_ino, "pos": pos + len(data), "seq": start["seq"] + len(lines)}
        return iter([(start["seq"] + i, x) for i, x in enumerate(lines)]), end

    def _room(self, pos: int) -> int:
        return self.max_bytes if self.stop is None else min(self.max_bytes, self.stop - pos)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            same = os.fstat(f.fileno()).st_ino == end["inode"]
            pos = start["pos"] if start["inode"] == end["inode"] and start["pos"] <= end["pos"] else 0
            f.seek(pos)
            data = f.read(end["pos"] - pos) if same else b""
        return iter([(start["seq"] + i, x) for i, x in enumerate(self._lines(data))])

    def commit(self, end: dict) -> None:
        pass


class ArrowTailReader(TailReader):
    """The same batches as one Arrow batch each, so Spark need not convert them row by row."""

    def read(self, start: dict) -> tuple[Iterator[pa.RecordBatch], dict]:
        rows, end = super().read(start)
        return _arrow(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[pa.RecordBatch]:
        return _arrow(super().readBetweenOffsets(start, end))


def _arrow(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = list(rows)
    return iter([pa.record_batch([pa.array([n for n, _ in held], pa.int64()), pa.array([x for _, x in held], pa.string())], names=["seq", "raw"])] if held else [])


def cut(path: str, parts: int, least: int, keep_cr: bool = False) -> list[tuple[dict, int | None]]:
    """Start and stop of at most ``parts`` parts of what the file holds now, none shorter than ``least`` bytes; the last has no stop.

    The lines before a part are read once and counted, so that it knows its first number.
    """
    if not os.path.exists(path):
        return [(TailReader(path, 1).initialOffset(), None)]
    s = os.stat(path)
    size = max(least, -(-s.st_size // parts), 1)
    reader, first, found = TailReader(path, 1 << 20, keep_cr=keep_cr), {"inode": s.st_ino, "pos": 0, "seq": 0}, []
    while len(found) < parts - 1 and s.st_size - first["pos"] >= size + least:
        at = first
        while (left := first["pos"] + size - at["pos"]) > 0:
            reader.max_bytes = min(left, 1 << 20)
            _, after = reader.read(at)
            if after["inode"] != s.st_ino or after["pos"] <= at["pos"]:  # rotated or truncated meanwhile, or a line without end
                return [*found, (first, None)]
            at = after
        found.append((first, at["pos"]))
        first = at
    return [*found, (first, None)]
