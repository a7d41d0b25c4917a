"""Writers: the raw lines of a view, and the bookmark sidecar."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

MOST_SOURCES = 256


def save_view(view: DataFrame, path: str, single: bool = False) -> None:
    """Raw lines in line order, a line end after each, replacing what is there.

    Files are ranges of line_id in name order, so a concatenation is the view; ``single`` makes one file.
    """
    if not path.strip():
        raise ValueError("empty path")
    ordered = view.select("line_id", "raw")
    ordered = ordered.orderBy("line_id").coalesce(1) if single else ordered.repartitionByRange("line_id").sortWithinPartitions("line_id")
    ordered.select("raw").write.mode("overwrite").text(path)


class Bookmarks:
    """Marked line_ids by source file and tab in one JSON file, kept across runs."""

    def __init__(self, path: str | os.PathLike):
        self.path = Path(path)
        try:
            self.sources: dict[str, dict] = json.loads(self.path.read_text())["sources"]
        except (OSError, ValueError, KeyError, TypeError):
            self.sources = {}  # missing or damaged files never stop anything

    def restore(self, source: str, inode: int, size: int, total: int | None = None) -> list[list[int]] | None:
        """Marks by tab if the file is the same and has not shrunk; marks beyond ``total`` records are dropped."""
        entry = self.sources.get(source)
        if entry is None:
            return None
        if entry["inode"] != inode or entry["size"] > size:
            del self.sources[source]
            return None
        return [[m for m in tab if total is None or m < total] for tab in entry["tabs"]]

    def keep(self, source: str, inode: int, size: int, tabs: list[list[int]], now: str | None = None) -> None:
        """Replace a source's marks; none at all removes it; the sources touched longest ago go beyond MOST_SOURCES."""
        if not any(tabs):
            self.sources.pop(source, None)
            return
        self.sources[source] = {"inode": inode, "size": size, "tabs": [sorted(set(t)) for t in tabs], "updated": now or datetime.now(UTC).isoformat()}
        for old in sorted(self.sources, key=lambda s: self.sources[s]["updated"])[: max(0, len(self.sources) - MOST_SOURCES)]:
            del self.sources[old]

    def save(self) -> None:
        """Write beside and rename, so a reader never sees half a file."""
        self.path.parent.mkdir(parents=True, exist_ok=True)
        beside = self.path.with_suffix(".tmp")
        beside.write_text(json.dumps({"sources": self.sources}, indent=2))
        beside.replace(self.path)
