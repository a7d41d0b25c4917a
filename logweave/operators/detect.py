"""Which format a file's first lines are in; runs on the driver over at most 64 lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

_BLANKS = b" \t\n\x0c\r"
_ACCESS = re.compile(rb"\A[^\[]*\[([^\]]{0,30})\]", re.S)
_LOGBACK = re.compile(rb"\A.{4}-.{2}-.{2} .{2}:.{2}:.{2}(?:[.,][0-9]*)? (?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|SEVERE)(?![A-Za-z])", re.S)
_PAIR = re.compile(rb' *[A-Za-z0-9_.]+=(?:"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z)|[^ ]*)', re.S)
_QUOTED = re.compile(rb'"(?:[^"]|"")*(?:"|\Z)', re.S)


def vote(line: bytes) -> str | None:
    """The format that a trimmed line looks like, most specific first."""
    if re.match(rb"<[0-9]+>[0-9]+ ", line):
        return "syslog"
    if (m := _ACCESS.match(line)) and m[1].count(b"/") == 2 and m[1].count(b":") >= 3:
        return "access"
    if len(line) >= 25 and _LOGBACK.match(line):
        return "logback"
    if line.startswith(b"{"):
        if b"__REALTIME_TIMESTAMP" in line[:512] or b'"PRIORITY"' in line[:512]:
            return "journalctl"
        if line.endswith(b"}"):
            return "edn" if re.match(rb"\{[ \t]*[:#]", line) else "ndjson"
    first = _PAIR.match(line)
    if first and re.match(rb" *[A-Za-z0-9_.]+=", line[first.end() :]):
        return "logfmt"
    bare = _QUOTED.sub(b"", line)
    commas, tabs = bare.count(b","), bare.count(b"\t")
    return "tsv" if tabs >= 2 and tabs > commas else "csv" if commas >= 2 else None


#: In order of preference: what a format needs more votes than. All need two. Fixed values.
RIVALS = {
    "syslog": ("ndjson", "logfmt", "edn", "access", "logback"),
    "access": ("ndjson", "logfmt", "edn", "logback"),
    "logback": ("ndjson", "logfmt", "edn"),
    "journalctl": ("ndjson", "edn"),
    "edn": ("ndjson", "logfmt"),
    "logfmt": ("ndjson",),
    "ndjson": (),
    "tsv": ("csv",),
    "csv": (),
}


def detect_format(lines: Iterable[bytes]) -> str:
    """The format of the lines; NDJSON if none stands out. Python logging and patterns are never guessed."""
    votes = Counter(vote(x) for x in (y.strip(_BLANKS) for y in lines) if x)
    return next((f for f, rivals in RIVALS.items() if votes[f] >= 2 and all(votes[f] > votes[r] for r in rivals)), "ndjson")


def looks_like_array(head: bytes) -> bool:
    """A JSON array of objects, or an empty one."""
    return re.match(rb"[ \t\n\x0c\r]*\[[ \t\n\x0c\r]*[{\]]", head) is not None
