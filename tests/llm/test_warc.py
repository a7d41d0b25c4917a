import gzip
import hashlib
import http.client
import io
import random

import pytest

from logweave.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    first = {}
    for i, _, h in rows:
        d = (h or "").encode()
        if len(d) >= 100 and i is not None:
            first[d] = min(i, first.get(d, i))
    out, seen = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        d = (h or "").encode()
        head = first.get(d)
        again = len(d) >= 100 and head is not None and sum((b or "").encode() == d for _, _, b in rows) > 1 and (i != head or d in seen)
        if i == head:
            seen.add(d)
        out.append((i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("segment", [W.SEGMENT, 64])
def test_round_trip(spark, segment):
    r = random.Random(segment)
    bodies = [None, "", "x", "a" * 99, "a" * 100, "é" * 60, "WARC/1.1\r\n" * 40, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "0\r\n\r\n" * 50, "\r\n" * 200, "😀" * 1000, "big " * 5000, "\r\n\r\nWARC/1.1"] + ["".join(r.choice("ab\r\nWARC/1.") for _ in range(300)) for _ in range(40)]
    urls = [None, "http://a/", "http://a/\r\nX: WARC/1.1\r\n", "http://ü/é"]
    rows = [(i, r.choice(urls), r.choice(bodies)) for i in range(250)] + [(3, None, "a" * 100), (3, None, "a" * 100), (0, "u", "a" * 100), (None, None, "q" * 200)]
    pages = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA).repartition(3)
    got = W.archive_round_trip(pages, segment=segment).collect()
    assert all(g["intact"] for g in got)
    assert sorted(str(tuple(g[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for g in got) == brute(rows)


def test_records_are_cut_into_segments():
    body = b"0123456789" * 100
    made, upto = [], 0
    for k in range(4):
        record, upto = W.record_bytes(7, "t", "http://x/", "d", len(body), "response", None, k, 4, body[k * 256 : (k + 1) * 256], upto)
        made.append(W.parse_record(record[len(W.START) :]))
    assert [len(d) for _, d in made] == [256, 256, 256, 232] and b"".join(d for _, d in made) == body
    assert [f["warc-type"] for f, _ in made] == ["response", "continuation", "continuation", "continuation"]
    assert made[-1][0]["warc-segment-total-length"] == str(sum(int(f["content-length"]) for f, _ in made))


def by_length(data: bytes):
    """Records of a plain archive, read strictly by the format's grammar: version, fields, a block of the stated length, two line ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1"
        f = dict(x.split(": ", 1) for x in lines)
        n = int(f["Content-Length"])
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        yield f, data[end + 4 : end + 4 + n]
        at = end + 8 + n


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_other_readers_find_every_record(spark, tmp_path, compression):
    bodies = ["a" * 100, "short", None, "é" * 400, "WARC/1.1\r\n" * 60, "z" * 1000]
    rows = [(i, f"http://h/{i}", bodies[i % 6], "") for i in range(40)] + [(3, "u", "é" * 400, ""), (3, "u", "é" * 400, ""), (1, "u", "short", ""), (None, None, "n" * 300, ""), (None, None, "n" * 300, "")]
    W.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "a"), segment=256, compression=compression)
    files = [p.read_bytes() for p in (tmp_path / "a").glob("part-*")]
    found = [r for x in files for r in by_length(gzip.decompress(x) if compression == "gzip" else x)]
    ids = [f["WARC-Record-ID"] for f, _ in found]
    assert len(set(ids)) == len(ids)
    for f, _ in found:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(f)
        if f["WARC-Type"] == "revisit":
            assert found[ids.index(f["WARC-Refers-To"])][0]["WARC-Type"] == "response"
    origins = [(f, x) for f, x in found if f["WARC-Type"] == "response"]
    got = []
    for f, block in origins:
        rest = sorted((int(g["WARC-Segment-Number"]), int(g.get("WARC-Segment-Total-Length", 0)), y) for g, y in found if g.get("WARC-Segment-Origin-ID") == f["WARC-Record-ID"])
        whole = block + b"".join(y for *_, y in rest)
        assert [k for k, *_ in rest] == list(range(2, len(rest) + 2)) and (not rest or rest[-1][1] == len(whole))
        response = http.client.HTTPResponse(Wire(whole))
        response.begin()
        payload = response.read()
        assert f["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        got.append(payload)
    assert {len(x) for x in got} >= {0, 5, 100, 800, 600, 1000, 300} and len(found) > len(rows) > len(origins)


class Wire:
    """What http.client takes for a socket."""

    def __init__(self, data: bytes):
        self.data = data

    def makefile(self, *_):
        return io.BytesIO(self.data)


def test_archives_of_others(spark, tmp_path):
    body = b"hello world"
    sha = hashlib.sha256(body).hexdigest()

    def record(fields, block):
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))]).encode() + b"\r\n" + block + b"\r\n\r\n"

    plain = b"HTTP/1.1 200 OK\r\nContent-Length: 11\r\n\r\n" + body
    records = [
        record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: x\r\n"),
        record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], plain),
        record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Payload-Digest", f"sha256:{sha}")], plain),
        record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Payload-Digest", "sha1:ABC"), ("WARC-Segment-Number", 1)], plain[:-6]),
        record([("WARC-Type", "continuation"), ("WARC-Record-ID", "<urn:uuid:4>"), ("WARC-Segment-Number", 2), ("WARC-Segment-Origin-ID", "<urn:uuid:3>"), ("WARC-Segment-Total-Length", len(plain))], plain[-6:]),
        record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:5>"), ("WARC-Refers-To", "<urn:uuid:2>"), ("WARC-Payload-Digest", f"sha256:{sha}")], b""),
        record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:6>"), ("WARC-Payload-Digest", "sha256:" + "0" * 64)], plain),
    ]
    (tmp_path / "x.warc").write_bytes(b"".join(records))
    got = [tuple(r) for r in W.whole_records(W.read_chunks(spark, str(tmp_path / "x.warc"))).collect()]
    want = [(None, 11, sha, "response", None, x) for x in (None, True, None, False)] + [(None, None, sha, "revisit", None, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_same_null_ids(spark):
    rows = [(None, None, "z" * 150), (None, None, "z" * 150), (9, None, "z" * 150)]
    got = W.archive_round_trip(spark.createDataFrame([(*x, "") for x in rows], SCHEMA)).collect()
    assert sorted((g["page_id"] or 0, g["record_type"], g["refers_to"]) for g in got) == [(0, "revisit", 9), (0, "revisit", 9), (9, "response", None)]
    alone = W.archive_round_trip(spark.createDataFrame([(*x, "") for x in rows[:2]], SCHEMA)).collect()
    assert [g["record_type"] for g in alone] == ["response", "response"] and all(g["intact"] for g in alone)


def test_empty_table(spark):
    assert W.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
