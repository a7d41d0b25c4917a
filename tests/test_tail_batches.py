import tempfile

import pyarrow as pa

from logweave.plans import source_queries as S
from logweave.streaming.tail import SCHEMA, TailSource
from tests.conftest import DATA


def test_a_batch_is_one_arrow_batch(tmp_path):
    """Spark takes a batch as it is, bounded as before, and the same again after a restart."""
    path = tmp_path / "a.log"
    path.write_bytes(b"".join(b"line %d\n" % i for i in range(100)) + b"\xff\r\n\n\n" + b"open")
    reader = TailSource({"path": str(path), "maxBytes": "64"}).simpleStreamReader(SCHEMA)
    at, seen = reader.initialOffset(), []
    while True:
        made, then = reader.read(at)
        if then == at:
            break
        made, again = list(made), list(reader.readBetweenOffsets(at, then))
        assert len(made) <= 1 and all(isinstance(b, pa.RecordBatch) and b.schema.names == ["seq", "raw"] for b in made) and made == again
        assert sum(len(r["raw"]) + 1 for b in made for r in b.to_pylist()) <= 64
        seen += [(r["seq"], r["raw"]) for b in made for r in b.to_pylist()]
        at = then
    assert list(made) == [] and seen == [(i, f"line {i}") for i in range(100)] + [(100, "�")]


def test_live_ingest_leaves_no_file_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    assert S.live_ingest(spark, f"{DATA}/sf0.001").count() == 1000
    assert list(tmp_path.glob("logweave-*")) == []
