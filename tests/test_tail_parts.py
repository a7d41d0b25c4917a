import os

from logweave.streaming import live
from logweave.streaming.tail import TailReader, cut

T = "2026-06-01T12:00:00Z"


def _all(reader):
    at, seen = reader.initialOffset(), []
    while (made := reader.read(at))[1] != at:
        rows, then = list(made[0]), made[1]
        assert rows == list(reader.readBetweenOffsets(at, then))
        seen, at = seen + rows, then
    return seen


def test_parts_hold_each_line_once(tmp_path):
    """Whatever the cuts, the parts give the lines and numbers of one reader, in batches of the same bound."""
    path = tmp_path / "a.log"
    path.write_bytes(b"".join(b"line %d\r\n\n" % i for i in range(100)) + b"y" * 500 + b"\nend\n\xff\nopen")
    whole = _all(TailReader(str(path), 64))
    assert len(whole) == 103
    for parts in (1, 2, 3, 7, 50, 1000):
        for least in (1, 100, 700, 5000):
            made = cut(str(path), parts, least)
            assert len(made) <= parts and made[-1][1] is None and all(stop - start["pos"] >= least for start, stop in made[:-1])
            assert [stop for _, stop in made[:-1]] == [start["pos"] for start, _ in made[1:]]
            assert [r for start, stop in made for r in _all(TailReader(str(path), 64, start=start, stop=stop))] == whole
    assert len(cut(str(path), 4, 100)) == 4 and cut(f"{path}.none", 4, 1) == [({"inode": 0, "pos": 0, "seq": 0}, None)]


def test_only_the_last_part_goes_on_after_a_rotation(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("".join(f"line {i}\n" for i in range(40)))
    (start, stop), (last, _) = cut(str(path), 2, 1)
    first, second = TailReader(str(path), 64, start=start, stop=stop), TailReader(str(path), 1000, start=last)
    at, then = first.read(start)[1], second.read(last)[1]
    path.rename(tmp_path / "a.log.1")
    path.write_text("new\n" * 2)
    rows, same = first.read(at)
    assert list(rows) == [] and same == at
    assert list(second.read(then)[0]) == [(40, "new"), (41, "new")]
    os.truncate(path, 0)
    assert list(first.read(at)[0]) == []


def test_append_file_in_parts(spark, tmp_path):
    """Batches of several parts run beside each other; appended lines and a restart are taken on, nothing twice."""
    path = tmp_path / "a.log"
    line = lambda i: f'{{"ts":"{T}","level":"info","n":"{i}"}}\n'
    path.write_text("".join(line(i) for i in range(200)))

    def run(more: int) -> int:
        following = live.append_file(spark, str(path), f"{tmp_path}/out", f"{tmp_path}/cp", "10 milliseconds", max_bytes=200, lanes=3)
        try:
            assert len(following.queries) == 3 and spark.conf.get(live._MANAGER, None) is None
            following.processAllAvailable()
            with path.open("a") as f:
                f.writelines(line(i) for i in range(more, more + 20))
            following.processAllAvailable()
            rows = following.table(spark).select("line_id", "raw").collect()
            assert sorted(map(tuple, rows)) == [(i, line(i).rstrip()) for i in range(more + 20)]
            return following.progress()
        finally:
            following.stop()

    assert run(200) == 220
    assert run(220) == 20


def test_append_file_without_rows(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("\n\nopen")
    following = live.append_file(spark, str(path), f"{tmp_path}/out", f"{tmp_path}/cp")
    try:
        following.processAllAvailable()
        assert following.progress() == 0 and following.table(spark).count() == 0
    finally:
        following.stop()
