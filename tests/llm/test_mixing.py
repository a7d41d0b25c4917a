import random
from math import ceil, floor

import pytest

from logweave.llm import mixing
from tests.llm.conftest import ODD


def brute(counts: dict[str, int], share) -> list[str]:
    """Slot by slot: frames, releases, deadlines, earliest deadline first."""
    left, out = dict(counts), []
    while any(left.values()):
        c = {s: min(share(s), n) for s, n in left.items() if n}
        length, done = sum(c.values()), dict.fromkeys(c, 0)
        for t in range(length):
            ready = [(ceil((done[s] + 1) * length / c[s]), s) for s in c if done[s] < c[s] and floor(done[s] * length / c[s]) <= t]
            s = min(ready)[1]
            done[s] += 1
            out.append(s)
        for s in c:
            left[s] -= c[s]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_schedule_equals_brute_force_and_deviates_by_less_than_a_block(docs, seed):
    r = random.Random(seed)
    shares = {f"s{i}": r.randint(1, 7) for i in range(r.randint(1, 6))}
    names = [*shares, "other"]
    rows = [(i, f"t{i}", "en", r.choice(names[: 1 + i % len(names)])) for i in range(r.randint(1, 300))]
    got = sorted(mixing.mix(docs(rows), shares).select("slot", "source_name", "released", "due", "frame", "doc_id").collect())
    assert [g["slot"] for g in got] == list(range(len(rows)))
    counts = {s: sum(x[3] == s for x in rows) for s in {x[3] for x in rows}}
    assert [g["source_name"] for g in got] == brute(counts, lambda s: shares.get(s, 1))
    assert sorted(g["doc_id"] for g in got) == sorted(x[0] for x in rows)
    assert all(g["released"] <= g["slot"] < g["due"] for g in got)
    for f in {g["frame"] for g in got}:
        frame = [g["source_name"] for g in got if g["frame"] == f]
        for s in set(frame):
            w = frame.count(s) / len(frame)
            assert all(abs(frame[:t].count(s) - w * t) < 1 for t in range(len(frame) + 1))


def test_odd_rows(docs):
    got = mixing.mix(docs(ODD), {"a": 3}).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(ODD)))
    assert mixing.NULL_SOURCE in {r["source_name"] for r in got}
    assert mixing.mix(docs([]), {"a": 3}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs(ODD), {"a": 0})


def test_in_order_keeps_columns_and_rows(docs):
    d = docs(ODD)
    out = mixing.in_order(d, {"a": 2})
    assert out.columns == d.columns
    key = lambda r: tuple(str(x)[:40] for x in r)
    assert sorted(map(key, out.collect())) == sorted(map(key, d.collect()))


def test_main_path_is_native(docs):
    plan = mixing.mix(docs(ODD), {"a": 2})._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
