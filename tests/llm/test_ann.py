import numpy as np
import pytest

from logweave.llm import ann, queries
from tests import oracle
from tests.conftest import DATA


def exact(x, ids, k, every):
    out = {}
    for i in np.nonzero(ids % every == 0)[0]:
        s = (x * x[i]).sum(1)
        other = np.nonzero(ids != ids[i])[0]
        top = other[np.lexsort((ids[other], -s[other]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in top]
    return out


@pytest.mark.parametrize("n,blocks", [(15, 100_000), (900, 250)])
def test_recall_and_order(spark, monkeypatch, n, blocks):
    monkeypatch.setattr(ann, "BLOCK", blocks)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    x = np.random.default_rng(1).normal(size=(n, 32)).astype(np.float32).astype(np.float64)
    ids = np.arange(n)
    got = {}
    for r in ann.nearest(spark.createDataFrame([(int(i), v.tolist(), "s") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, score string")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(x, ids, 20, 20)
    assert set(got) == set(want)
    for q, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == min(20, n - 1)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        assert all(abs(s - x[q] @ x[v]) < 1e-12 for _, v, s in rows)
    assert np.mean([len({r[1] for r in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_index_probes_reach_every_code_within_the_radius():
    r = np.random.default_rng(2)
    codes = r.integers(0, 256, (3000, 16), dtype=np.uint8)
    codes[1000:] = codes[:2000] ^ (r.random((2000, 16)) < 0.2).astype(np.uint8)
    index = ann.Index(codes)
    for radius in (0, 5, 20, 45, 60):
        for q in codes[::500]:
            assert index.within(q, radius).tolist() == np.nonzero(np.bitwise_count(codes ^ q).sum(1) <= radius)[0].tolist()


def test_lone_queries_beside_a_hot_cluster_get_all_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 800)
    r = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    n, ids = 2000, np.arange(2000)
    x = unit(r.normal(size=(40, 32)))[r.integers(0, 40, n)]
    x[r.random(n) < 0.6] = x[0]
    x = unit(x + 0.01 * r.normal(size=x.shape))
    lone = ids[::100]
    x[lone] = unit(r.normal(size=(len(lone), 32)))
    x = x.astype(np.float32).astype(np.float64)
    got = {}
    for row in ann.nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    want = exact(x, ids, 20, 20)
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(want, 20)


def test_reach_holds_the_nearest_codes():
    codes = np.random.default_rng(5).integers(0, 256, (500, 8), dtype=np.uint8)
    index = ann.Index(codes)
    for q in codes[::50]:
        far = np.bitwise_count(codes ^ q).sum(1)
        for radius, need in ((0, 1), (0, 30), (3, 500), (5, 900), (40, 2)):
            most = max(radius, np.sort(far)[min(need, 500) - 1])
            assert index.reach(q, radius, need).tolist() == np.nonzero(far <= most)[0].tolist()


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.5]), (40, [0.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20, every=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0), (20, 3, 2, -1.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def recall_of(spark, x, ids):
    got = {}
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    for r in ann.nearest(rows).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(x, ids, 20, 20)
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(want, 20)
    return np.mean([len(got[q] & {v for v, _ in want[q]}) / 20 for q in want])


@pytest.mark.parametrize("kind", ["clusters", "plain", "lengths"])
def test_recall_out_of_sample(spark, monkeypatch, kind):
    """Tables of ten times the sample and more, with lone queries, whose radius the sample cannot know."""
    monkeypatch.setattr(ann, "SAMPLE", 300)
    monkeypatch.setattr(ann, "BLOCK", 1000)
    r = np.random.default_rng(8)
    n = 4000
    x = r.normal(size=(n, 32))
    if kind == "clusters":
        x = r.normal(size=(25, 32))[r.integers(0, 25, n)] + 0.3 * x
        x[::200] = r.normal(size=(n // 200, 32))
    if kind == "lengths":  # inner products, not angles, decide
        x *= r.lognormal(0, 0.3, (n, 1))
    found = recall_of(spark, x.astype(np.float32).astype(np.float64), np.arange(n))
    print(f"recall, {kind}: {found:.3f}")
    assert found >= 0.9


def test_recall_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 200)
    con = oracle.connect(f"{DATA}/sf0.1")
    want = {}
    for q, v in con.execute(f"SELECT query_id, vec_id FROM ({queries.EXACT_NEAREST_SQL})").fetchall():
        want.setdefault(q, set()).add(v)
    got = {}
    for row in queries.op10_ann(spark, f"{DATA}/sf0.1").collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    assert got.keys() == want.keys() and np.mean([len(got[q] & want[q]) / len(want[q]) for q in want]) >= 0.9
