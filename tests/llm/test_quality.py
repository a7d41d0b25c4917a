from itertools import product

import numpy as np
import pytest

from logweave.llm import queries
from logweave.llm import quality as Q
from tests.conftest import DATA
from tests.llm.conftest import ODD


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    n = np.array([3, 1, 5, 4])
    score, pair = r.normal(size=n.sum()), r.normal(size=(2, 2))
    good, pairs = Q.marginals(score, pair, n, True)
    at, want, want_pairs = 0, [], np.zeros((2, 2))
    for k in n:
        s = score[at : at + k]
        z, m, p = 0.0, np.zeros(k), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(k)):
            w = np.exp(s @ np.array(y) + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += w
            m += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                p[a, b] += w
        want += list(m / z)
        want_pairs += p / z
        at += k
    assert good == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def test_features_have_a_row_a_line():
    texts = ["", "one line", "a\nb\n\nc", "X!! Y!!\nX!! Y!!", "é" * 5000]
    x, size, n = Q.line_features(texts)
    assert n.tolist() == [1, 1, 4, 2, 1] and len(x) == len(size) == 9 and np.isfinite(x).all()
    alone, _, _ = Q.line_features([texts[2]])
    assert np.allclose(x[2:6], alone)


def test_long_chains_equal_short_ones():
    r = np.random.default_rng(1)
    for scale in (1, 40):
        score, pair = r.normal(size=70_000) * scale, r.normal(size=(2, 2))
        assert np.allclose(Q.chain_marginals(score, pair), Q.marginals(score, pair, np.array([len(score)]))[0], atol=1e-9)
    for n in (1, 2, 7):
        assert np.allclose(Q.chain_marginals(score[:n], pair), Q.marginals(score[:n], pair, np.array([n]))[0])


def model():
    r = np.random.default_rng(2)
    lines = ["", "same", "A sentence of words, here.", "#### 12 @@ !!", "tail tail tail", "  blank  "]
    texts = ["\n".join(r.choice(lines, r.integers(1, 30))) for _ in range(60)]
    return Q.LineCRF(*Q.line_features(texts), r.integers(0, 2, 60), 20), texts


def test_blocks_hold_every_line():
    for text in ("", "\n", "a", "a\n\nb", "x" * 50 + "\nlast", "\n" * 9, "ab\ncd\n"):
        for chars in (1, 3, 1000):
            assert [x for b in Q.line_blocks(text, chars) for x in b] == text.split("\n")


def test_long_texts_are_scored_alike(monkeypatch):
    crf, texts = model()
    texts += ["\n".join(texts * 5), "\n" * 3000, "", "one"]
    whole = crf.raw(*Q.line_features(texts))
    monkeypatch.setattr(Q.line_blocks, "__defaults__", (97,))
    assert np.allclose([crf.raw_long(t) for t in texts], whole, atol=1e-8)
    want = crf.score(texts)
    monkeypatch.setattr(Q, "LONG_LINES", 3)
    monkeypatch.setattr(Q, "BATCH_LINES", 10)
    assert np.allclose(crf.score(texts), want, atol=1e-8) and len(crf.score([])) == 0


def test_a_million_lines():
    crf, _ = model()
    assert 0 <= crf.score(["a b\n" * 500_000 + "\n" * 500_000])[0] <= 1


def test_learning_reads_one_text_an_id_and_bounded_lines(docs, spark, monkeypatch):
    prose, junk = "The house stands near a river.\n" * 4, "#$ 12 %% @@ 34 !!\n" * 4
    rows = [(i, prose if i % 2 else junk, "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    one, twice = Q.train(docs(rows), labels), Q.train(docs(rows + rows), labels)
    assert np.allclose(one.w, twice.w)
    monkeypatch.setattr(Q, "MAX_DOC_LINES", 4)
    assert Q.train(docs(rows), labels) is None
    monkeypatch.setattr(Q, "MAX_DOC_LINES", 5)
    monkeypatch.setattr(Q, "MAX_LINES", 100)
    few = Q.train(docs(rows), labels)
    assert few is None or not np.allclose(few.w, one.w)


def test_odd_rows(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 1), (7, 1, 0), (7, None, 0), (4, 5, 0)], "doc_id long, quality int, toxic int")
    d = docs(ODD)
    got = Q.score_quality(d, Q.train(d, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)
    assert Q.train(d, labels.limit(0)) is None
    assert {g["score"] for g in Q.score_quality(d, None).collect()} == {0.5}
    assert Q.score_quality(docs([]), None).count() == 0
    kept = Q.keep_good(d, None)
    assert kept.columns == d.columns and kept.count() == len(ODD)


def test_what_stands_late_in_a_text_is_learned(docs, spark):
    r = np.random.default_rng(6)
    prose = lambda: " ".join(r.choice(["the", "house", "stands", "near", "a", "river", "and", "people", "walk"], 9)).capitalize() + "."
    junk = lambda: "".join(r.choice(list("#$%&*@!~^|0123456789 "), 40))
    rows = [(i, "\n".join([prose() for _ in range(50)] + [prose() if i % 2 else junk() for _ in range(50)]), "en", "s") for i in range(150)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    d = docs(rows)
    got = Q.score_quality(d, Q.train(d, labels)).where("held_out").collect()
    assert len(got) > 30 and all(g["predicted"] == g["doc_id"] % 2 for g in got)


def test_held_out_accuracy(spark):
    got = queries.op8_quality(spark, f"{DATA}/sf0.1").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").where("held_out")
    r = got.selectExpr("avg(cast(predicted = quality as int)) a", "avg(case when quality = 0 then 1 - predicted end) bad", "avg(case when quality = 1 then predicted end) good").first()
    assert r["a"] > 0.97 and r["bad"] > 0.93 and r["good"] > 0.97
