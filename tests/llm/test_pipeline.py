import random
import re

import corpus_pipeline as P
from logweave.llm import mixing, near_dedup, queries
from logweave.llm import quality as Q
from logweave.llm.common import write_table
from tests.conftest import DATA
from tests.llm.test_near_dedup import brute as brute_components
from tests.llm.test_packing import check

SF = f"{DATA}/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    good, _ = write_table(P.drop_low_quality(spark, docs, SF), "good")
    assert good.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in Q.score_quality(docs, Q.train(docs, queries.table(spark, SF, "labels"))).collect()}
    assert {r["doc_id"] for r in good.collect()} == {d for d, p in scores.items() if p}

    single, _ = write_table(P.drop_near_copies(spark, good, SF), "single")
    assert single.columns == docs.columns
    components = brute_components([(r["doc_id"], r["text"]) for r in good.collect()], 80)
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, c) in components.items() if d == c}

    masked, _ = write_table(P.mask_secrets(spark, single, SF), "masked")
    want = {r["doc_id"]: re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", r["text"]) for r in single.collect()}
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect() if "[SECRET]" in r["text"])

    mixed = P.mix_sources(spark, masked, SF)
    assert mixed.columns == docs.columns
    slots = {r["doc_id"]: r["slot"] for r in mixing.mix(masked, queries.SHARES).collect()}
    assert [slots[r["doc_id"]] for r in mixed.collect()] == list(range(len(want)))

    by_doc, _ = check(P.pack_sequences(spark, mixed, SF).collect())
    assert set(by_doc) == set(want)


def test_run_equals_the_stages_and_handles_odd_tables(spark, docs, tmp_path):
    from tests.llm.conftest import ODD

    names = [n for n, _ in P.STAGES]
    assert len(names) == 5 and P.ORACLE_SQL is None
    assert P.run(spark, SF).count() > 0
    for i, rows in enumerate((ODD, [])):
        d = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
        d.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{i}/labels.parquet")
        out = P.run(spark, f"{tmp_path}/{i}")
        assert (out.count() > 0) == bool(rows)
    assert near_dedup.THRESHOLD == 85


def test_prefixes_of_the_packed_sequences_hold_the_target_weights(spark, docs, tmp_path):
    # A third of the rows is src0 and a third src4: in their own proportions src4 would be as common as src0.
    r = random.Random(5)
    names = ["src0", "src4", "src1", "src0", "src4", "src2", "src0", "src4", "src3"]
    rows = [(i, " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 6) + str(r.randint(0, 9999)) for _ in range(r.randint(20, 700))), "en", names[i % 9]) for i in range(1800)]
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    check(out)
    last = max(x["sequence_id"] for x in out)
    assert {x["sequence_id"] for x in out} == set(range(last + 1))
    source = {i: s for i, _, _, s in rows}
    for part in (0.2, 0.3, 0.4):  # src1, src2 and src0 last for longer
        held = [source[x["doc_id"]] for x in out if x["sequence_id"] <= part * last and x["piece"] == 0]
        for name, share in queries.SHARES.items():
            assert abs(held.count(name) / len(held) - share / sum(queries.SHARES.values())) < 0.06, (part, name)
