from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import WORD, canonical_rows, duck_rows, order_of

import corpus_pipeline as c
from querylens.llm.common import with_row_ids
from querylens.llm.mixing import OP1_SQL
from querylens.llm.quality import fit_quality, quality_scores

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    from test_exact_dedup import brute as exact
    from test_near_dedup import brute as near

    steps, docs = [], c.documents(spark, SF)
    columns = docs.columns
    for name, stage in c.STAGES:
        before = docs
        docs = c.kept(stage(spark, docs, SF), name)
        steps.append((name, [tuple(r) for r in before.collect()], docs))
        if name != "encoding":
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in out.select("doc_id").collect()} for name, _, out in steps}
    inputs = {name: rows for name, rows, _ in steps}

    model = fit_quality(c.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids["quality"] == {r.doc_id for r in quality_scores(c.documents(spark, SF), model).collect() if r.predicted}
    assert 0 < len(ids["quality"]) < len(inputs["quality"])
    assert ids["exact_dedup"] == {r[0] for r in exact(inputs["exact_dedup"]) if r[3]}
    assert ids["near_dedup"] == {r[0] for r in near(inputs["near_dedup"], 5, 80) if r[3]}
    assert ids["mixing"] == {i for i, taken in duck_rows(inputs["mixing"], OP1_SQL, "doc_id, sampled") if taken}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in inputs["encoding"]}
    for r in steps[-1][2].collect():
        assert r.ids == library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True) and r.n_tokens == len(r.ids)
        assert r.decoded == library.decode(r.ids)
        raw = (texts[r.doc_id] or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw
    assert ids["encoding"] == ids["mixing"]
    assert {r.doc_id for r in c.run(spark, SF).collect()} == ids["encoding"]


def test_odd_rows(spark, odd, none):
    """Rows without id, rows repeated whole and ids shared by different texts: one row of each group stays."""
    from test_near_dedup import brute as near

    rows, df = odd
    rows = rows + [(12, "x " * 3 + rows[0][1]), (None, "alone without id " * 9), (None, "alone without id " * 9)]
    extra = spark.createDataFrame(rows[-3:], "doc_id bigint, text string")
    docs = df.unionByName(extra, allowMissingColumns=True)
    exact = c.exact_dedup(spark, docs, SF)
    assert exact.columns == docs.columns
    found = [(r.doc_id, r.text) for r in exact.collect()]
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault("".join(WORD.findall(text or "")), []).append((i, text))
    best = [min(g, key=lambda r: (-len(r[1] or ""), order_of(r[0]))) for g in groups.values()]
    assert canonical_rows((i, t or "") for i, t in best) == canonical_rows((i, t or "") for i, t in found)

    docs = c.kept(exact, "exact")
    kept = [(r.doc_id, r.text) for r in c.near_dedup(spark, docs, SF).collect()]
    ordered = sorted(found, key=lambda r: (order_of(r[0]), r[1] or ""))
    numbered = [(k, t) for k, (_, t) in enumerate(ordered)]
    components = {}
    for k, _, component, _ in near(numbered, 5, 80):
        components.setdefault(component, []).append(ordered[k])
    assert len(kept) == len(components)
    for members in components.values():
        ids = [m[0] for m in members]
        stays = [r for r in kept if r in members]
        assert len(stays) == 1
        if ids.count(min(ids, key=order_of)) == 1:
            assert stays[0][0] == min(ids, key=order_of)

    for start in (docs, none):
        docs = start
        for _, stage in c.STAGES:
            docs = c.kept(stage(spark, docs, SF), "odd")
        assert docs.count() <= len(found)


def test_row_ids(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c"), (7, "d"), *[(5, f"e{i}") for i in range(40)]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = with_row_ids(df).collect()
    assert len({r._row_id for r in out}) == len(out) == len(rows)
    assert {(r.doc_id, r._row_id) for r in out if r.doc_id in (1, 7)} == {(1, 1), (7, 7)}
    assert all(r._row_id > 7 for r in out if r.doc_id not in (1, 7))
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), t) for i, t in rows)
    with pytest.raises(ValueError, match="no room"):
        with_row_ids(spark.createDataFrame([(2**63 - 1, "a"), (None, "b")], "doc_id bigint, text string"))
