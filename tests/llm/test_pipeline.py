"""Each stage against a plain version of it, on its own input."""

from __future__ import annotations

import pyspark.sql.functions as F
import pytest

import corpus_pipeline as P
from relictum.llm.decontaminate import normalise
from relictum.llm.quality import fit_quality, statistics
from relictum.llm.queries import oracle_sql, queries

from .test_text_operators import plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, path = [spark.read.parquet(f"{SF}/documents.parquet")], tmp_path_factory.mktemp("stages")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"file://{path}/{i}")
        out.append(spark.read.parquet(f"file://{path}/{i}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[1:-1])


def test_quality_stage(spark, stages):
    import numpy as np

    model = fit_quality(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {i: model.scores(np.array([statistics(r.text or "")]))[0] for i, r in rows(stages[0]).items()}
    assert set(rows(stages[1])) == {i for i, s in scores.items() if s >= 0.3}


def shingles(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_near_duplicate_stage(stages):
    """No two that stay are clearly copies, and whatever went is like one that stayed or went."""
    before, after = ({i: shingles(r.text) for i, r in rows(stages[n]).items()} for n in (1, 2))
    alike = lambda a, b: len(a & b) / len(a | b)
    kept = list(after.items())
    assert not [(i, j) for n, (i, a) in enumerate(kept) for j, b in kept[:n] if alike(a, b) >= 0.85]
    for i in set(before) - set(after):
        assert max(alike(before[i], b) for j, b in before.items() if j != i) >= 0.8


def test_decontamination_stage(spark, stages):
    items = [normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, r in rows(stages[2]).items() if not any(b in normalise(r.text or "") for b in items)}
    assert set(rows(stages[3])) == clean


def test_secret_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        assert plain_spans(before[i].text) or r.text == before[i].text


def test_mixing_stage(stages):
    before, after = rows(stages[4]), rows(stages[5])
    assert 0 < len(after) <= len(before) and all(before[i].text == r.text and 0 < r.probability <= 1 and abs(r.weight * r.probability - 1) < 1e-9 for i, r in after.items())


def test_run_equals_stages(spark, stages):
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(rows(stages[5]))


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in P.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run(spark, name):
    assert queries()[name](spark, SF).count() >= 0


def test_embeddings_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.execute(oracle_sql()["op8_embedding_dedup"]).fetchall())
    got = queries()["op8_embedding_dedup"](spark, SF)
    assert sorted(map(tuple, got.collect())) == want
