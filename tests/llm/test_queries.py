"""The registered queries over whole small tables against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import pytest

from relictum.llm.decontaminate import normalise
from relictum.llm.queries import QUALITY_THRESHOLD, TOKEN_LIMIT, queries

from .test_text_operators import plain_fingerprint, plain_groups, plain_repeats, plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    found = {}

    def of(name: str):
        if name not in found:
            df = queries()[name](spark, SF)
            found[name] = (dict(df.dtypes), df.collect())
        return found[name]

    return of


def test_op1(result, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")))
    kinds, rows = result("op1_token_counts")
    assert kinds == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len(t.encode()), n := len(model.encode(t)), n > TOKEN_LIMIT) for i, t in texts.items()}


def test_op2(result, texts):
    kinds, rows = result("op2_secret_scan")
    assert kinds == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        said = [f"{k}:{a}:{b}" for a, k, b in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= {*r.spans.split(","), ""}


@pytest.mark.parametrize("name,threshold", [("op3_toxicity", 0.5), ("op7_quality", QUALITY_THRESHOLD)])
def test_scores(result, texts, name, threshold):
    kinds, rows = result(name)
    assert kinds == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)


def test_op4(result, texts):
    _, rows = result("op4_source_mixing")
    assert len(rows) == len(texts) and all(0 <= r.probability <= 1 and r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) for r in rows)


def test_op5(spark, result):
    kinds, rows = result("op5_html_extraction")
    assert kinds == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op6(result, texts):
    kinds, rows = result("op6_suffix_dedup")
    assert kinds == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    want = dict(zip(texts, plain_repeats([t.encode() for t in texts.values()]), strict=True))
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_op9(spark, result, texts):
    _, rows = result("op9_decontamination")
    items = {r.item_id: normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    exact = {(i, k) for i, t in texts.items() for k, b in items.items() if b in normalise(t)}
    assert {(r.doc_id, r.item_id) for r in rows if not r.distance} == exact


def test_op10(result, texts):
    kinds, rows = result("op10_simhash")
    assert kinds == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_groups(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", groups[i]) for i in texts}
